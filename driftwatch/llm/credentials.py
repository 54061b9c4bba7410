"""Secrets: fixed patterns, and formats inferred from the credentials that those find."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.llm import flat
from driftwatch.llm.common import stored
from driftwatch.session import ship_package

KINDS = ("assign", "access", "hex", "inferred")

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HINT = r"AKIA|[0-9a-f]{24}|(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, kind number, credential) of every base match, in code points."""
    found = [(*m.span(), 0, m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(*m.span(), 1, m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(*m.span(), 2, m[0]) for m in HEX.finditer(text) if len(m[0]) >= 24]
    return sorted(found, key=lambda x: (x[0], x[2]))


def classes(value: str) -> str:
    """Each character's class: digit, a-f, other small letter, A-F, other capital, or itself."""
    def one(c: str) -> str:
        if c.isdigit():
            return "d"
        if c.isalpha():
            return ("x" if c in "abcdef" else "l") if c.islower() else ("X" if c in "ABCDEF" else "L")
        return c
    return "".join(map(one, value))


SYMBOLS = 12  # classes, + / _ . = - and the end


class FormatAutomaton:
    """A probabilistic automaton: the prefix tree of sample strings with statistically compatible states merged.

    Two states are compatible when their shares of endings and of each next symbol differ by less than
    Hoeffding's bound at ``alpha``, and so do the states that follow them.
    """

    def __init__(self, strings: list[str], alpha: float = 0.05):
        self.next: list[dict[str, int]] = [{}]
        self.seen, self.ends, self.by = [0], [0], [Counter()]
        for s in strings:
            state = 0
            for c in s:
                self.seen[state] += 1
                self.by[state][c] += 1
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.seen.append(0)
                    self.ends.append(0)
                    self.by.append(Counter())
                state = self.next[state][c]
            self.seen[state] += 1
            self.ends[state] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_states()

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return n1 > 0 and n2 > 0 and abs(f1 / n1 - f2 / n2) > self.bound * (n1 ** -0.5 + n2 ** -0.5)

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if self._differ(self.ends[a], self.seen[a], self.ends[b], self.seen[b]):
                return False
            if any(self._differ(self.by[a][c], self.seen[a], self.by[b][c], self.seen[b])
                   for c in self.by[a].keys() | self.by[b].keys()):
                return False
            todo.extend((self.next[a][c], self.next[b][c]) for c in self.next[a].keys() & self.next[b].keys())
        return True

    def _fold(self, a: int, b: int) -> None:
        """Adds the tree under ``b`` to the states from ``a`` on."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.seen[a] += self.seen[b]
            self.ends[a] += self.ends[b]
            self.by[a].update(self.by[b])
            for c, after in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], after))
                else:
                    self.next[a][c] = after

    def _merge_states(self) -> None:
        fixed = [0]
        while True:
            edge = {q for r in fixed for q in self.next[r].values()} - set(fixed)
            if not edge:
                break
            new = max(edge, key=lambda q: (self.seen[q], -q))
            parents = [(r, c) for r in fixed for c, q in self.next[r].items() if q == new]
            for old in fixed:
                if self._compatible(old, new):
                    for r, c in parents:
                        self.next[r][c] = old
                    self._fold(old, new)
                    break
            else:
                fixed.append(new)
        self.states = fixed

    def bits(self, s: str) -> float:
        """-log2 of the string's probability; what was never seen costs a smoothed share."""
        state, total = 0, 0.0
        for c in s:
            n = self.seen[state] if state is not None else 0
            share = ((self.by[state][c] if state is not None else 0) + 0.1) / (n + 0.1 * SYMBOLS)
            total -= math.log2(share)
            state = self.next[state].get(c) if state is not None else None
        n, e = (self.seen[state], self.ends[state]) if state is not None else (0, 0)
        return total - math.log2((e + 0.1) / (n + 0.1 * SYMBOLS))


class Formats:
    """One automaton for each kind of credential, and one for other tokens of like length."""

    def __init__(self, credentials: dict[str, list[str]], others: list[str]):
        self.automata = [FormatAutomaton([classes(v) for v in sorted(vs)]) for _, vs in sorted(credentials.items()) if vs]
        self.others = FormatAutomaton([classes(v) for v in sorted(others)])

    def likely(self, value: str, margin: float, most: float) -> bool:
        """Whether the best credential format takes at most ``most`` bits a character, and ``margin`` less than others."""
        s = classes(value)
        own = min((a.bits(s) for a in self.automata), default=math.inf) / len(s)
        return own <= most and self.others.bits(s) / len(s) - own >= margin


def candidates(block: flat.Block, least: int = 16):
    """Runs of token characters with two digits and two letters at least: byte start, end and document."""
    w = flat.words(block, "token")
    total = lambda m: np.concatenate([[0], np.cumsum(m)])
    digits, letters = total((block.data >= 48) & (block.data <= 57)), total((block.data >= 97) & (block.data <= 122))
    keep = ((w.end - w.start >= least) & (digits[w.end] - digits[w.start] >= 2) & (letters[w.end] - letters[w.start] >= 2))
    return w.start[keep], w.end[keep], w.doc[keep]


def _found(texts: pa.Array):
    """(row, text or None, base spans, candidates as (start, end, value)) for each row."""
    hint = np.asarray(pc.fill_null(pc.match_substring_regex(texts, HINT), False))
    for block in flat.blocks(texts):
        start, end, doc = candidates(block)
        points = flat.code_points(block)
        for d in range(len(block)):
            lo, hi = np.searchsorted(doc, [d, d + 1])
            base = base_spans(texts[block.first + d].as_py() or "") if hint[block.first + d] else []
            origin = points[block.offsets[d]]
            yield base, [(int(points[a] - origin), int(points[b] - origin), block.raw[a:b].tobytes().decode())
                         for a, b in zip(start[lo:hi].tolist(), end[lo:hi].tolist(), strict=True)]


def _ordinary(block: flat.Block, every: int = 1024) -> list[str]:
    """Tokens that are no candidates, one in ``every`` by hash: what credentials must be told from."""
    w = flat.words(block, "token")
    keep = (w.end - w.start >= 8) & (w.end - w.start <= 64)
    start, end = w.start[keep], w.end[keep]
    keep = (flat.span_hashes(block.data, start, end) % np.uint64(every) == 0) & ~np.isin(start, candidates(block)[0])
    return [block.raw[a:b].tobytes().decode() for a, b in zip(start[keep].tolist(), end[keep].tolist(), strict=True)]


def _free(base, tokens):
    """Candidates that no base span touches."""
    return [t for t in tokens if not any(t[0] < b[1] and b[0] < t[1] for b in base)]


def labelled_credentials(docs: DataFrame, size: int = 300, others: int = 1000) -> tuple[dict[str, list[str]], list[str]]:
    """Distinct credentials of each base kind (``size`` of least hash) and of other tokens (``others``)."""
    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            rows = [(KINDS[k], v) for base, _ in _found(texts) for *_, k, v in base if len(v) <= 256]
            rows += [(KINDS[3], v) for block in flat.blocks(texts) for v in _ordinary(block)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], ["kind", "value"])

    ship_package(docs.sparkSession)
    rows = stored(docs.select("text").mapInArrow(run, "kind string, value string").distinct(), "credentials")
    out = defaultdict(list)
    for k, kind in enumerate(KINDS):
        picked = rows.filter(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(size if k < 3 else others)
        out[kind] = [r.value for r in picked.collect()]
    return {k: v for k, v in out.items() if k != "inferred"}, out["inferred"]


def secrets(docs: DataFrame, size: int = 300, margin: float = 1.0, most: float = 3.0) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, base_spans.

    Automata are inferred from a bounded, repeatable sample of the base matches of all documents. Every
    candidate of every text is scored; one that no base span touches and that some format finds likely
    (``Formats.likely``) joins as ``inferred``. Places are code points.

    Null and empty texts have no spans (the digest of the empty text); repeated rows get a row each; other
    columns are not read; without base matches nothing is inferred; an empty table gives no rows.
    """
    spark = docs.sparkSession
    formats = spark.sparkContext.broadcast(Formats(*labelled_credentials(docs, size)))

    def scan(texts, ids):
        counts, base_text, all_text = [], [], []
        for base, tokens in _found(texts):
            more = [(s, e, 3) for s, e, v in _free(base, tokens) if formats.value.likely(v, margin, most)]
            own = [b[:3] for b in base]
            counts.append(np.bincount([k for *_, k in own], minlength=3).tolist())
            base_text.append(",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in own))
            all_text.append(",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in sorted([*own, *more], key=lambda x: (x[0], x[2]))))
        counts = np.array(counts, np.int64).reshape(-1, 3)
        return [ids, *(pa.array(counts[:, k]) for k in range(3)), pa.array(base_text, pa.string()),
                pa.array(all_text, pa.string())]

    found = flat.per_document(docs, scan, "doc_id long, n_assign long, n_access long, n_hex long, base_spans string, "
                                          "spans string")
    return found.withColumn("base_sha256", F.sha2("base_spans", 256))
