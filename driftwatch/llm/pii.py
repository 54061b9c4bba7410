"""Personal data: fixed patterns, and a linear-chain CRF over word shapes that adds what they miss."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.llm import flat
from driftwatch.llm.common import stored
from driftwatch.session import ship_package

KINDS = ("email", "ip", "card", "phone")
LABELS = ("out", *KINDS)
ONE_WORD = ("email", "ip")  # spans of these never hold white space

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    turned = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in turned) % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Left-most matches: each @ takes the local characters before it that no earlier match holds."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of every base match, in code points."""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found = [(s, e, 0) for s, e in _emails(text)]
    found += [(*m.span(), 1) for m in IP.finditer(text)
              if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    found += [(*m.span(), 2) for m in CARD.finditer(text) if 14 <= len(d := digits(m)) <= 19 and luhn(d)]
    found += [(*m.span(), 3) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(found, key=lambda x: (x[0], x[2]))


SHAPES = 1 << 11


def shapes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number below ``SHAPES`` for each word: counts of its kinds of characters, and whether its digits pass Luhn."""
    def count(mask):
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return sums[end] - sums[start]

    digit = count((data >= 48) & (data <= 57))
    letter = count(((data >= 97) & (data <= 122)) | (data >= 128))
    bucket = np.searchsorted([1, 3, 4, 5, 10, 14, 20], digit, "right")           # 0..7
    dots = np.minimum(count(data == 46), 3)                                      # 0..3
    marks = (letter > 0) * 1 + (count(data == 64) > 0) * 2 + (count((data == 40) | (data == 41)) > 0) * 4 \
        + (count(data == 45) > 0) * 8
    plus = (data[start] == 43) * 1 if len(start) else np.zeros(0, np.int64)
    passes = np.zeros(len(start), np.int64)
    for i in np.flatnonzero((digit >= 14) & (digit <= 19)).tolist():
        passes[i] = luhn(re.sub("[^0-9]", "", data[start[i]:end[i]].tobytes().decode("latin-1")))
    return (((bucket * 4 + dots) * 16 + marks) * 2 + plus) * 2 + passes


def chain_starts(block: flat.Block, w: flat.Words) -> np.ndarray:
    """Words that begin a chain: the first of a document or line, and those after a word that ends a sentence."""
    lines = np.concatenate([[0], np.cumsum(block.data == 10)])
    first = np.ones(len(w.start), bool)
    if len(first) > 1:
        last = block.data[w.end[:-1] - 1]
        first[1:] = ((w.doc[1:] != w.doc[:-1]) | (lines[w.start[1:]] != lines[w.start[:-1]])
                     | np.isin(last, [33, 46, 63]))
    return np.flatnonzero(first)


class Crf:
    """Labels of a chain of word shapes: own shape, both neighbours' shapes, and the label before."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move  # (3, SHAPES, labels), (labels, labels)

    def scores(self, shape: np.ndarray, first: np.ndarray) -> np.ndarray:
        edge = SHAPES - 1
        new = np.zeros(len(shape), bool)
        new[first] = True
        before = np.where(new, edge, np.roll(shape, 1))
        after = np.where(np.roll(new, -1), edge, np.roll(shape, -1))
        if len(shape):
            after[-1] = edge
        return self.emit[0][shape] + self.emit[1][before] + self.emit[2][after]

    def decode(self, shape: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best labels (Viterbi), all chains one step at a time side by side."""
        unary = self.scores(shape, first)
        length = np.diff(np.append(first, len(shape)))
        order = np.argsort(-length, kind="stable")
        first, length = first[order], length[order]
        back = np.zeros((len(shape), len(LABELS)), np.int8)
        best = unary[first].copy() if len(first) else np.zeros((0, len(LABELS)))
        longest = int(length[0]) if len(length) else 0
        for step in range(1, longest):
            live = int(np.searchsorted(-length, -step, "left"))
            at = first[:live] + step
            options = best[:live, :, None] + self.move[None]
            back[at] = options.argmax(1)
            best[:live] = options.max(1) + unary[at]
        out = np.zeros(len(shape), np.int8)
        label = best.argmax(1).astype(np.int8) if len(first) else np.zeros(0, np.int8)
        for step in range(longest - 1, -1, -1):
            live = int(np.searchsorted(-length, -step, "left"))
            at = first[:live] + step
            out[at] = label[:live]
            label[:live] = back[at, label[:live]]
        return out


def pieces(first: np.ndarray, last: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Chains of more than ``longest`` words as pieces of that many; each begins in the middle of the one before."""
    step = max(longest // 2, 1)
    many = 1 + np.maximum(-(-(last - first - longest) // step), 0)
    of = np.repeat(np.arange(len(first)), many)
    start = first[of] + (np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)) * step
    return start, np.minimum(start + longest, last[of])


def _sums(shape: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum of the rows of ``values`` by shape."""
    return np.stack([np.bincount(shape, v, SHAPES) for v in values.T], 1)


def train(chains: list[tuple[np.ndarray, np.ndarray]], rounds: int = 150, rate: float = 0.2, ridge: float = 1e-3) -> Crf:
    """Maximum likelihood by full-batch Adam; ``chains`` are (shapes, labels) of a bounded sample."""
    n_labels = len(LABELS)
    emit, move = np.zeros((3, SHAPES, n_labels)), np.zeros((n_labels, n_labels))
    if not chains:
        emit[0][:, 0] = 1.0
        return Crf(emit, move)
    chains = sorted(chains, key=lambda c: -len(c[0]))
    longest = len(chains[0][0])
    shape = np.full((len(chains), longest + 2), SHAPES - 1)
    label, live = np.zeros((len(chains), longest), int), np.zeros((len(chains), longest), bool)
    for i, (s, y) in enumerate(chains):
        shape[i, 1:len(s) + 1], label[i, :len(s)], live[i, :len(s)] = s, y, True
    views = (shape[:, 1:-1], shape[:, :-2], shape[:, 2:])
    gold_e, gold_m = np.zeros_like(emit), np.zeros_like(move)
    for k, v in enumerate(views):
        np.add.at(gold_e[k], (v[live], label[live]), 1)
    pair, many = live[:, 1:], live.sum(0).tolist()  # the first so many chains have the word of a step
    words = [v[live] for v in views]
    np.add.at(gold_m, (label[:, :-1][pair], label[:, 1:][pair]), 1)
    moments = [np.zeros_like(emit), np.zeros_like(emit), np.zeros_like(move), np.zeros_like(move)]
    for t in range(1, rounds + 1):
        unary = emit[0][views[0]] + emit[1][views[1]] + emit[2][views[2]]
        trans = np.exp(move)
        u = np.exp(unary - unary.max(2, keepdims=True))
        fwd, bwd = np.zeros_like(u), np.ones_like(u)
        fwd[:, 0] = u[:, 0] / u[:, 0].sum(1, keepdims=True)
        for s in range(1, longest):
            m = many[s]
            x = (fwd[:m, s - 1] @ trans) * u[:m, s]
            fwd[:m, s] = x / x.sum(1, keepdims=True)
        for s in range(longest - 2, -1, -1):
            m = many[s + 1]
            x = (u[:m, s + 1] * bwd[:m, s + 1]) @ trans.T
            bwd[:m, s] = x / x.sum(1, keepdims=True)
        post = (fwd * bwd)[live]
        post /= post.sum(1, keepdims=True)
        left, right = fwd[:, :-1][pair], (u[:, 1:] * bwd[:, 1:])[pair]
        scale = ((left @ trans) * right).sum(1, keepdims=True)
        grad_e = np.stack([_sums(v, post) for v in words])
        grad_m = trans * ((left / scale).T @ right)
        for x, g, m1, m2 in ((emit, gold_e - grad_e, *moments[:2]), (move, gold_m - grad_m, *moments[2:])):
            g = g / len(chains) - ridge * x
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            x += rate * (m1 / (1 - 0.9 ** t)) / (np.sqrt(m2 / (1 - 0.99 ** t)) + 1e-9)
    return Crf(emit, move)


def _maybe(texts: pa.Array) -> np.ndarray:
    """Texts that can hold a base match at all: with an @, or a long enough mix of digits and their separators."""
    hit = pc.match_substring_regex(texts, r"@|[0-9]\.[0-9]+\.[0-9]+\.[0-9]|[0-9]([ -]?[0-9]){13}|\+[0-9][ ().0-9-]+[0-9]")
    return np.asarray(pc.fill_null(hit, False))


def _labelled(texts, every: int, longest: int):
    """Chains (``pieces`` of long ones) for training: those that hold a base match, those with four digits in a word or an @ (the hard
    ones without), and one in ``every`` of the rest, by hash."""
    rows: tuple[list, ...] = ([], [], [], [])
    maybe = _maybe(texts)
    for block in flat.blocks(texts):
        w = flat.words(block)
        if not len(w.start):
            continue
        shape, first = shapes(block.data, w.start, w.end), chain_starts(block, w)
        label = np.zeros(len(shape), np.int8)
        points = flat.code_points(block)
        for d in np.flatnonzero(maybe[block.first:block.first + len(block)]).tolist():
            lo, hi = np.searchsorted(w.doc, [d, d + 1])
            origin = points[block.offsets[d]]
            ends, begs = points[w.end[lo:hi]] - origin, points[w.start[lo:hi]] - origin
            for s, e, kind in base_spans(texts[block.first + d].as_py() or ""):
                a, b = np.searchsorted(ends, s, "right"), np.searchsorted(begs, e, "left")
                label[lo + a:lo + b] = kind + 1
        last = np.append(first[1:], len(shape))
        first, last = pieces(first, last, longest)
        has = lambda mask: (c := np.concatenate([[0], np.cumsum(mask)]))[last] > c[first]  # noqa: E731, B023
        marked = has(label > 0)
        near = has((shape // 256 >= 3) | (shape // 4 % 16 & 2 > 0))
        codes = flat.span_hashes(block.data, w.start[first], w.end[last - 1])
        keep = marked | near | (codes % np.uint64(every) == 0)
        for i in np.flatnonzero(keep).tolist():
            a, b = first[i], last[i]
            rows[0].append(2 if marked[i] else 1 if near[i] else 0)
            rows[1].append(int(codes[i].astype(np.int64)))
            rows[2].append(shape[a:b].astype(np.int16).tobytes())
            rows[3].append(label[a:b].tobytes())
    return [pa.array(r, t) for r, t in zip(rows, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)]


def labelled_chains(docs: DataFrame, size: int = 1500, every: int = 512, longest: int = 48) -> list[tuple[np.ndarray, np.ndarray]]:
    """The labelled table: at most ``size`` distinct chains of each kind (see ``_labelled``) of least hash; a chain of more than
    ``longest`` words counts as overlapping pieces of that many."""
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(_labelled(batch.column("text"), every, longest), ["kind", "code", "s", "y"])

    ship_package(docs.sparkSession)
    rows = docs.select("text").mapInArrow(run, "kind int, code long, s binary, y binary")
    rows = stored(rows.groupBy("kind", "code").agg(F.min(F.struct("s", "y")).alias("r")), "chains")
    picked = [rows.filter(F.col("kind") == k).orderBy("code").limit(size) for k in (0, 1, 2)]
    return [(np.frombuffer(r.s, np.int16).astype(int), np.frombuffer(r.y, np.int8).astype(int))
            for part in picked for (r,) in part.select("r").collect()]


def _added(text: str, base: list[tuple[int, int, int]], begs, ends, label) -> list[tuple[int, int, int]]:
    """Spans of labelled words that no base span touches; neighbours of one kind join unless it is one word."""
    out: list[tuple[int, int, int]] = []
    for i in np.flatnonzero(label).tolist():
        kind, s, e = int(label[i]) - 1, int(begs[i]), int(ends[i])
        while e > s and text[e - 1] in ".,;:!?":
            e -= 1
        if out and out[-1][2] == kind and out[-1][3] == i - 1 and KINDS[kind] not in ONE_WORD:
            out[-1] = (out[-1][0], e, kind, i)
        elif e > s:
            out.append((s, e, kind, i))
    touched = lambda s, e: any(a < e and s < b for a, b, _ in base)
    return [(s, e, k) for s, e, k, _ in out if not touched(s, e)]


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def personal_data(docs: DataFrame, size: int = 1500, longest: int = 48, rounds: int = 150) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, base_spans.

    The CRF is trained on ``labelled_chains`` and decodes every word of every text; words that it labels
    join the base spans unless they touch one. Places are code points, ends exclusive.

    Null and empty texts have no spans (the digest of the empty text); repeated rows get a row each; other
    columns are not read; without base matches anywhere nothing is added; an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(labelled_chains(docs, size, longest=longest), rounds))

    def scan(texts, ids):
        crf, maybe = model.value, _maybe(texts)
        counts, base_text, all_text = [], [], []
        for block in flat.blocks(texts):
            w = flat.words(block)
            first = chain_starts(block, w)
            label = crf.decode(shapes(block.data, w.start, w.end), first)
            points, begins = flat.code_points(block), w.begins
            hot = np.bincount(w.doc[label > 0], minlength=len(block)) > 0
            for d in range(len(block)):
                if not (hot[d] or maybe[block.first + d]):
                    counts.append([0, 0, 0, 0]), base_text.append(""), all_text.append("")
                    continue
                text = texts[block.first + d].as_py() or ""
                base = base_spans(text)
                lo, hi, origin = begins[d], begins[d + 1], points[block.offsets[d]]
                more = _added(text, base, points[w.start[lo:hi]] - origin, points[w.end[lo:hi]] - origin, label[lo:hi])
                counts.append(np.bincount([k for *_, k in base], minlength=4).tolist())
                base_text.append(_joined(base))
                all_text.append(_joined(sorted([*base, *more], key=lambda x: (x[0], x[2]))))
        counts = np.array(counts, np.int64).reshape(-1, 4)
        return [ids, *(pa.array(counts[:, k]) for k in range(4)), pa.array(base_text, pa.string()),
                pa.array(all_text, pa.string())]

    found = flat.per_document(docs, scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
                                          "base_spans string, spans string")
    return found.withColumn("base_sha256", F.sha2("base_spans", 256))
