"""Language-model scoring: exact counts of all words and of all pairs of words, absolutely discounted."""

from __future__ import annotations

import io
import tempfile

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.llm import flat
from driftwatch.llm.common import discard, held_out, stored
from driftwatch.session import ship_package

HEAD = 1 << 20     # every task holds the counts of words with more than 1 / HEAD of all tokens; these are fewer
PIECE = 1 << 19    # tokens whose pairs are counted together where texts are read
SHARE = 1_000_000  # training tokens a shard of pairs gets
RARE = 0           # stands in a pair for a word that is not frequent, whose hash is beside it; others have places from 1 on
VOCAB = 1 << 11    # ids of a ``Trie``, the compact form for a short list of words; ``scores`` does not use it
CONTEXTS = 64      # contexts of one shard of the trie
LEVELS = 256       # steps of a quantised log-probability
CHUNK = 1 << 15    # numbers that are turned into bits at once; a multiple of 8
END = np.uint64(0x9E3779B97F4A7C15)  # stands for the end of a text among word hashes
END_CODE = int(END.astype(np.int64))
_U = np.uint64


class EliasFano:
    """An ascending sequence of distinct numbers: low bits packed, high bits in unary, with a directory of zeros."""

    def __init__(self, low: np.ndarray, high: np.ndarray, zeros: np.ndarray, width: int):
        self.low, self.high, self.zeros, self.width = low, high, zeros, width

    @staticmethod
    def width_for(universe: int, n: int) -> int:
        return max(0, int(np.floor(np.log2(max(universe, 1) / n)))) if n else 0

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        width = cls.width_for(universe, n)
        parts = [((values[i:i + CHUNK, None] >> np.arange(width - 1, -1, -1)) & 1).astype(np.uint8) for i in range(0, n, CHUNK)]
        low = np.concatenate([np.packbits(bits.ravel()) for bits in parts] + [np.zeros(4, np.uint8)])
        top = (universe >> width) + 1
        marks = np.zeros(-(-(n + top + 1) // 64) * 64, np.uint8)
        marks[(values >> width) + np.arange(n)] = 1
        zeros = np.cumsum(64 - marks.reshape(-1, 64).sum(1)).astype(np.uint32)
        return cls(low, np.packbits(marks), zeros, width)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.int64)
        at, shift = (i * self.width) >> 3, (i * self.width) & 7
        word = np.zeros(len(i), np.int64)
        for k in range(4):
            word = word << 8 | self.low[at + k]
        return (word >> (32 - shift - self.width)) & ((1 << self.width) - 1)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero (from 0) among the high bits."""
        word = np.searchsorted(self.zeros, k, "right")
        before = np.where(word > 0, self.zeros[np.maximum(word - 1, 0)], 0).astype(np.int64)
        bits = np.unpackbits(self.high.reshape(-1, 8)[word], axis=1)
        return word * 64 + (np.cumsum(1 - bits, 1, dtype=np.int64) == (k - before + 1)[:, None]).argmax(1)

    def find(self, values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Place of each value among places ``first`` to ``last`` (exclusive), or -1: high bits give a short range, in
        which the low bits are searched."""
        if not len(values):
            return np.zeros(0, np.int64)
        high, low = values >> self.width, values & ((1 << self.width) - 1)
        start = np.where(high > 0, self._zero(np.maximum(high - 1, 0)) - (high - 1), 0)
        lo, hi = np.maximum(start, first), np.minimum(self._zero(high) - high, last)
        end = hi.copy()
        while True:
            open_ = lo < hi
            if not open_.any():
                break
            mid = (lo + hi) >> 1
            less = np.zeros(len(lo), bool)
            less[open_] = self._low(mid[open_]) < low[open_]
            lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
        found = lo < end
        found[found] = self._low(lo[found]) == low[found]
        return np.where(found, lo, -1)


def build_shard(pairs: pd.DataFrame, unigram: np.ndarray, discount: float) -> bytes:
    """The successors of ``CONTEXTS`` contexts: pointers, ids, quantised log-probabilities, back-off weights.

    ``pairs`` has prev, next and n. Probabilities are absolutely discounted counts interpolated with ``unigram``.
    """
    pairs = pairs.sort_values(["prev", "next"])
    prev, after, n = (pairs[c].to_numpy() for c in ("prev", "next", "n"))
    shard = int(prev[0]) // CONTEXTS
    rel = prev - shard * CONTEXTS
    total = np.bincount(rel, n, CONTEXTS)
    kinds = np.bincount(rel, minlength=CONTEXTS)
    left = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
    logp = np.log10((n - discount) / total[rel] + left[rel] * unigram[after])
    least = float(min(logp.min(), -1e-6))
    code = np.rint(logp / least * (LEVELS - 1)).astype(np.uint8)
    ef = EliasFano.encode(rel.astype(np.int64) * (VOCAB + 1) + after, CONTEXTS * (VOCAB + 1))
    out = io.BytesIO()
    np.savez(out, low=ef.low, high=ef.high, zeros=ef.zeros, width=ef.width, code=code, least=least, shard=shard,
             pointers=np.concatenate([[0], np.cumsum(kinds)]).astype(np.uint32), backoff=np.log10(left).astype(np.float32))
    return out.getvalue()


class Trie:
    """All shards in one file that is mapped, not read; the file goes with the last mapping."""

    def __init__(self, shards: list[bytes], unigram: np.ndarray):
        self.unigram, self.blobs = np.log10(np.maximum(unigram, 1e-300)), shards
        self.shards: dict[int, dict] | None = None

    def __getstate__(self):
        return {"unigram": self.unigram, "blobs": self.blobs, "shards": None}

    def _open(self) -> dict[int, dict]:
        file, spans = tempfile.TemporaryFile(), []
        for blob in self.blobs:
            z = np.load(io.BytesIO(blob))
            parts = {}
            for name in ("low", "high", "zeros", "code", "pointers", "backoff"):
                file.write(b"\0" * (-file.tell() % 8))
                parts[name] = (file.tell(), z[name].dtype, len(z[name]))
                file.write(z[name].tobytes())
            spans.append((int(z["shard"]), int(z["width"]), float(z["least"]), parts))
        file.write(b"\0" * 8)
        file.flush()
        data = np.memmap(file, np.uint8, "r")
        self.shards = {}
        for shard, width, least, parts in spans:
            a = {k: data[o:o + n * t.itemsize].view(t) for k, (o, t, n) in parts.items()}
            self.shards[shard] = {"ef": EliasFano(a["low"], a["high"], a["zeros"], width), "least": least, **a}
        self.blobs = []
        return self.shards

    def log10(self, prev: np.ndarray, after: np.ndarray) -> np.ndarray:
        """log10 p(after | prev) for arrays of ids."""
        shards = self.shards if self.shards is not None else self._open()
        out = self.unigram[after].astype(np.float64)
        part = prev // CONTEXTS
        for shard in np.unique(part).tolist():
            if shard not in shards:
                continue
            s, at = shards[shard], np.flatnonzero(part == shard)
            rel, nxt = prev[at] - shard * CONTEXTS, after[at]
            place = s["ef"].find(rel * (VOCAB + 1) + nxt, s["pointers"][rel].astype(np.int64),
                                 s["pointers"][rel + 1].astype(np.int64))
            known = place >= 0
            out[at] += s["backoff"][rel]
            out[at[known]] = s["code"][place[known]].astype(np.float64) * (s["least"] / (LEVELS - 1))
        return out


def _tokens(block: flat.Block):
    """Word hashes of the block in order of documents, and the number of words of each document."""
    w = flat.words(block)
    return flat.word_hashes(block.data, w.start, w.end), w.counts


def word_counts(docs: DataFrame) -> DataFrame:
    """(code, c): how often each word, and the end, stands in the texts. Tasks send their own sums."""
    def run(batches):
        for batch in batches:
            codes = np.concatenate([np.full(batch.num_rows, END), *(_tokens(b)[0] for b in flat.blocks(batch.column("text")))])
            code, n = np.unique(codes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(n)], ["code", "n"])

    ship_package(docs.sparkSession)
    return docs.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("c"))


class Head:
    """The frequent words and the end by hash: how often each stands in the training texts."""

    def __init__(self, rows: list[tuple[int, int]], ends: int):
        ranked = [(END_CODE, ends)] + [(c, n) for c, n in rows if c != END_CODE]
        codes = np.array([c for c, _ in ranked], np.int64).view(_U)
        order = np.argsort(codes)
        self.codes, self.counts = codes[order], np.array([n for _, n in ranked], np.int64)[order]

    def look(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Known here or not, and place of each hash."""
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return self.codes[at] == codes, at

    def pack(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places (from 1) of frequent words, ``RARE`` for the others, and the hashes of these."""
        known, at = self.look(codes)
        return np.where(known, at + 1, RARE), codes[~known]

    def unpack(self, places: np.ndarray, rare: np.ndarray) -> np.ndarray:
        other = places == RARE
        codes = self.codes[np.maximum(places - 1, 0)]
        codes[other] = rare
        return codes


def sequence(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(previous hash, hash, document) of every token; each text begins after an end and closes with one."""
    after = np.insert(codes, np.cumsum(counts), END)
    return np.concatenate([[END], after[:-1]]), after, np.repeat(np.arange(len(counts)), counts + 1)


def _pair(prev: np.ndarray, after: np.ndarray) -> np.ndarray:
    return flat.mix(flat.mix(prev) * _U(3) + after)


PAIRS, DOCS, STATS = 0, 1, 2
#: kind PAIRS: distinct pairs of a piece of the texts that belong to a shard, each with its count and the documents
#: that hold it. DOCS: the documents of a piece. STATS: what a shard says of all its pairs. Rows of a piece follow
#: each other from ``first`` on.
HASHES, REALS = ("prev_rare", "after_rare"), ("base",)
FIELDS = ("prev", "after", *HASHES, "n", "held", "doc", "times", "total", "kinds", *REALS)
GATHERED = "shard long, kind int, first long, once long, twice long, doc_ids array<long>, " + ", ".join(f"{f} binary" for f in FIELDS)


def _packed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _small(x: np.ndarray) -> bytes:
    """Numbers from 0 on in as few bytes each as the largest takes, all low bytes first; compressed."""
    most = int(x.max()) if len(x) else 0
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
    return _packed(bytes([width]) + np.ascontiguousarray(x, f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes())


def _record(shard: int, kind: int, first: int = 0, once: int = 0, twice: int = 0, doc_ids=None, **arrays) -> dict:
    return {"shard": shard, "kind": kind, "first": first, "once": once, "twice": twice, "doc_ids": doc_ids,
            **{f: None if f not in arrays else _packed(arrays[f].tobytes()) if f in HASHES + REALS else _small(arrays[f]) for f in FIELDS}}


def _field(batch, i: int, name: str) -> np.ndarray:
    """An array of row ``i``."""
    data = batch.column(name)[i].as_buffer()
    data = pa.decompress(data[8:], int.from_bytes(data[:8].to_pybytes(), "little"), codec="zstd")
    if name in HASHES + REALS:
        return np.frombuffer(data, _U if name in HASHES else np.float64)
    width = data[0] if isinstance(data[0], int) else data[0][0]
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, offset=1).reshape(width, -1).T).view(f"<u{width}").ravel().astype(np.int64)


def _previous(batch, i: int) -> np.ndarray:
    """Places of the first words of the pairs of row ``i``: ascending, then those that are not frequent."""
    places = np.cumsum(_field(batch, i, "prev"))
    return np.concatenate([places, np.full(len(_field(batch, i, "prev_rare")), RARE)])


def _batch(records: list[dict]) -> pa.RecordBatch:
    types = {"shard": pa.int64(), "kind": pa.int32(), "first": pa.int64(), "once": pa.int64(), "twice": pa.int64(),
             "doc_ids": pa.list_(pa.int64())}
    names = [*types, *FIELDS]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in records], types.get(k, pa.binary())) for k in names], names)


def _piece(head: Head, shards: int, codes, counts, start: int, doc_ids, train) -> list[dict]:
    """The records of some whole documents: their pairs by shard, and one of the documents themselves."""
    prev, after, doc = sequence(codes, counts)
    key = _pair(prev, after)
    order = np.lexsort((doc, key))
    key, prev, after, doc = key[order], prev[order], after[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]))
    times = np.diff(np.append(first, len(key)))
    key, prev, after, doc = key[first], prev[first], after[first], doc[first]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    held = np.diff(np.append(new, len(key)))
    n = np.add.reduceat(times * train[doc], new)
    key, prev, after = key[new], prev[new], after[new]
    # a frequent word's pairs are dealt by both words; its count is known everywhere, so no shard needs all of them
    frequent = head.look(prev)[0]
    shard = np.where(frequent, key, flat.mix(prev)) % _U(shards)
    known, at = head.look(codes)
    word_doc, end = np.repeat(np.arange(len(counts)), counts), head.counts[head.look(np.array([END]))[1][0]]
    count = np.where(known, head.counts[at], 0)
    base = np.bincount(word_doc[known], np.log10(count[known] + 1.0), len(counts)) + np.log10(end + 1.0)
    seen = np.bincount(word_doc[count > 0], minlength=len(counts)) + (end > 0)
    out = [_record(start % shards, DOCS, start, doc_ids=doc_ids, n=counts + 1, held=seen, base=base)]
    by = np.lexsort((after, prev, ~frequent, shard))
    edges = np.searchsorted(shard[by], np.arange(shards + 1).astype(_U))
    starts = np.append(new, len(doc))
    for i in range(shards):
        mine = by[edges[i]:edges[i + 1]]
        if not len(mine):
            continue
        p, p_rare = head.pack(prev[mine])
        a, a_rare = head.pack(after[mine])
        many = held[mine]
        entry = np.repeat(starts[mine] - np.cumsum(many) + many, many) + np.arange(many.sum())
        out.append(_record(i, PAIRS, start, prev=np.diff(p[p != RARE], prepend=0), after=a, prev_rare=p_rare, after_rare=a_rare, n=n[mine], held=many,
                           doc=doc[entry], times=times[entry]))
    return out


def gathered(docs: DataFrame, head, shards: int) -> DataFrame:
    """All pairs of all texts by shard; ``n`` of each is its count in all training texts. Also documents and statistics.

    ``docs`` has row, doc_id, text and train and is read once. A group has one shard's share of every piece.
    """
    def read(batches):
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            train = batch.column("train").to_numpy(zero_copy_only=False).astype(np.int64)
            codes, counts, size, first, last = [], [], 0, 0, 0

            def piece():
                return _batch(_piece(head.value, shards, np.concatenate(codes), np.concatenate(counts), row + first,
                                     batch.column("doc_id")[first:last].to_pylist(), train[first:last]))

            for block in flat.blocks(batch.column("text")):
                c, n = _tokens(block)
                codes.append(c), counts.append(n)
                size, last = size + len(c), last + len(n)
                if size >= PIECE:
                    yield piece()
                    codes, counts, size, first = [], [], 0, last
            if codes:
                yield piece()
            row += batch.num_rows

    def count(table: pa.Table) -> pa.Table:
        known, kind = head.value, table.column("kind").to_numpy()
        pairs = np.flatnonzero(kind == PAIRS).tolist()
        if pairs:
            get = lambda f: [_field(table, i, f) for i in pairs]
            prev = np.concatenate([known.unpack(_previous(table, i), _field(table, i, "prev_rare")) for i in pairs])
            after = np.concatenate([known.unpack(*x) for x in zip(get("after"), get("after_rare"), strict=True)])
            _, one, which = np.unique(_pair(prev, after), return_index=True, return_inverse=True)
            parts = get("n")
            n = np.bincount(which, np.concatenate(parts)).astype(np.int64)
            context, of = np.unique(prev[one], return_inverse=True)
            total = np.bincount(of, n).astype(np.int64)
            kinds = np.bincount(of, n > 0).astype(np.int64)
            frequent, place = known.look(context)
            own, at = of[which], 0
            fresh: dict[str, list] = {f: [None] * len(kind) for f in ("n", "total", "kinds")}
            for i, size in zip(pairs, map(len, parts), strict=True):
                part = own[at:at + size]
                part = part[~frequent[part]]
                for f, x in (("n", n[which[at:at + size]]), ("total", total[part]), ("kinds", kinds[part])):
                    fresh[f][i] = _small(x)
                at += size
            for i in np.flatnonzero(kind == DOCS).tolist():
                fresh["n"][i] = table.column("n")[i].as_py()
            for f, x in fresh.items():
                table = table.set_column(table.column_names.index(f), f, pa.array(x, pa.binary()))
            more = _batch([_record(table.column("shard")[0].as_py(), STATS, once=int((n == 1).sum()), twice=int((n == 2).sum()),
                                   doc=place[frequent], kinds=kinds[frequent])])
            table = pa.concat_tables([table, pa.Table.from_batches([more])])
        return table

    return docs.mapInArrow(read, GATHERED).groupBy("shard").applyInArrow(count, GATHERED)


def scores(docs: DataFrame, modulus: int = 7) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words (runs without ASCII white space, A-Z lowered) and one end. Counts are those of all documents
    whose crc32(doc_id) mod ``modulus`` is not 2. ``base_score`` is the add-one unigram sum. ``score`` is the sum of
    log10 p(word | word before), over all words and all pairs: (n(pair) - d) / n(before), plus what the discount d has
    taken there times the add-one share of the word; the share alone after a word that is not in the training texts.

    Words with more than 1 / HEAD of all tokens are resolved where a text is read; all others are joined with the
    full counts, so no key of that join is hot. Pairs are dealt to shards as many as the tokens ask for; each shard
    counts its pairs and hands the counts back to the documents that hold them.

    A null or empty text has the end only. Repeated rows get a row each and count each. Without training documents
    all counts are zero. Further columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    counts = stored(word_counts(docs.filter(~held_out("doc_id", modulus))), "word-counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"),
                       F.coalesce(F.sum(F.when(F.col("code") == END_CODE, F.col("c"))), F.lit(0)).alias("ends")).first()
    often = counts.filter(F.col("c") * HEAD > total.n).collect()
    head = spark.sparkContext.broadcast(Head([(r.code, r.c) for r in often], total.ends))
    del often
    below = total.n + total.v + 1
    rows = docs.select("doc_id", "text", (~held_out("doc_id", modulus)).alias("train"))
    table = stored(gathered(rows, head, max(12, total.n // SHARE)), "pairs")
    spark._jvm.System.gc()  # the plan is gone; its shuffle files go with it
    stats = table.filter(F.col("kind") == STATS)
    seldom = stats.agg(F.coalesce(F.sum("once"), F.lit(0)), F.coalesce(F.sum("twice"), F.lit(0))).first()
    discount = min(max(seldom[0] / max(seldom[0] + 2 * seldom[1], 1), 0.1), 0.9)

    def followers(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([pa.array(_field(batch, i, f)) for f in ("doc", "kinds")], ["place", "k"])

    after = stats.select("doc", "kinds").mapInArrow(followers, "place long, k long").groupBy("place").agg(F.sum("k").alias("k")).toArrow()
    kinds_here = np.zeros(len(head.value.codes), np.int64)
    kinds_here[after.column("place").to_numpy()] = after.column("k").to_numpy()
    frequent_kinds = spark.sparkContext.broadcast(kinds_here)

    def run(batches):
        known, kinds_of = head.value, frequent_kinds.value
        for batch in batches:
            for i in range(batch.num_rows):
                start = batch.column("first")[i].as_py()
                prev = _previous(batch, i)
                word, n, held, doc, times = (_field(batch, i, f) for f in ("after", "n", "held", "doc", "times"))
                rare, other = prev == RARE, word == RARE
                before, kinds = (x[np.maximum(prev - 1, 0)] for x in (known.counts, kinds_of))
                before[rare], kinds[rare] = _field(batch, i, "total"), _field(batch, i, "kinds")
                own = np.where(n > 0, (n - discount) / np.maximum(before, 1), 0.0)
                left = np.where(before > 0, discount * kinds / np.maximum(before, 1), 1.0)
                logp = np.log10(own + left * (known.counts[np.maximum(word - 1, 0)] + 1) / below)
                codes = np.zeros(len(prev), np.int64)
                codes[other] = _field(batch, i, "after_rare").view(np.int64)
                of = np.repeat(np.arange(len(prev)), held)
                late = other[of]
                sums = np.bincount(doc[~late], logp[of[~late]] * times[~late])
                has = np.flatnonzero(np.bincount(doc[~late]))
                if len(has):
                    yield pa.RecordBatch.from_arrays([*(pa.array([x], t) for x, t in (
                        (start, pa.int64()), (_small(has), pa.binary()), (_packed(sums[has].tobytes()), pa.binary()))),
                        *(pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()))], names)
                of, doc, times = of[late], doc[late], times[late]
                if len(of):
                    yield pa.RecordBatch.from_arrays([*(pa.nulls(len(of), t) for t in (pa.int64(), pa.binary(), pa.binary())),
                        *(pa.array(x) for x in (start + doc, codes[of], own[of], left[of], times))], names)

    names = ["first", "doc", "base", "row", "rare", "own", "rest", "times"]
    parts = stored(table.filter(F.col("kind") == PAIRS).mapInArrow(
        run, "first long, doc binary, base binary, row long, rare long, own double, rest double, times long"), "parts")
    own = stored(table.filter(F.col("kind") == DOCS).select("first", "doc_ids", "n", "held", "doc", "base"), "docs")
    discard(table)  # by far the largest; what is still needed of it is in ``parts`` and ``own``
    return per_document(parts, own, counts, total.n, below, modulus)


def per_document(parts: DataFrame, own: DataFrame, counts: DataFrame, train_tokens: int, below: int, modulus: int) -> DataFrame:
    """The rows of ``scores``: the sums of ``parts`` for the documents of ``own``. Tokens that are not frequent meet their counts here.

    ``parts`` has, by piece (``first``), the documents with a sum (``doc``, ``base``), or one token of a document (``row``): its hash
    (``rare``), ``own`` and ``rest``, which give its probability own + rest * share, and how often it stands so.
    """
    c = F.coalesce("c", F.lit(0)) + 1
    late = parts.filter("rare IS NOT NULL").join(counts, F.col("rare") == F.col("code"), "left").select(
        "row", (F.col("times") * F.log10(F.col("own") + F.col("rest") * c / F.lit(below))).alias("part"),
        (F.col("times") * F.log10(c)).alias("more"), F.when(F.col("c") > 0, F.col("times")).otherwise(0).alias("also"))
    late = late.groupBy("row").agg(*[F.sum(x).alias(x) for x in ("part", "more", "also")])

    def documents(piece: pa.Table) -> pa.Table:
        """The documents of one piece, with the sums of all shards."""
        at = next(i for i in range(len(piece)) if piece.column("doc_ids")[i].is_valid)
        ids = piece.column("doc_ids")[at].as_py()
        n, held, base = (_field(piece, at, f) for f in ("n", "held", "base"))
        sums = np.zeros(len(ids))
        for i in range(len(piece)):
            if i != at:
                sums[_field(piece, i, "doc")] += _field(piece, i, "base")
        return pa.table([pa.array(piece.column("first")[at].as_py() + np.arange(len(ids))), pa.array(ids, pa.int64()),
                         *map(pa.array, (n, held, base, sums))], ["row", "doc_id", "n_tokens", "seen", "base", "sum"])

    here = own.union(
        parts.filter("rare IS NULL").selectExpr("first", "CAST(NULL AS ARRAY<BIGINT>)", "CAST(NULL AS BINARY)", "CAST(NULL AS BINARY)", "doc", "base"))
    each = here.groupBy("first").applyInArrow(
        documents, "row long, doc_id long, n_tokens long, seen long, base double, sum double")
    none = F.lit(0.0)
    return each.join(late, "row", "left").select(
        "doc_id", held_out("doc_id", modulus).alias("held_out"), "n_tokens",
        (F.col("seen") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", none) - F.col("n_tokens") * F.lit(float(np.log10(below)))).alias("base_score"),
        (F.col("sum") + F.coalesce("part", none)).alias("score"))
