"""Language-model scoring with words, pairs and triples: Elias-Fano levels and quantised probabilities per shard."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.llm import flat
from driftwatch.llm.common import discard, held_out, stored
from driftwatch.llm.lm import (END, END_CODE, HEAD, LEVELS, PIECE, RARE, EliasFano, Head, _packed, _pair, _small, _tokens,
                               per_document, sequence, word_counts)

SHARE = 1_000_000  # training tokens a shard gets
DISCOUNT = 0.75    # fixed value: what every count of a pair or triple gives to those not seen
LEAST = -10.0      # fixed value: log10 of the smallest probability or weight that is told apart
START = np.uint64(0xD1B54A32D192ED03)  # stands before the end that a text begins after
_U = np.uint64

TRIPLES, DOCS, PAIRS = 0, 1, 2
#: kind TRIPLES: distinct triples (before, prev, after) of a piece of the texts that belong to a shard, each with its count in
#: training texts and the documents that hold it. DOCS: the documents of a piece. PAIRS: the counts of pairs (hashed, in
#: ``prev_rare``) after words that are spread over shards, as far as a shard needs them.
HASHES, REALS = ("before_rare", "prev_rare", "after_rare"), ("base",)
FIELDS = ("before", "prev", "after", *HASHES, "n", "held", "doc", "times", *REALS)
DEALT = "shard long, kind int, first long, doc_ids array<long>, " + ", ".join(f"{f} binary" for f in FIELDS)
ASKED = "part long, key binary, place binary, shard binary, n binary"
PARTS = ("first long, doc binary, base binary, row long, rare long, own float, rest float, times long, doc_ids array<long>, "
         "n binary, held binary")


class Level(EliasFano):
    """One level of a shard's trie. ``find`` is for many numbers at once, so the level is read through once for them."""

    @staticmethod
    def width_for(universe: int, n: int) -> int:
        return min(EliasFano.width_for(universe, n), 24) if n else 24

    def values(self) -> np.ndarray:
        marks = np.flatnonzero(np.unpackbits(self.high))
        at = np.arange(len(marks))
        return (marks - at) << self.width | self._low(at)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Place of each value, or -1. Equal ones that follow each other are looked up once."""
        own = self.values() if self.read is None else self.read
        self.read = own
        if not len(own) or not len(values):
            return np.full(len(values), -1)
        new = np.flatnonzero(np.diff(values, prepend=values[0] - 1))
        some = values[new]
        at = np.searchsorted(own, some)
        at[own[np.minimum(at, len(own) - 1)] != some] = -1
        return at if len(new) == len(values) else np.repeat(at, np.diff(np.append(new, len(values))))

    read: np.ndarray | None = None


def quantised(p: np.ndarray) -> np.ndarray:
    """Codes of probabilities or weights: equal steps of their logarithm, the last code also for all that is smaller."""
    return np.rint(np.clip(np.log10(np.maximum(p, 1e-300)) / LEAST, 0, 1) * (LEVELS - 1)).astype(np.uint8)


VALUES = 10 ** (np.arange(LEVELS) * LEAST / (LEVELS - 1))


class Shard:
    """The trie of the triples whose middle words belong to a shard.

    Under each middle word are the words after it (pairs) and the words before it (contexts); under a context are the triples, each
    as the place of its last word among the words after the middle one. Ids are those of the shard, ``size`` is above all.
    ``pairs`` has middle * size + last ascending, ``triples`` (middle * size + first) * size + last.
    """

    def __init__(self, size: int, middles: int, pairs, n2, before, kinds, triples, n3):
        first = np.searchsorted(pairs, np.arange(middles) * size)
        self.size, self.first = size, first
        self.pairs, self.own2 = Level.encode(pairs, middles * size), quantised((n2 - DISCOUNT) / before[pairs // size])
        seen = before > 0
        self.seen, self.rest2 = seen, quantised(DISCOUNT * kinds / np.maximum(before, 1))
        new = np.flatnonzero(np.diff(triples // size, prepend=-1))
        contexts = triples[new] // size
        total, many = (np.add.reduceat(n3, new) if len(new) else n3), np.diff(np.append(new, len(triples)))
        self.contexts, self.rest3 = Level.encode(contexts, middles * size), quantised(DISCOUNT * many / total)
        middle, self.context = triples // size // size, np.repeat(np.arange(len(new)), many)
        self.width = int(np.diff(np.append(first, len(pairs))).max(initial=0)) + 1
        place = np.searchsorted(pairs, middle * size + triples % size) - first[middle]
        self.triples = Level.encode(self.context * self.width + place, max(len(new), 1) * self.width)
        self.own3 = quantised((n3 - DISCOUNT) / total[self.context])

    def find(self, before: np.ndarray, middle: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the pairs, contexts and triples of ids in their levels, or -1."""
        pair, context = self.pairs.find(middle * self.size + after), self.contexts.find(middle * self.size + before)
        triple, both = np.full(len(pair), -1), np.flatnonzero((pair >= 0) & (context >= 0))
        triple[both] = self.triples.find(context[both] * self.width + pair[both] - self.first[middle[both]])
        return pair, context, triple

    def weights(self, middle: np.ndarray, pair: np.ndarray, context: np.ndarray, triple: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(own, rest) by places: the probability of the last word is own + rest * share of the word alone."""
        less = np.append(VALUES[self.rest3], 1.0)[context]
        own = np.append(VALUES[self.own2], 0.0)[pair] * less + np.append(VALUES[self.own3], 0.0)[triple]
        return own, np.where(self.seen, VALUES[self.rest2], 1.0)[middle] * less


def _record(shard: int, kind: int, first: int = 0, doc_ids=None, **arrays) -> dict:
    return {"shard": shard, "kind": kind, "first": first, "doc_ids": doc_ids,
            **{f: None if f not in arrays else _packed(arrays[f].tobytes()) if f in HASHES + REALS else _small(arrays[f]) for f in FIELDS}}


def _raw(scalar) -> bytes:
    data = scalar.as_buffer()
    return pa.decompress(data[8:], int.from_bytes(data[:8].to_pybytes(), "little"), codec="zstd", asbytes=True)


def _hashes(table, i: int, name: str) -> np.ndarray:
    return np.frombuffer(_raw(table.column(name)[i]), _U)


def _numbers(table, i: int, name: str) -> np.ndarray:
    data = _raw(table.column(name)[i])
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1).T).view(f"<u{data[0]}").ravel().astype(np.int64)


def _batch(records: list[dict], types: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in records], t) for k, t in types.items()], list(types))


_DEALT = {"shard": pa.int64(), "kind": pa.int32(), "first": pa.int64(), "doc_ids": pa.list_(pa.int64()), **dict.fromkeys(FIELDS, pa.binary())}
_ASKED = {"part": pa.int64(), **dict.fromkeys(("key", "place", "shard", "n"), pa.binary())}
_PARTS = {"first": pa.int64(), "doc": pa.binary(), "base": pa.binary(), "row": pa.int64(), "rare": pa.int64(), "own": pa.float32(),
          "rest": pa.float32(), "times": pa.int64(), "doc_ids": pa.list_(pa.int64()), "n": pa.binary(), "held": pa.binary()}


class Deal:
    """Which shard a triple belongs to: that of its middle word; triples around a word with more than half of ``SHARE`` tokens
    are spread by their first two words, those at the start of a text by all three."""

    def __init__(self, head: Head, shards: int, most: int):
        self.head, self.shards, self.often = head, shards, np.concatenate([[False], head.counts > most])

    def tokens(self, codes: np.ndarray, counts: np.ndarray):
        """Per token: hashes and places of the word, the one before it and the one before that; document; shard; whether spread."""
        prev, after, doc = sequence(codes, counts)
        starts = np.cumsum(counts + 1) - counts - 1
        before = np.concatenate([[START], prev[:-1]])
        before[starts] = START
        known, at = self.head.look(after)
        c = np.where(known, at + 1, RARE)
        b = np.concatenate([c[-1:], c[:-1]])  # every text closes with the end, so the first token has it before
        a = np.concatenate([[RARE], b[:-1]])
        a[starts] = RARE
        two = _pair(before, prev)
        spread = self.often[b]
        at_start = np.zeros(len(doc), bool)
        at_start[starts] = True
        three = _pair(two, after)
        shard = np.where(spread, np.where(at_start, three, two), flat.mix(prev)) % _U(self.shards)
        return (before, prev, after), (a, b, c), doc, three, shard.astype(np.int64), spread


def _piece(deal: Deal, codes, counts, start: int, doc_ids, train) -> list[dict]:
    """The records of some whole documents: their triples by shard, and one of the documents themselves."""
    words, places, doc, key, shard, _ = deal.tokens(codes, counts)
    frequent = places[2] != RARE
    count = np.where(frequent, deal.head.counts[places[2] - 1], 0)
    base = np.bincount(doc[frequent], np.log10(count[frequent] + 1.0), len(counts))
    seen = np.bincount(doc[count > 0], minlength=len(counts))
    order = np.argsort(key, kind="stable")  # a triple's documents stay in order
    key, doc = key[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]))
    times = np.diff(np.append(first, len(key)))
    key, doc, order = key[first], doc[first], order[first]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    held = np.diff(np.append(new, len(key)))
    n = np.add.reduceat(times * train[doc], new)
    at = order[new]
    a, b, c = (x[at] for x in places)
    shard = shard[at]
    by = np.argsort((shard << 42) | (np.where(b == RARE, (1 << 21) - 1, b) << 21) | a)
    edges = np.searchsorted(shard[by], np.arange(deal.shards + 1))
    starts = np.append(new, len(doc))
    out = [_record(start % deal.shards, DOCS, start, doc_ids=doc_ids, n=counts + 1, held=seen, base=base)]
    for i in np.flatnonzero(np.diff(edges)).tolist():
        mine = by[edges[i]:edges[i + 1]]
        token, many = at[mine], held[mine]
        entry = np.repeat(starts[mine] - np.cumsum(many) + many, many) + np.arange(many.sum())
        p, q, r = b[mine], a[mine], c[mine]
        out.append(_record(i, TRIPLES, start, before=q, prev=np.diff(p[p != RARE], prepend=0), after=r, n=n[mine], held=many,
                           before_rare=words[0][token[q == RARE]], prev_rare=words[1][token[p == RARE]],
                           after_rare=words[2][token[r == RARE]], doc=doc[entry], times=times[entry]))
    return out


def _asked(deal: Deal, parts: int, codes, counts, train) -> list[dict]:
    """Pairs after spread words, and which shards need their counts."""
    words, places, doc, _, shard, spread = deal.tokens(codes, counts)
    at = np.flatnonzero(spread)
    key, shard, n, place = _pair(words[1][at], words[2][at]), shard[at], train[doc[at]], places[1][at]
    order = np.lexsort((shard, key))
    key, shard, place, n = key[order], shard[order], place[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (shard[1:] != shard[:-1])])) if len(key) else np.zeros(0, np.int64)
    n = np.add.reduceat(n, new) if len(new) else n
    key, shard, place = key[new], shard[new], place[new]
    part = (key % _U(parts)).astype(np.int64)
    return [{"part": i, "key": _packed(key[m].tobytes()), "place": _small(place[m]), "shard": _small(shard[m]), "n": _small(n[m])}
            for i in range(parts) if len(m := np.flatnonzero(part == i))]


def _pieces(make):
    """A function for mapInArrow that gives ``make`` some whole documents at a time: hashes, counts, first row, ids, training or not."""
    def read(batches):
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            train = batch.column("train").to_numpy(zero_copy_only=False).astype(np.int64)
            codes, counts, size, first, last = [], [], 0, 0, 0

            def piece():
                return make(np.concatenate(codes), np.concatenate(counts), row + first, batch.column("doc_id")[first:last].to_pylist(),
                            train[first:last])

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

    return read


def _answered(table: pa.Table) -> pa.Table:
    """Counts of one part of the pairs, one record for each shard that needs some; and the words with how many follow them."""
    rows = range(len(table))
    key = np.concatenate([_hashes(table, i, "key") for i in rows])
    place, shard, n = (np.concatenate([_numbers(table, i, f) for i in rows]) for f in ("place", "shard", "n"))
    pairs, one, which = np.unique(key, return_index=True, return_inverse=True)
    total = np.bincount(which, n).astype(np.int64)
    kinds = np.bincount(place[one][total > 0])
    middle = np.flatnonzero(kinds)
    out = [_record(-1, PAIRS, prev=middle, n=kinds[middle])]
    asked = np.unique(shard * len(pairs) + which)
    to, pair = asked // len(pairs), asked % len(pairs)
    edges = np.flatnonzero(np.diff(to, prepend=-1, append=-1))
    for s, e in zip(edges, edges[1:]):
        out.append(_record(int(to[s]), PAIRS, prev_rare=pairs[pair[s:e]], n=total[pair[s:e]]))
    return pa.Table.from_batches([_batch(out, _DEALT)])


def _scored(table: pa.Table, deal: Deal, kinds_of: np.ndarray, below: int) -> pa.Table:
    """Builds a shard's trie from its training triples and gives the sums of its frequent words, and its other tokens one by one."""
    head, size0 = deal.head, len(deal.head.codes) + 1
    kind, first = table.column("kind").to_numpy(), table.column("first").to_numpy()
    out = [{**dict.fromkeys(_PARTS), "first": first[i], "base": table.column("base")[i].as_py(), "doc_ids": table.column("doc_ids")[i].as_py(),
            "n": table.column("n")[i].as_py(), "held": table.column("held")[i].as_py()} for i in np.flatnonzero(kind == DOCS).tolist()]
    rows = np.flatnonzero(kind == TRIPLES).tolist()
    batches = [_batch(out, _PARTS)]
    if not rows:
        return pa.Table.from_batches(batches)
    others = {f: [_hashes(table, i, f + "_rare") for i in rows] for f in ("before", "prev", "after")}
    rare = np.sort(np.concatenate([*others["before"], *others["prev"], *others["after"]]))
    rare = rare[np.concatenate([[True], rare[1:] != rare[:-1]])] if len(rare) else rare

    def ids(f: str) -> np.ndarray:
        each = [np.concatenate([np.cumsum(x := _numbers(table, i, f)) if f == "prev" else _numbers(table, i, f),
                                np.zeros(len(others[f][k]) if f == "prev" else 0, np.int64)]) for k, i in enumerate(rows)]
        x = np.concatenate(each)
        x[x == RARE] = size0 + np.searchsorted(rare, np.concatenate(others[f]))
        lengths.append([len(e) for e in each])
        return x

    lengths: list[list[int]] = []
    before, middle, after = (ids(f) for f in ("before", "prev", "after"))
    n, size = np.concatenate([_numbers(table, i, "n") for i in rows]), size0 + len(rare)
    code = np.concatenate([[_U(0)], head.codes, rare])
    here = np.zeros(size, bool)
    here[middle] = True
    middles, middle = np.flatnonzero(here), (np.cumsum(here) - 1)[middle]
    spread = np.zeros(len(middles), bool)
    frequent = np.flatnonzero(middles < size0)
    spread[frequent] = deal.often[middles[frequent]]
    use = np.flatnonzero((n > 0) | spread[middle])
    pairs, which = np.unique(middle[use] * size + after[use], return_inverse=True)
    n2 = np.bincount(which, n[use], len(pairs)).astype(np.int64)
    far = np.flatnonzero(spread[pairs // size])
    if len(far):
        told = np.flatnonzero(kind == PAIRS).tolist()
        keys, counts = np.concatenate([_hashes(table, i, "prev_rare") for i in told]), np.concatenate([_numbers(table, i, "n") for i in told])
        order = np.argsort(keys)
        at = np.searchsorted(keys, _pair(code[middles[pairs[far] // size]], code[pairs[far] % size]), sorter=order)
        n2[far] = counts[order[at]]
    pair, context, triple = (np.full(len(n), -1) for _ in range(3))
    pair[use] = np.where(n2 > 0, np.cumsum(n2 > 0) - 1, -1)[which]
    asked = np.flatnonzero(n == 0)
    pairs, n2 = pairs[n2 > 0], n2[n2 > 0]
    total, kinds = np.bincount(pairs // size, n2, len(middles)), np.bincount(pairs // size, minlength=len(middles))
    total[spread], kinds[spread] = head.counts[middles[spread] - 1], kinds_of[middles[spread]]
    use = np.flatnonzero((n > 0) & (code[before] != START))
    triples, which = np.unique((middle[use] * size + before[use]) * size + after[use], return_inverse=True)
    n3 = np.bincount(which, n[use], len(triples)).astype(np.int64)
    trie = Shard(size, len(middles), pairs, n2, total, kinds, triples, n3)
    triple[use], context[use] = which, trie.context[which]  # what was counted here has its place already
    pair[asked], context[asked], triple[asked] = trie.find(before[asked], middle[asked], after[asked])
    own, rest = trie.weights(middle, pair, context, triple)
    logp = np.log10(own + rest * (head.counts[np.minimum(after, size0 - 1) - 1] + 1) / below)
    at = 0
    for i, many in zip(rows, lengths[0], strict=True):
        held, doc, times = (_numbers(table, i, f) for f in ("held", "doc", "times"))
        of = np.repeat(np.arange(at, at + many), held)
        late = after[of] >= size0
        sums = np.bincount(doc[~late], logp[of[~late]] * times[~late])
        has = np.flatnonzero(np.bincount(doc[~late]))
        if len(has):
            batches.append(_batch([{**dict.fromkeys(_PARTS), "first": first[i], "doc": _small(has), "base": _packed(sums[has].tobytes())}], _PARTS))
        of, doc, times = of[late], doc[late], times[late]
        if len(of):
            given = {"row": first[i] + doc, "rare": code[after[of]].view(np.int64), "own": own[of].astype(np.float32),
                     "rest": rest[of].astype(np.float32), "times": times}
            batches.append(pa.RecordBatch.from_arrays([pa.array(given[k], t) if k in given else pa.nulls(len(of), t) for k, t in _PARTS.items()],
                                                      list(_PARTS)))
        at += many
    return pa.Table.from_batches(batches)


def scores(docs: DataFrame, modulus: int = 7) -> DataFrame:
    """One row per document, with the columns of ``lm.scores``; ``score`` is that of a model of words, pairs and triples.

    p(c | a, b) = (n(abc) - d) / n(ab) + d * kinds(ab) / n(ab) * p(c | b), the same for p(c | b) over the add-one share of c; a term
    with a count of 0 falls away, and after a context without training tokens the next shorter one decides. The first word of a
    text has only the end before it. Each of the four weights is quantised to ``LEVELS`` steps of its logarithm.

    Triples are dealt by their middle word, so a shard has the pairs and contexts of its triples with them; it builds its trie and
    looks up all its triples, held-out ones too. Around a very frequent word triples are spread over shards; the counts of the
    pairs after it are summed beforehand and sent to the shards that need them. Words with less than 1 / HEAD of all tokens are
    joined with their counts at the end. All triples of one context must fit a task.
    """
    spark = docs.sparkSession
    counts = stored(word_counts(docs.filter(~held_out("doc_id", modulus))), "word-counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"),
                       F.coalesce(F.sum(F.when(F.col("code") == END_CODE, F.col("c"))), F.lit(0)).alias("ends")).first()
    often = counts.filter(F.col("c") * HEAD > total.n).collect()
    head = Head([(r.code, r.c) for r in often], total.ends)
    del often
    below, shards = total.n + total.v + 1, max(12, total.n // SHARE)
    deal = spark.sparkContext.broadcast(Deal(head, shards, SHARE // 2))
    rows = docs.select("doc_id", "text", (~held_out("doc_id", modulus)).alias("train"))
    kinds, spread = np.zeros(len(head.codes) + 1, np.int64), int(head.counts[head.counts > SHARE // 2].sum())
    dealt = rows.mapInArrow(_pieces(lambda *x: _batch(_piece(deal.value, *x), _DEALT)), DEALT)
    answers = None
    if spread:
        parts = max(4, spread // SHARE)
        asked = rows.mapInArrow(_pieces(lambda codes, n, _, ids, train: _batch(_asked(deal.value, parts, codes, n, train), _ASKED)), ASKED)
        answers = stored(asked.groupBy("part").applyInArrow(_answered, DEALT), "pairs")
        spark._jvm.System.gc()  # the plan is gone; its shuffle files go with it

        def followers(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    yield pa.RecordBatch.from_arrays([pa.array(_numbers(batch, i, f)) for f in ("prev", "n")], ["place", "k"])

        after = answers.filter("shard < 0").select("prev", "n").mapInArrow(followers, "place long, k long").groupBy("place").agg(
            F.sum("k").alias("k")).toArrow()
        kinds[after.column("place").to_numpy()] = after.column("k").to_numpy()
        dealt = dealt.union(answers.filter("shard >= 0"))
    kinds_of = spark.sparkContext.broadcast(kinds)
    found = stored(dealt.groupBy("shard").applyInArrow(lambda t: _scored(t, deal.value, kinds_of.value, below), PARTS), "parts")
    spark._jvm.System.gc()
    if answers is not None:
        discard(answers)
    own = found.filter("doc_ids IS NOT NULL").select("first", "doc_ids", "n", "held", "doc", "base")
    return per_document(found.filter("doc_ids IS NULL"), own, counts, total.n, below, modulus)
