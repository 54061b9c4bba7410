"""Near duplicates: compressed bucket minima (HyperMinHash), banding, corrected estimates, exact verification."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwatch.llm import flat
from driftwatch.llm.common import bounded, private, stored, tree_merge
from driftwatch.session import ship_package

WORDS = 5          # fixed value: words of a shingle
SHARE = 75         # fixed value: per cent of the union that two linked sets share at least
REGISTERS = 128    # buckets of a signature
BAND = 4           # registers of a band; 32 bands miss a pair at 75 % once in 200,000 times
MANTISSA = 10      # bits kept after the leading one of a bucket's minimum
_U = np.uint64


def shingle_sets(block: flat.Block) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every document, one after the other, and how many each has."""
    w = flat.words(block)
    grams, doc = flat.ngrams(flat.word_hashes(block.data, w.start, w.end), w.counts, WORDS)
    return flat.distinct(doc, grams, len(block))


@functools.cache
def _probes(rounds: int = 256) -> np.ndarray:
    """For each round and register the register to borrow from."""
    x = np.arange(rounds * REGISTERS, dtype=_U) + _U(12345)
    return (flat.mix(x * _U(0x9E3779B97F4A7C15)) % _U(REGISTERS)).astype(np.int64).reshape(rounds, REGISTERS)


def registers(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Signatures, one row per document: leading zeros and mantissa bits of the least hash in each bucket.

    The top bits of a hash name its bucket. An empty bucket borrows from others in an order of its own, the
    same for all documents; a document without shingles is all zeros.
    """
    docs, bits = len(counts), 64 - 7
    out = np.zeros((docs, REGISTERS), np.uint16)
    doc = np.repeat(np.arange(docs), counts)
    cell = doc * REGISTERS + (values >> _U(bits)).astype(np.int64)
    least = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, int)
    rest = values[least] & _U((1 << bits) - 1)
    length = np.frexp((rest >> _U(4)).astype(np.float64))[1] + 4          # bits of the number, exact above 2^4
    length = np.clip(length, MANTISSA + 1, bits)
    mantissa = (rest >> (length - MANTISSA - 1).astype(_U)) & _U((1 << MANTISSA) - 1)
    filled = np.zeros((docs, REGISTERS), bool)
    filled.ravel()[cell[least]] = True
    out.ravel()[cell[least]] = (((bits - length) << MANTISSA) + 1 + mantissa.astype(np.int64)).astype(np.uint16)
    d, r = np.nonzero(~filled & (counts > 0)[:, None])
    for source in _probes():
        if not len(d):
            break
        has = filled[d, source[r]]
        out[d[has], r[has]] = out[d[has], source[r[has]]]
        d, r = d[~has], r[~has]
    for x, y in zip(d.tolist(), r.tolist(), strict=True):
        out[x, y] = out[x, np.flatnonzero(filled[x])[0]]
    return out


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimates of signature rows for sets of ``n`` and ``m`` elements, less the expected share of registers
    that agree by chance (the published constant for compressed minima)."""
    same = (a == b).mean(1)
    chance = 0.1699194871597391 * 2.0 ** -MANTISSA * 4 * n * m / np.maximum((n + m) ** 2, 1)
    return (same - chance) / (1 - chance)


def margin(n: np.ndarray) -> np.ndarray:
    """How far below the threshold an estimate may lie without ruling a link out: over 4 deviations."""
    return np.maximum(0.2, 2 / np.sqrt(np.maximum(n, 1)))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, row, n_shingles, set_a, set_b (a digest of the set), sig."""
    def run(batches):
        for batch in batches:
            for block in flat.blocks(batch.column("text")):
                values, counts = shingle_sets(block)
                sums = np.concatenate([np.zeros((1, 2), _U), np.cumsum(np.stack([flat.mix(values + _U(1)), flat.mix(values ^ _U(77))], 1), 0)])
                edges = np.concatenate([[0], np.cumsum(counts)])
                digest = sums[edges[1:]] - sums[edges[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(block.first, len(block)) for c in ("doc_id", "text_key")),
                     pa.array(counts.astype(np.int64)), *(pa.array(digest[:, i].copy().view(np.int64)) for i in (0, 1)),
                     pa.array([x.tobytes() for x in registers(values, counts)], pa.binary())], names)

    schema = "doc_id long, text_key long, n_shingles long, set_a long, set_b long, sig binary"
    names = [p.split()[0] for p in schema.split(", ")]
    ship_package(docs.sparkSession)
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(flat.trimmed(run), schema).withColumn(
        "row", F.monotonically_increasing_id())


def _likely(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b) of rows whose corrected estimate does not rule a link out."""
    def run(batches):
        for batch in batches:
            n, m = (batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("sig_a", "sig_b"))
            keep = estimate(a, b, n, m) >= SHARE / 100 - margin(np.minimum(n, m))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], ["a", "b"])

    side = lambda x: reps.select(F.col("row").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(
        f"100 * least(n_a, n_b) >= {SHARE} * greatest(n_a, n_b)").mapInArrow(flat.trimmed(run), "a long, b long")


def _sets(rows: DataFrame, reps: DataFrame, docs: DataFrame, broadcast_rows: int) -> DataFrame:
    """(row, items): shingle hashes of the asked ``rows``, made again from their texts; a written table."""
    def run(batches):
        for batch in batches:
            for block in flat.blocks(batch.column("text")):
                values, counts = shingle_sets(block)
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(block.first, len(block)),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))], ["row", "items"])

    asked = stored(reps.join(rows.select("row").distinct(), "row").select(
        "row", F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")), "asked")
    texts = docs.select("doc_id", "text").join(
        bounded(asked, broadcast_rows),
        F.col("doc_id").eqNullSafe(F.col("_id")) & F.xxhash64("text").eqNullSafe(F.col("_key")))
    return stored(texts.select("row", "text").mapInArrow(flat.trimmed(run), "row long, items array<long>").dropDuplicates(["row"]), "sets")


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets share enough. Both joins read written tables, so that a set with very many
    partners is a skewed join that can be split."""
    joined = (pairs.join(sets.select(F.col("row").alias("b"), F.col("items").alias("y")), "b")
              .join(sets.select(F.col("row").alias("a"), F.col("items").alias("x")), "a"))
    return joined.filter(f"{100 + SHARE} * size(array_intersect(x, y)) >= {SHARE} * (size(x) + size(y))").select("a", "b")


def _rarest(sets: DataFrame) -> DataFrame:
    """(row, n, item, left): places of a set's rarest shingles from which a link could still follow; a written table.

    Shingles that one set only has are left out: m of a set's n are elsewhere too. The others are ordered by how
    many sets have them, so that a passage of many documents comes last. Two linked sets share at least
    SHARE / (100 + SHARE) of both sizes together; so their first common shingle has at least as many places left
    in either set.
    """
    spread = sets.select("row", F.size("items").alias("n"), F.explode("items").alias("item"))
    shared = spread.groupBy("item").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    place = Window.partitionBy("row").orderBy("c", "item")
    placed = (spread.join(shared, "item").withColumn("place", F.row_number().over(place))
              .withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("row")))
              .withColumn("left", F.col("m") - F.col("place") + 1).filter(f"100 * left >= {SHARE} * n"))
    return stored(placed.select("row", "n", "item", "left"), "rarest")


def _sharing_rare(rarest: DataFrame, labels: DataFrame, hubs: bool) -> DataFrame:
    """Pairs (a, b) with unlike labels that can be linked by where their rarest shingles stand.

    Only pairs with a first common shingle that leaves enough places are formed: those that differ in enough places of
    their own, or share frequent passages only, are never brought together. Of the sets that hold a shingle, those
    outside its commonest label meet the others. With ``hubs`` they meet one of the commonest label only: a first
    pass that gives most of what belongs to one group the same label, so that the full one forms few pairs.
    """
    firsts = rarest.join(labels, "row")
    held = firsts.groupBy("item", "label").agg(F.count(F.lit(1)).alias("c"), F.max_by("row", F.struct("left", "row")).alias("hub"))
    most = held.groupBy("item").agg(F.max_by(F.struct("label", "hub"), F.struct("c", "label")).alias("m"), F.count(F.lit(1)).alias("labels"))
    firsts = firsts.join(most.filter("labels > 1").select("item", "m.label", "m.hub").toDF("item", "most", "hub"), "item")
    firsts = firsts.withColumn("other", F.expr("label <> most"))
    side = lambda x: firsts.select("item", *[F.col(c).alias(f"{c}_{x}") for c in ("row", "label", "n", "left", "other")])
    one, two = side("a").filter("other_a"), side("b")
    if hubs:
        two = firsts.filter("row = hub").select("item", *[F.col(c).alias(f"{c}_b") for c in ("row", "label", "n", "left", "other")])
    return one.join(two, "item").where(
        f"label_a <> label_b AND (row_a < row_b OR NOT other_b) AND 100 * least(n_a, n_b) >= {SHARE} * greatest(n_a, n_b) AND "
        f"{100 + SHARE} * least(left_a, left_b) >= {SHARE} * (n_a + n_b)").select(
        F.least("row_a", "row_b").alias("a"), F.greatest("row_a", "row_b").alias("b")).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(row, label): the smallest row reachable over ``edges`` (a, b), for every row in an edge.

    Each round hangs larger neighbours on a node's smallest, then smaller ones; it ends when all edges point at a
    smallest row. Rounds grow with the logarithm of a component's width. Nothing is collected but a count.
    """
    edges = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.union(least.filter("m < a").select("a", F.col("m").alias("b"))).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        after = stored(small.distinct(), name)
        if edges.exceptAll(after).isEmpty() and after.exceptAll(edges).isEmpty():
            return after.select(F.col("a").alias("row"), F.col("b").alias("label")).union(
                after.select(F.col("b").alias("row"), F.col("b").alias("label"))).distinct()
        edges = after


def joined_labels(labels: DataFrame, more: DataFrame) -> DataFrame:
    """``labels`` (row, label) of components after further edges (a, b): only the edges between labels are worked on."""
    own = lambda x: labels.select(F.col("row").alias(x), F.col("label").alias(f"label_{x}"))
    between = more.join(own("a"), "a", "left").join(own("b"), "b", "left").select(
        F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
    merged = components(between, "merged").select(F.col("row").alias("label"), F.col("label").alias("least"))
    new = more.select(F.col("a").alias("row")).union(more.select("b")).distinct().join(labels, "row", "left_anti")
    return labels.union(new.withColumn("label", F.col("row"))).join(merged, "label", "left").select(
        "row", F.coalesce("least", "label").alias("label"))


def near_groups(docs: DataFrame, broadcast_rows: int = 500_000) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, text_key (xxhash64 of the text), kept.

    Sets are distinct runs of five words (lower case; a shorter text is one run). Equal sets become one
    class first. Each class's registers are cut into bands; classes that share a band meet in a bucket. First each
    one is held against its bucket's smallest member, which joins most of any large group with one pair each. Where a
    bucket's members are still apart, their sets are compared by their rarest shingles, which loses no link. A pair
    is estimated from its registers, and what the estimate cannot rule out is verified on full sets. Texts are read
    three times; only those in question are kept.

    A null or empty text, or one without words, has an empty set and is linked with nothing. Repeated rows are equal
    sets. A null doc_id counts as the largest: a group of such rows alone has a null component_id and
    ``kept`` is true when both are null. Further columns are not read; an empty table gives no rows.
    """
    rows = stored(signatures(docs), "signatures")
    classes = stored(tree_merge(rows.filter("n_shingles > 0").select(
        "doc_id", "row", "text_key", "n_shingles", "set_a", "set_b"),
                                ["n_shingles", "set_a", "set_b"], ["doc_id", "row"], name="classes")
                     .select("doc_id", "row", "text_key", "n_shingles", F.col("first_row.row").alias("rep")), "classes")
    reps = rows.join(classes.filter("row = rep").select("row"), "row", "left_semi")
    reps = stored(reps.select("row", "doc_id", "text_key", "n_shingles", "sig"), "reps")
    width = 2 * BAND
    keys = F.expr(f"transform(sequence(0, {REGISTERS // BAND - 1}), i -> xxhash64(i, substring(sig, i * {width} + 1, {width})))")
    bands = reps.select("row", F.explode(keys).alias("key"))
    hubs = bands.groupBy("key").agg(F.min("row").alias("a"), F.count(F.lit(1)).alias("held")).filter("held > 1")
    members = stored(bands.join(hubs, "key").select("key", F.col("row").alias("b"), "a"), "buckets")
    first = stored(_likely(members.filter("a <> b").select("a", "b").distinct(), reps), "pairs")
    asked = first.select(F.col("a").alias("row")).union(first.select(F.col("b").alias("row")))
    links = stored(_linked(first, _sets(asked, reps, docs, broadcast_rows)), "links")
    labels = components(links)
    placed = members.select("key", F.col("b").alias("row")).join(labels, "row", "left").withColumn(
        "label", F.coalesce("label", "row"))
    mixed = placed.groupBy("key").agg((F.min("label") != F.max("label")).alias("mixed")).filter("mixed").select("key")
    apart = stored(placed.join(mixed, "key").select("row", "label").distinct(), "apart")
    sets = _sets(apart, reps, docs, broadcast_rows)
    rarest, compared = _rarest(sets), first
    for hubs in (True, False):
        pairs = stored(_likely(_sharing_rare(rarest, apart, hubs).join(compared, ["a", "b"], "left_anti"), reps), "pairs")
        more = stored(_linked(pairs, sets), "links")
        if not more.isEmpty():
            labels = stored(joined_labels(labels, more), "labels")
            apart = stored(apart.select("row").join(labels, "row", "left").withColumn("label", F.coalesce("label", "row")), "apart")
        compared = compared.select("a", "b").union(pairs)
    labelled = classes.join(labels.withColumnRenamed("row", "rep"), "rep", "left").select(
        "doc_id", "row", "text_key", "n_shingles", F.coalesce("label", "rep").alias("label"))
    grouped = tree_merge(stored(labelled, "labels"), ["label"], ["doc_id", "row"], name="groups").select(
        "doc_id", "n_shingles", F.col("first_row.doc_id").alias("component_id"), "text_key")
    empty = rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "text_key")
    return grouped.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, broadcast_rows: int = 500_000) -> DataFrame:
    """``docs``, all columns, with one document of each group of near duplicates: that of the smallest doc_id.

    Rows that repeat both doc_id and text stay or go together.
    """
    gone, key = private(docs, "_gone"), private(docs, "_gone_key")
    lost = stored(near_groups(docs).filter("NOT kept").select(
        F.col("doc_id").alias(gone), F.col("text_key").alias(key)).distinct(), "near-copies")
    return docs.join(bounded(lost, broadcast_rows), F.col("doc_id").eqNullSafe(F.col(gone))
                     & (F.xxhash64("text") == F.col(key)), "left_anti")
