"""What each document filter removes in every order of application, by wide packed counters."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwatch.session import ship_package

FIELD = 64         # bits of a counter field; a count of rows never reaches its top bit
LANES = 512        # second level of the sum tree: tasks of one lane are added up together
MANY_PARTS = 512   # parts that a task adds up side by side before it hands them on
REPEAT = "E"       # letter of the filter that looks for an earlier equal text


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions on one text. 200 words, 50 and 2 per cent, the marks."""
    spaced = F.translate(text, "\t\n\u000b\f\r", "     ")
    words = F.array_remove(F.split(spaced, " "), "")
    n = F.size(words)
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


@functools.cache
def orders(letters: str) -> tuple[str, ...]:
    return tuple("".join(p) for p in itertools.permutations(letters))


@functools.cache
def packed_masks(letters: str) -> tuple[int, ...]:
    """For each mask (bit i: fails letter i) a big integer: field o * k + s is 1 if step s of order o removes such a
    document; one more field counts it."""
    k, names = len(letters), orders(letters)
    out = []
    for mask in range(1 << k):
        number = 1 << (FIELD * k * len(names))
        for o, order in enumerate(names):
            s = next((s for s, c in enumerate(order) if mask >> letters.index(c) & 1), None)
            if s is not None:
                number += 1 << (FIELD * (o * k + s))
        out.append(number)
    return tuple(out)


def to_bytes(number: int, letters: str) -> bytes:
    return number.to_bytes(FIELD // 8 * (len(letters) * len(orders(letters)) + 1), "little")


def unpacked(number: int, letters: str) -> tuple[np.ndarray, int]:
    """Removed documents by order and step, and the number of documents."""
    fields = np.frombuffer(to_bytes(number, letters), "<u8").astype(np.int64)
    return fields[:-1].reshape(-1, len(letters)), int(fields[-1])


def masks(docs: DataFrame, labels: DataFrame, letters: str = "ABCDE", part: str = "source") -> DataFrame:
    """(part, mask, good, toxic, n): rows of each text, part, label and outcome, counted.

    Texts are read once; what is shuffled are ids and digests. Equal rows are counted before the first shuffle (by
    id, to meet the labels) and equal texts of one part before the second, where a text's smallest id shows which of
    its rows is the first. A text that a third of all rows have is a few rows there.
    """
    text = F.coalesce("text", F.lit(""))
    tests = text_filters(text)
    bits = [F.when(tests[c], 1 << i).otherwise(0) for i, c in enumerate(letters) if c != REPEAT]
    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                       F.unhex(F.sha2(text, 256)).alias("sha"), functools.reduce(Column.__add__, bits, F.lit(0)).alias("mask"))
    rows = rows.groupBy("doc_id", "part", "sha", "mask").agg(F.count(F.lit(1)).alias("n"))
    known = labels.groupBy(F.col("doc_id").alias("labelled")).agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    rows = rows.join(known, F.col("doc_id") == F.col("labelled"), "left").select(
        F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "n").alias("first"), "part", "sha", "mask", "n",
        F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    groups = rows.groupBy("sha", "part", "good", "toxic", "mask").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
    if REPEAT not in letters:
        return groups.select("part", "mask", "good", "toxic", "n")
    # Rows of a text's smallest id are no repeats; all others are. A group's own smallest id may be that one.
    own = F.struct(F.col("first.last").alias("last"), F.col("first.doc_id").alias("doc_id"))
    least = F.min(own).over(Window.partitionBy("sha"))
    firsts = F.when(own.eqNullSafe(F.col("least")), F.col("first.n")).otherwise(F.lit(0))
    groups = groups.withColumn("least", least).withColumn("firsts", firsts)
    split = F.array(F.struct(F.col("mask"), F.col("firsts").alias("n")),
                    F.struct((F.col("mask") + (1 << letters.index(REPEAT))).alias("mask"), (F.col("n") - F.col("firsts")).alias("n")))
    return (groups.select("part", "good", "toxic", F.inline(F.filter(split, lambda x: x["n"] > 0)))
            .select("part", "mask", "good", "toxic", "n"))


def audit(docs: DataFrame, labels: DataFrame, letters: str = "ABCDE", part: str = "source") -> DataFrame:
    """Every order of the filters ``letters``, step by step: part, filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley; a row per part, order and step, zeros included.

    Each mask of failed filters is a big integer whose fields hold all step outcomes. Tasks add these integers up by
    part (documents, good ones, toxic ones), the sums meet in two levels (``LANES`` tasks, then all), and a part's
    integer is unpacked once. A field has 64 bits, so no count of rows carries into its neighbour. Everything
    reported follows from "removed" and the number of documents: what an order's first filter removes are all that
    fail it, what the last one removes fail nothing else.

    Null texts are empty. A null or empty ``part`` is the part "". Rows that repeat doc_id and text are each counted;
    none of them is an earlier copy of the other. A null doc_id is the largest: it fails E if any row with an id has
    the text, and has no label. Of repeated labels of a document, any with the value 1 counts. No documents give
    no rows. Further columns are not read.
    """
    ship_package(docs.sparkSession)
    kinds = ["docs", "good", "toxic"]

    def add(batches):
        worth, lane, sums = packed_masks(letters), TaskContext.get().partitionId() % LANES, {}
        pack = lambda: pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()), pa.array([lane] * len(sums), pa.int32()),
             *(pa.array([to_bytes(v[i], letters) for v in sums.values()], pa.binary()) for i in range(3))], ["part", "lane", *kinds])
        for batch in batches:
            parts = batch.column("part").dictionary_encode()
            flags = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("good", "toxic")]
            code = ((parts.indices.to_numpy().astype(np.int64) * 4 + flags[0] * 2 + flags[1]) << len(letters)) + batch.column("mask").to_numpy()
            order = np.argsort(code, kind="stable")
            code, first = np.unique(code[order], return_index=True)
            counts = np.add.reduceat(batch.column("n").to_numpy()[order], first) if len(code) else code
            names = parts.dictionary.to_pylist()
            for c, n in zip(code.tolist(), counts.tolist(), strict=True):
                kind, number = c >> len(letters), worth[c & ((1 << len(letters)) - 1)] * n
                held = sums.setdefault(names[kind >> 2], [0, 0, 0])
                held[0] += number
                held[1] += number * (kind >> 1 & 1)
                held[2] += number * (kind & 1)
            if len(sums) > MANY_PARTS:
                yield pack()
                sums.clear()
        if sums:
            yield pack()

    def total(table: pa.Table) -> list[int]:
        return [sum(int.from_bytes(x.as_buffer(), "little") for x in table.column(c)) for c in kinds]

    def meet(table: pa.Table) -> pa.Table:
        return pa.table({"part": table.column("part").slice(0, 1), **{
            c: pa.array([to_bytes(x, letters)], pa.binary()) for c, x in zip(kinds, total(table), strict=True)}})

    def report(table: pa.Table) -> pa.Table:
        names = orders(letters)
        (removed, n), (good, _), (toxic, _) = (unpacked(x, letters) for x in total(table))
        k = len(letters)
        at = np.array([[letters.index(c) for c in order] for order in names])
        by_filter = lambda column: np.array([removed[np.flatnonzero(at[:, column] == i)[0], column] for i in range(k)])
        fails, unique = by_filter(0), by_filter(k - 1)
        shapley = np.array([int(removed[at == i].sum()) for i in range(k)], np.int64)
        size = len(names) * k
        cols = {"kept": n - np.cumsum(removed, 1), "removed": removed, "redundant": fails[at] - removed,
                "unique_fails": unique[at], "good_lost": good, "toxic_lost": toxic, "shapley": shapley[at]}
        return pa.table({
            "part": pa.array(table.column("part").slice(0, 1).to_pylist() * size, pa.string()),
            "filter_order": pa.array([o for o in names for _ in range(k)]),
            "step": pa.array(np.tile(np.arange(1, k + 1), len(names)).astype(np.int32)),
            **{c: pa.array(v.ravel().astype(np.int64)) for c, v in cols.items()}})

    wide = ", ".join(f"{c} binary" for c in kinds)
    lanes = masks(docs, labels, letters, part).mapInArrow(add, f"part string, lane int, {wide}")
    sums = lanes.groupBy("part", "lane").applyInArrow(meet, f"part string, {wide}")
    return sums.groupBy("part").applyInArrow(report, (
        "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
        "good_lost long, toxic_lost long, shapley long"))
