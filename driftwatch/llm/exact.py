"""Exact duplicates by a tree merge of sorted digest runs, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwatch.llm.common import bounded, private, stored, tree_merge


def normalised(text: Column | str) -> Column:
    """Each run of ASCII white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_groups(docs: DataFrame, runs: int = 256, fan_in: int = 16) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after ``normalised``. Partitions emit digest runs, which meet in rounds
    (``tree_merge``); an entry is a SHA-256 digest verified by a second hash and the length. Texts are read
    once and never shuffled.

    Null texts equal the empty text. Of rows that repeat both doc_id and text one stays. A null doc_id
    counts as the largest; a group of such rows only has a null ``keep_id`` and keeps one row. An empty
    table gives an empty result. Further columns of ``docs`` are not read.
    """
    text = normalised("text")
    digests = docs.select("doc_id", text.alias("t")).select(
        "doc_id", F.monotonically_increasing_id().alias("row"), F.unhex(F.sha2("t", 256)).alias("sha"),
        F.xxhash64("t").alias("check"), F.octet_length("t").alias("size"))
    grouped = tree_merge(stored(digests, "digests"), ["sha", "check", "size"], ["doc_id", "row"], runs, fan_in,
                         "digest-runs")
    return grouped.select(
        "doc_id", F.col("first_row.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("first_row.row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts: that of the smallest doc_id.

    Rows are matched by doc_id and digest. Rows that repeat both are the same document; any one of them stays.
    """
    sha, of, other, gone, stays = (private(docs, c) for c in ("_sha", "_sha_of", "_id", "_gone", "_stays"))
    touched = (exact_groups(docs).groupBy(F.col("doc_id").alias(other), F.col("text_sha256").alias(of))
               .agg(F.count_if(~F.col("kept")).alias(gone), F.count_if(F.col("kept")).alias(stays))
               .filter(F.col(gone) > 0))
    marked = docs.withColumn(sha, F.sha2(normalised("text"), 256)).join(
        bounded(stored(touched, "copies")),
        (F.col("doc_id").eqNullSafe(F.col(other))) & (F.col(sha) == F.col(of)), "left")
    single = marked.filter(F.col(gone).isNull())
    repeated = marked.filter(F.col(stays) > 0).dropDuplicates(["doc_id", sha])
    return single.unionByName(repeated).select(*docs.columns)
