"""Small helpers of the text operators: written intermediates, row numbers, digests, text folding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwatch.session import ship_package
from driftwatch.streaming.live import work_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the cluster's shared folder and read back; the lineage ends there.

    A lost executor then costs a re-read, not the work before. The folder goes when the driver's
    JVM ends.
    """
    spark = ship_package(df.sparkSession)
    folder = work_folder(spark, name)
    df.write.parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.parquet(folder)


def discard(table: DataFrame) -> None:
    """Delete the files of a ``stored`` table that nothing reads any more, before the driver ends."""
    spark = table.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded(table: DataFrame, rows: int = 200_000) -> DataFrame:
    """A written ``table`` marked for broadcast if it is counted and has ``rows`` rows at most; else as it is."""
    return F.broadcast(table) if table.count() <= rows else table


def private(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the case (extra columns may clash)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def lowered(text: Column | str) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def held_out(doc_id: Column | str, modulus: int, remainder: int = 2) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % modulus == remainder


def tree_merge(rows: DataFrame, keys: list[str], order: list[str], runs: int = 256, fan_in: int = 16,
               name: str = "runs") -> DataFrame:
    """Each row of ``rows`` with ``first_row`` (smallest ``order`` of the rows with its keys) and ``group_size``.

    Rows are dealt into ``runs`` by a hash of ``order``; a run holds one entry per key. In each round
    ``fan_in`` runs meet and are merged by key, each keeping its smallest entry, until one run per key is
    left; then the winner travels back down the same tree. No step brings more than ``fan_in`` entries of a
    key together (the first: one key's share of one run, already combined map-side), so a key that holds a
    third of all rows costs no more than any other. The smallest entry has nulls last.

    ``rows`` is read more than once: give a written table.
    """
    run, first, size, level = "_run", "first_row", "group_size", "_level"
    smallest = F.min(F.struct(F.col(order[0]).isNull().alias("_null"), *order))
    dealt = rows.withColumn(run, F.pmod(F.xxhash64(*order), F.lit(runs)).cast("int"))
    levels = [dealt.groupBy(run, *keys).agg(smallest.alias(first), F.count(F.lit(1)).alias(size))]
    width = runs
    while width > 1:
        width = -(-width // fan_in)
        below = levels[-1] = stored(levels[-1], f"{name}-{len(levels)}")
        levels.append(below.groupBy((F.col(run) / fan_in).cast("int").alias(run), *keys)
                      .agg(F.min(first).alias(first), F.sum(size).alias(size)))
    top = levels.pop()
    while levels:
        below = levels.pop().select(F.col(run).alias(level), *[F.col(k).alias(f"_{k}") for k in keys])
        on = [(F.col(level) / fan_in).cast("int") == F.col(run)] + [F.col(f"_{k}").eqNullSafe(F.col(k)) for k in keys]
        joined = below.join(top, on)
        top = joined.select(F.col(level).alias(run), *keys, first, size)
    winners = top.select(F.col(run).alias(level), *[F.col(k).alias(f"_{k}") for k in keys], first, size)
    on = [F.col(run) == F.col(level)] + [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return dealt.join(winners, on).drop(run, level, *[f"_{k}" for k in keys])
