"""Feature, result, baseline, snapshot, alert and report tables.

Tables are Parquet partitioned by day, week or version. Rows replace those of the same person
and partition; rows of other people stay, whether a job writes a whole day or a part of it. A
repeated job never doubles rows. Reads by date range prune partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwatch.config import DAY, FEATURES, KEY
from driftwatch.session import work_folder

FEATURE_SCHEMA = T.StructType(
    [T.StructField(DAY, T.DateType())] + [T.StructField(f, T.DoubleType()) for f in FEATURES]
    + [T.StructField("missing_count", T.IntegerType()), T.StructField("data_quality", T.StringType())])


# ---- feature table -------------------------------------------------------

def read_features_csv(spark: SparkSession, path: str, person: str | None = None) -> DataFrame:
    """Feature files, one per person: ``<person>/features.csv``; empty fields are NULL."""
    df = spark.read.schema(FEATURE_SCHEMA).option("header", True).csv(path)
    who = F.lit(person) if person else F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+\.csv$", 1)
    return df.select(who.alias(KEY), *FEATURE_SCHEMA.names)


def one_row_per_day(df: DataFrame) -> DataFrame:
    """Collapse days written more than once; the most complete, then largest row wins.

    A combined aggregate, so a day repeated any number of times is no hot group.
    """
    others = [c for c in df.columns if c not in (KEY, DAY)]
    full = F.col("missing_count") if "missing_count" in others else F.lit(0)
    return (df.groupBy(KEY, DAY).agg(F.max(F.struct((-full).alias("_rank"), *others)).alias("_r"))
            .select(KEY, DAY, *[F.col("_r")[c].alias(c) for c in others]))


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(place) and any(not s.getPath().getName().startswith(("_", ".")) for s in fs.listStatus(place))


def _replace(df: DataFrame, path: str, part: str, asked: Sequence | None = None) -> None:
    """Write ``df`` by ``part``, replacing rows of the same person and part.

    The new rows are written aside once; stored rows of the touched parts that no new row
    replaces are read and written with them. The touched parts are few (days, weeks or versions) and
    go into the filter by value, so no other partition is read. ``asked`` names parts that the job has worked
    out for everyone: all their stored rows go, also where nothing came.

    One job at a time may write a part; ``changes`` has tables for several.
    """
    spark = df.sparkSession
    aside = work_folder(spark, "rows")
    df.write.parquet(aside)
    fresh = out = spark.read.parquet(aside)
    came = [r[0] for r in fresh.select(part).distinct().collect()]
    if _exists(spark, path) and came:
        old = spark.read.parquet(path).filter(F.col(part).isin(came))
        kept = old.join(fresh.select(KEY, part).distinct(), [KEY, part], "left_anti")
        if asked is not None:
            kept = kept.filter(~F.col(part).isin(list(asked)))
        out = fresh.unionByName(kept, allowMissingColumns=True)
    (out.hint("rebalance", part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(part).parquet(path))
    for value in {str(a) for a in asked or ()} - {str(c) for c in came}:
        _delete(spark, f"{path}/{part}={value}")
    _delete(spark, aside)


def _delete(spark: SparkSession, folder: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def save_daily(df: DataFrame, path: str, days: Sequence | None = None) -> None:
    """Write rows by day; rows of the same person and day are replaced, the others stay.

    ``days``: the days this job has worked out for everyone. Their stored rows go even where
    the job gives none, so a withdrawn alert does not stay. Large days are split among tasks.
    """
    _replace(df, path, DAY, days)


def save_daily_features(df: DataFrame, path: str, days: Sequence | None = None) -> None:
    save_daily(df.select(KEY, DAY, *FEATURES, "missing_count", "data_quality"), path, days)


def save_daily_results(df: DataFrame, path: str, days: Sequence | None = None) -> None:
    save_daily(df, path, days)


def read_daily(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def between(df: DataFrame, start, end, person=None, must_exist: bool = False) -> DataFrame:
    """Rows of an inclusive date range; optionally raise if there are none."""
    out = df.filter(F.col(DAY).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if person is not None:
        out = out.filter(F.col(KEY) == F.lit(person))
    if must_exist and out.isEmpty():
        raise ValueError(f"no rows between {start} and {end}")
    return out


def on_day(df: DataFrame, day, person=None) -> DataFrame:
    return between(df, day, day, person)


def last_days(df: DataFrame, n: int, until=None) -> DataFrame:
    """The last ``n`` rows of each person up to ``until``, oldest first within a person."""
    if until is not None:
        df = df.filter(F.col(DAY) <= F.lit(until).cast("date"))
    newest = Window.partitionBy(KEY).orderBy(F.col(DAY).desc())
    return (df.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= n).drop("_r")
            .sortWithinPartitions(KEY, DAY))


# ---- baselines -----------------------------------------------------------

def append_baselines(df: DataFrame, path: str) -> None:
    """Add baseline versions; a person's version that is written again replaces itself.

    Versions are partitions, so reading one of them skips the weights of all others. The day of
    a person's first training goes with every version.
    """
    if "train_date" in df.columns and "first_train_date" not in df.columns:
        df = df.withColumn("first_train_date", F.col("train_date"))
    _replace(df, path, "version")


def read_baselines(spark: SparkSession, path: str, version: int | None = None, back: int = 0) -> DataFrame:
    """One baseline per person: a given version, or ``back`` versions before the newest."""
    df = spark.read.parquet(path)
    if version is not None:
        return df.filter(F.col("version") == version)
    newest = Window.partitionBy(KEY).orderBy(F.col("version").desc())
    return df.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") == 1 + back).drop("_r")


# ---- alerts, reports, documents -----------------------------------------

def append_alerts(df: DataFrame, path: str, days: Sequence | None = None) -> None:
    save_daily(df, path, days)


def save_reports(df: DataFrame, path: str) -> None:
    """Report rows keyed by person and week; a person's week written again is replaced."""
    _replace(df.select(KEY, "week_start", "week_end", "report"), path, "week_start")


def result_documents(results: DataFrame) -> DataFrame:
    """One JSON document per result row."""
    return results.select(KEY, DAY, F.to_json(F.struct(*results.columns), {"ignoreNullFields": "false"}).alias("document"))


def feature_weights(spark: SparkSession, path: str) -> dict[str, float]:
    """Weights from a JSON object file in feature order; names it lacks weigh 1.0.

    The file is configuration of a fixed size: one row with ten numbers.
    """
    schema = T.StructType([T.StructField(f, T.DoubleType()) for f in FEATURES])
    row = spark.read.schema(schema).option("multiLine", True).json(path).first()
    return {f: 1.0 if row is None or row[f] is None else row[f] for f in FEATURES}


# ---- snapshots -----------------------------------------------------------

SNAPSHOT_SCHEMA = T.StructType([
    T.StructField(DAY, T.DateType()), T.StructField(KEY, T.StringType()), T.StructField("timestamp", T.TimestampType()),
    T.StructField("acoustic_data", T.StructType([
        T.StructField(f, T.DoubleType()) for f in ("sad_ratio", "avg_speed", "pitch_variability", "distress_events")])),
    T.StructField("statistics", T.StructType([
        T.StructField("n_utterances", T.LongType()), T.StructField("total_duration", T.DoubleType())]))])


def read_snapshot_json(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot documents, flattened; fields of older files that are not listed are ignored."""
    df = spark.read.schema(SNAPSHOT_SCHEMA).option("multiLine", True).json(path)
    return df.select(KEY, DAY, F.col("timestamp").alias("ts"), "acoustic_data.*", "statistics.*")


def save_snapshots(df: DataFrame, path: str) -> None:
    save_daily(df, path)
