"""The speech front end as Structured Streaming queries.

Event time is the chunk's time plus the offset inside the chunk. Late rows are bounded by a
watermark instead of by the next arrival; how many were dropped is in the query progress.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from driftwatch.config import DAY, KEY
from driftwatch.operators.acoustic import features_from_sums, utterance_measures
from driftwatch.session import work_folder
from driftwatch.streaming import stateful

SNAPSHOT_SECONDS = 1800  # fixed value: pause between snapshots
LATE = "1 hour"


def with_event_time(chunks: DataFrame, chunk_ts: str = "chunk_ts", offset: str = "start_sec") -> DataFrame:
    """``ts`` = chunk time + offset in seconds."""
    us = F.unix_micros(chunk_ts) + F.round(F.coalesce(offset, F.lit(0.0)) * 1_000_000).cast("long")
    return chunks.withColumn("ts", F.timestamp_micros(us))


def sliding_features(utterances: DataFrame, window: str = "24 hours", slide: str = "30 minutes",
                     late: str = LATE, digits: bool = True) -> DataFrame:
    """Acoustic features per person and sliding window, on a stream or a table.

    Rows are first added up into panes of one slide. Only panes, not rows, are then copied
    into the windows that hold them (48 at the default). On a table panes are dealt out and windows are made after
    that. A stream's state is a row per open pane, and a value per person with the closed panes that windows to come
    still reach (``stateful.sliding_windows``, which needs the RocksDB state store).
    """
    sums = utterance_measures()
    panes = (utterances.withWatermark("ts", late)
             .groupBy(F.window("ts", slide).alias("pane"), KEY).agg(*[F.sum(e).alias(n) for n, e in sums.items()]))
    span, step = _micros(utterances, window), _micros(utterances, slide)
    if utterances.isStreaming and not span % step:
        wide = stateful.sliding_windows(panes, span, step)
    elif span % step:
        wide = (panes.groupBy(F.window(F.window_time("pane"), window, slide).alias("w"), KEY)
                .agg(*[F.sum(n).alias(n) for n in sums]))
    else:
        wide = _windows_of_panes(panes, list(sums), span, step)
    return wide.select(KEY, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                       *features_from_sums(digits))


def _windows_of_panes(panes: DataFrame, sums: list[str], span: int, step: int) -> DataFrame:
    """The windows of a table's panes: ``w`` and the sums. Only panes are dealt out, by person, a row each.

    A window's panes change where one comes in and where one goes out, a window later. From one change to the next all
    windows hold the same panes, so these are added up once a change, and the windows are written out at the end.
    """
    ends = panes.select(KEY, F.unix_micros("pane.end").alias("_end"), *sums).repartition(KEY)
    changes = ends.select(KEY, *sums, F.explode(F.array(
        F.struct(F.col("_end").alias("at"), F.lit(True).alias("comes")),
        F.struct((F.col("_end") + span).alias("at"), F.lit(False).alias("comes")))).alias("_c"))
    changes = changes.groupBy(KEY, F.col("_c.at").alias("_at")).agg(
        *[F.max(F.when(F.col("_c.comes"), F.col(n))).alias(n) for n in sums])
    order = Window.partitionBy(KEY).orderBy("_at")
    held = changes.select(KEY, "_at", (F.lead("_at").over(order) - step).alias("_to"), *[
        F.sum(n).over(order.rangeBetween(1 - span, Window.currentRow)).alias(n) for n in sums])
    windows = held.filter(F.col(sums[0]).isNotNull()).select(KEY, *sums, F.explode(F.sequence("_at", "_to", F.lit(step))).alias("_at"))
    at = lambda us: F.timestamp_micros(F.col("_at") - us)
    return windows.select(KEY, *sums, F.struct(at(span).alias("start"), at(0).alias("end")).alias("w"))


def _micros(df: DataFrame, length: str) -> int:
    """A fixed length of time as a number."""
    at = F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {length}")
    return df.sparkSession.range(1).select(F.unix_micros(at)).first()[0]


def counters(chunks: DataFrame, utterances: str = "utterances") -> DataFrame:
    """Chunks, utterances and seconds heard per person; works on a stream (complete or update)."""
    return chunks.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("chunks"), F.sum(F.size(utterances)).alias("utterances"),
        F.sum(F.aggregate(utterances, F.lit(0.0), lambda a, u: a + F.coalesce(u["duration_sec"], F.lit(0.0))))
        .alias("seconds"))


def late_rows(query: StreamingQuery) -> int:
    """Rows of the recent progress reports that came after the watermark."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)


class LateCounter(StreamingQueryListener):
    """Rows that the watermark has dropped, by query name, from all progress reports (not only the recent ones)."""

    def __init__(self) -> None:
        self.dropped: Counter[str] = Counter()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.dropped[event.progress.name or str(event.progress.id)] += sum(
            op.numRowsDroppedByWatermark for op in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def split_late(stream: DataFrame, path: str, checkpoint: str, at: str = "ts", late_seconds: int = 3600,
               **trigger) -> StreamingQuery:
    """Write rows in time to ``path``/on_time and rows behind the watermark to ``path``/late, by batch.

    The watermark is the largest instant of the batches before, less ``late_seconds``. It is written beside the rows
    (``path``/seen), one row a batch. A windowed query drops by the watermark that the batch before had, so all it drops
    is in quarantine here, to be looked at or run again, and no row is lost. A repeated batch replaces its own folders.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark, limit = batch.sparkSession, None
        if number:
            seen = spark.read.schema("top long, batch long").parquet(f"{path}/seen")
            limit = seen.filter(F.col("batch") < number).agg(F.max("top")).first()[0]
        us = F.unix_micros(at)
        behind = F.coalesce(us < F.lit(limit) - late_seconds * 1_000_000, F.lit(False)) if limit is not None else F.lit(False)
        rows = batch.withColumn("_late", behind)
        for name, kept in (("on_time", rows.filter("NOT _late")), ("late", rows.filter("_late"))):
            kept.drop("_late").write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        (batch.agg(F.max(us).alias("top")).withColumn("batch", F.lit(number).cast("long")).coalesce(1)
              .write.mode("overwrite").parquet(f"{path}/seen/part={number}"))

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": f"{SNAPSHOT_SECONDS} seconds"})).start())


# ---- sinks ---------------------------------------------------------------

def append_history(snapshots: DataFrame, path: str, checkpoint: str, at: str = "window_end", **trigger) -> StreamingQuery:
    """Append every snapshot to Parquet partitioned by day, exactly once."""
    return (snapshots.withColumn(DAY, F.to_date(at)).writeStream.format("parquet").outputMode("append")
            .partitionBy(DAY).option("path", path).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": f"{SNAPSHOT_SECONDS} seconds"})).start())


def keep_latest(snapshots: DataFrame, path: str, checkpoint: str, at: str = "ts", **trigger) -> StreamingQuery:
    """Write each batch's last snapshot per person and day under its day and batch number.

    A repeated batch replaces its own folders, so nothing is written twice and nothing that is
    being read is overwritten; ``read_latest`` lets the last write of a day win.
    """
    def write(batch: DataFrame, number: int) -> None:
        values = [c for c in batch.columns if c != KEY]
        (batch.groupBy(KEY, F.to_date(at).alias(DAY)).agg(F.max_by(F.struct(*values), at).alias("s"))
              .select(KEY, DAY, "s.*", F.lit(number).alias("batch"))
              .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY, "batch").parquet(path))

    return (snapshots.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": f"{SNAPSHOT_SECONDS} seconds"})).start())


def read_latest(spark: SparkSession, path: str, at: str = "ts", first=None, last=None) -> DataFrame:
    """One snapshot per person and day from the folders of ``keep_latest``; only those of the days asked are read."""
    df = spark.read.parquet(path)
    for day, keep in ((first, F.col(DAY) >= F.lit(first).cast("date")), (last, F.col(DAY) <= F.lit(last).cast("date"))):
        df = df.filter(keep) if day is not None else df
    values = [c for c in df.columns if c not in (KEY, DAY, "batch")]
    return df.groupBy(KEY, DAY).agg(F.max_by(F.struct(*values), F.struct(at, "batch")).alias("s")).select(
        KEY, DAY, "s.*")


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all data now available and return what it appended, as a table."""
    spark = stream.sparkSession
    root = work_folder(spark, name)
    q = (stream.writeStream.format("parquet").outputMode("append").option("path", f"{root}/out")
         .option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")
