"""Sensor-like views of the event and conversation tables.

An event stands for one utterance, motion event or waveform sample of a person.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwatch.config import DAY, KEY
from driftwatch.functions.text import deviation


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with a zoned timestamp, person, day and the ``k`` property."""
    return with_event_columns(table(spark, folder, "events"))


def with_event_columns(df: DataFrame) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return df.select(
        F.col("user_id").alias(KEY), "event_id", ts.alias("ts"), F.to_date(ts).alias(DAY), "event_type", "value",
        F.get_json_object("props", "$.k").cast("double").alias("k"))


def utterances(ev: DataFrame) -> DataFrame:
    """One speech utterance per event."""
    emotion = (F.when(F.col("event_type") == "error", "sad").when(F.col("event_type") == "purchase", "happy")
                .when(F.col("event_type") == "click", "angry").when(F.col("event_type") == "signup", "fearful")
                .otherwise("neutral"))
    return ev.select(KEY, "event_id", "ts", DAY, (F.col("value") / 10.0).alias("duration_sec"),
                     emotion.alias("emotion"), (F.col("k") / 12.5).alias("speech_rate"),
                     (F.col("k") + 120.0).alias("pitch_mean"))


def batch_utterances(ev: DataFrame) -> DataFrame:
    """Utterances with emotion probabilities on every other event and sound labels."""
    sound = (F.when(F.col("k") < 10, "cry").when(F.col("k") < 20, "sigh").when(F.col("k") < 30, "laugh"))
    probs = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("sad"), F.col("k") / 100.0))
    return ev.select(
        KEY, "event_id", DAY, (F.col("value") / 10.0).alias("duration_sec"),
        F.when(F.col("event_type") == "error", "sad").otherwise("neutral").alias("emotion"),
        probs.alias("emotion_probs"), sound.alias("non_verbal"),
        F.when(F.col("k") % 7 != 0, F.col("k") / 12.5).alias("speech_rate"),
        F.when(F.col("k") % 5 != 0, F.col("k") + 120.0).alias("pitch_mean"))


def sounds(ev: DataFrame) -> DataFrame:
    """Non-verbal events: one per error."""
    return ev.filter(F.col("event_type") == "error").select(KEY, DAY)


def motion(ev: DataFrame) -> DataFrame:
    return ev.select(KEY, DAY, "ts", "event_id", F.col("event_type").alias("room"),
                     F.col("value").alias("duration_sec"))


def voice_segments(ev: DataFrame) -> DataFrame:
    second = F.unix_micros("ts") / 1e6
    return ev.select(KEY, DAY, "ts", "event_id", second.alias("start_sec"),
                     (F.col("value") / 10.0).alias("duration_sec"))


def waveform(ev: DataFrame) -> DataFrame:
    return ev.select(KEY, DAY, "ts", "event_id", (F.col("k") + 40.0).alias("heart_rate"),
                     (F.col("value") - 50.0).alias("movement"))


def nights(ev: DataFrame) -> DataFrame:
    return ev.select(KEY, DAY).distinct().select(
        KEY, DAY, F.lit("23:00").alias("in_bed"), F.lit("07:00").alias("out_bed"))


def frames(ev: DataFrame) -> DataFrame:
    """Skeleton frames: one per event for a joint named after its type."""
    return ev.select(KEY, DAY, F.col("event_type").alias("joint"), F.col("event_id").alias("frame"),
                     F.col("value").alias("x"), F.col("k").alias("y"), (F.col("value") - F.col("k")).alias("z"))


def daily_vectors(utt: DataFrame) -> DataFrame:
    """One ten-feature row per person and day; unfavourable mixes leave NULL features.

    A day's set of hours is a 24-bit mask, so no distinct aggregate is needed.
    """
    dur = F.col("duration_sec")
    among = lambda *names: F.sum(F.when(F.col("emotion").isin(*names), 1).otherwise(0))
    hours = F.bit_count(F.bit_or(F.expr("shiftleft(1, hour(ts))"))).cast("double")
    n = F.count(F.lit(1))
    return utt.groupBy(KEY, DAY).agg(
        (F.sum(F.when(F.col("emotion") == "sad", dur).otherwise(0.0)) / F.nullif(F.sum(dur), F.lit(0.0)))
        .alias("sad_ratio"),
        F.avg("speech_rate").alias("avg_speed"),
        F.when(n >= 2, F.expr(deviation("pitch_mean"))).alias("pitch_variability"),
        among("sad", "angry", "fearful").cast("double").alias("distress_events"),
        (F.avg(F.least(dur, F.lit(10.0))) / 10.0).alias("sleep_efficiency"),
        (F.min(dur) / (F.max(dur) + 1)).alias("deep_sleep_ratio"),
        n.cast("double").alias("sfi"),
        F.avg("pitch_mean").alias("hrv_rmssd"),
        F.when(among("angry", "neutral", "fearful") > 0, F.sum(dur) * 10 / 36).alias("daily_activity"),
        F.when(F.sum(F.when(F.col("emotion") != "sad", 1).otherwise(0)) > 0, hours).alias("social_turns"),
    )


def event_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """The event table as a stream, with the columns of ``events``."""
    schema = table(spark, folder, "events").schema
    # The pattern matches this one name, be it a file or a folder of part files.
    raw = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
           .parquet(f"{folder}/events.parque[t]"))
    return with_event_columns(raw)
