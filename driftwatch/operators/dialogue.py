"""Recognizer output to utterances, and utterances to speaker turns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwatch.functions.scalars import clock, emotion_of, speech_rate, strip_tags
from driftwatch.operators.acoustic import PITCH_IF_MISSING, SPEED_IF_MISSING
from driftwatch.operators.ordered import merge_runs, salted_join

# Fixed value: shortest segment length used for the speech rate.
MIN_SEGMENT_SEC = 0.1


def segments_of(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per recognizer segment; a result without segments gives one whole-text row."""
    plain = F.array(F.struct(
        F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"),
        F.lit(None).cast("int").alias("spk"), F.col("text").alias("sentence")))
    typed = F.transform("sentence_info", lambda s: F.struct(
        s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end"),
        s["spk"].cast("int").alias("spk"), s["sentence"].alias("sentence")))
    return (results.withColumn("whole", F.col("sentence_info").isNull())
            .select(*keys, "whole", F.posexplode(F.coalesce(typed, plain)).alias("pos", "s"))
            .select(*keys, "whole", "pos", F.coalesce("s.start", F.lit(0)).alias("start_ms"),
                    F.coalesce("s.end", F.lit(0)).alias("end_ms"),
                    F.coalesce("s.spk", F.lit(0)).alias("spk"), F.coalesce("s.sentence", F.lit("")).alias("raw")))


def utterances_of(segments: DataFrame, keys: Sequence[str], digits: bool = True) -> DataFrame:
    """Clean text, emotion, speech rate and speaker names of recognizer segments.

    ``segments``: ``(keys..., whole, pos, start_ms, end_ms, spk, raw)``. Segments whose text
    is empty after cleaning are dropped before speakers are numbered.
    """
    clean = segments.withColumn("text", strip_tags("raw")).filter(F.col("text") != "")
    start, end = F.col("start_ms") / 1000.0, F.col("end_ms") / 1000.0
    length = F.greatest(F.lit(MIN_SEGMENT_SEC), end - start)
    rate = speech_rate(F.col("text"), length)
    named = name_speakers(clean, keys)
    return named.select(
        *keys, "pos", start.alias("start_sec"), end.alias("end_sec"),
        F.when(F.col("whole"), 0.0).otherwise(F.round(length, 3)).alias("duration_sec"),
        "text", "speaker",
        F.when(F.col("whole"), "neutral").otherwise(emotion_of("raw")).alias("emotion"),
        F.when(F.col("whole"), SPEED_IF_MISSING).otherwise(F.round(rate, 2) if digits else rate).alias("speech_rate"),
        F.lit(PITCH_IF_MISSING).alias("pitch_mean"))


def name_speakers(segments: DataFrame, keys: Sequence[str], spk: str = "spk",
                  order: Sequence[str] = ("pos",)) -> DataFrame:
    """Add ``speaker`` = ``speaker_1``, ``speaker_2``, ... by first appearance per key.

    First positions are found by a combined aggregate, so only one row per speaker is
    ranked. The names come back by a salted join, which cuts a speaker with most of the rows.
    """
    firsts = segments.groupBy(*keys, spk).agg(F.min(F.struct(*order)).alias("_at"))
    names = firsts.select(*keys, spk, F.concat(F.lit("speaker_"), F.row_number().over(
        Window.partitionBy(*keys).orderBy("_at")).cast("string")).alias("speaker"))
    return salted_join(segments, names, [*keys, spk], order)


def turns(utterances: DataFrame, keys: Sequence[str], order: Sequence[str], role: str = "speaker",
          text: str = "text", start: str = "start_ms", end: str = "end_ms", sep: str = "") -> DataFrame:
    """Merge neighbours of one speaker: text joined, first start, last end."""
    merged = merge_runs(utterances, keys, order, role, text, {"start_ms": start}, {"end_ms": end}, sep)
    return merged.withColumn("start_time", clock(F.col("start_ms"))).withColumn("end_time", clock(F.col("end_ms")))
