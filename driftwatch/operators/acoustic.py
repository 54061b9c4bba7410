"""Daily acoustic features from utterance rows (one row per utterance).

Stream form columns: ``duration_sec, emotion, speech_rate, pitch_mean``.
Batch form adds ``emotion_probs map<string,double>`` and ``non_verbal``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwatch.config import ACOUSTIC_DEFAULTS, DISTRESS_EMOTIONS, DISTRESS_SOUNDS
from driftwatch.functions.scalars import clamp, ratio, rounded

# What a missing utterance field stands for.
DURATION_IF_MISSING = 1.0
SPEED_IF_MISSING = 4.0
PITCH_IF_MISSING = 200.0
PITCH_STD_IF_FEW = 25.0


def utterance_measures() -> dict[str, Column]:
    """Per-utterance addends; every acoustic feature is a function of their sums.

    Pitch is centred before squaring so that the variance formula does not cancel.
    """
    duration = F.coalesce("duration_sec", F.lit(DURATION_IF_MISSING))
    pitch = F.coalesce("pitch_mean", F.lit(PITCH_IF_MISSING)) - PITCH_IF_MISSING
    sad = F.coalesce("emotion", F.lit("neutral")) == "sad"
    return {
        "n_utterances": F.lit(1).cast("long"),
        "dur_sum": duration,
        "sad_sum": F.when(sad, duration).otherwise(0.0),
        "speed_sum": F.coalesce("speech_rate", F.lit(SPEED_IF_MISSING)),
        "pitch_sum": pitch,
        "pitch_sq": pitch * pitch,
        "distress_sum": F.when(F.col("emotion").isin(DISTRESS_EMOTIONS), 1).otherwise(0).cast("long"),
    }


def features_from_sums(digits: bool = True) -> list[Column]:
    """Acoustic features and counters from the sums of ``utterance_measures``."""
    n = F.col("n_utterances")
    mean = ratio(F.col("pitch_sum"), n)
    var = F.greatest(ratio(F.col("pitch_sq"), n) - mean * mean, F.lit(0.0))
    none = F.coalesce(n, F.lit(0)) == 0
    sad = F.when(none, ACOUSTIC_DEFAULTS["sad_ratio"]).otherwise(ratio(F.col("sad_sum"), F.col("dur_sum")))
    speed = F.when(none, SPEED_IF_MISSING).otherwise(ratio(F.col("speed_sum"), n))
    pitch = F.when(n >= 2, F.sqrt(var)).otherwise(PITCH_STD_IF_FEW)
    length = F.coalesce("dur_sum", F.lit(0.0))
    return [
        rounded(sad, 4, digits).alias("sad_ratio"), rounded(speed, 2, digits).alias("avg_speed"),
        rounded(pitch, 1, digits).alias("pitch_variability"),
        F.coalesce("distress_sum", F.lit(0)).cast("double").alias("distress_events"),
        F.coalesce(n, F.lit(0)).cast("long").alias("n_utterances"),
        rounded(length, 1, digits).alias("total_duration"),
    ]


def stream_features(utterances: DataFrame, keys: Sequence[str], digits: bool = True) -> DataFrame:
    """Acoustic features per key in the stream definition, one map-side combined pass."""
    sums = utterances.groupBy(*keys).agg(*[F.sum(e).alias(n) for n, e in utterance_measures().items()])
    return sums.select(*keys, *features_from_sums(digits))


def batch_features(utterances: DataFrame, keys: Sequence[str], events: DataFrame | None = None,
                   digits: bool = True) -> DataFrame:
    """Acoustic features per key in the batch definition.

    ``events`` holds one row per non-verbal event; a key may occur there only.
    """
    duration = F.coalesce("duration_sec", F.lit(DURATION_IF_MISSING))
    has_probs = F.coalesce(F.size("emotion_probs"), F.lit(0)) > 0
    p_sad = F.coalesce(F.try_element_at("emotion_probs", F.lit("sad")), F.lit(0.0))
    rows = utterances.select(
        *keys,
        F.lit(1).alias("u"), F.lit(0).alias("e"),
        duration.alias("dur"),
        F.when(has_probs, p_sad * duration).otherwise(0.0).alias("sad_w"),
        F.when(~has_probs & (F.coalesce("emotion", F.lit("neutral")) == "sad"), 1).otherwise(0).alias("sad_n"),
        F.col("speech_rate").alias("speed"), F.col("pitch_mean").alias("pitch"),
        F.when(F.col("non_verbal").isin(DISTRESS_SOUNDS), 1).otherwise(0).alias("sounds"),
    )
    if events is not None:
        null = F.lit(None).cast("double")
        rows = rows.unionByName(events.select(
            *keys, F.lit(0).alias("u"), F.lit(1).alias("e"), F.lit(0.0).alias("dur"), F.lit(0.0).alias("sad_w"),
            F.lit(0).alias("sad_n"), null.alias("speed"), null.alias("pitch"), F.lit(0).alias("sounds")))
    g = rows.groupBy(*keys).agg(
        F.sum("u").alias("n"), F.sum("e").alias("events"), F.sum("dur").alias("dur"),
        F.sum("sad_w").alias("sad_w"), F.sum("sad_n").alias("sad_n"), F.avg("speed").alias("speed"),
        F.stddev_pop("pitch").alias("pitch_std"), F.count("pitch").alias("n_pitch"), F.sum("sounds").alias("sounds"))
    n = F.col("n")
    sad = (F.when(n == 0, ACOUSTIC_DEFAULTS["sad_ratio"])
            .when(F.col("sad_w") > 0, ratio(F.col("sad_w"), F.col("dur")))
            .otherwise(ratio(F.col("sad_n").cast("double"), n)))
    pitch = F.when(F.col("n_pitch") >= 2, F.col("pitch_std")).otherwise(PITCH_STD_IF_FEW)
    return g.select(
        *keys,
        rounded(clamp(sad, 0.0, 1.0), 4, digits).alias("sad_ratio"),
        rounded(clamp(F.coalesce("speed", F.lit(SPEED_IF_MISSING)), 1.0, 8.0), 2, digits).alias("avg_speed"),
        rounded(clamp(pitch, 0.0, 150.0), 1, digits).alias("pitch_variability"),
        clamp((F.col("events") + F.col("sounds")).cast("double"), 0.0, 100.0).alias("distress_events"),
    )
