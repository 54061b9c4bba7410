"""Social features from voice-activity segments and smart-speaker logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.functions.scalars import clamp, rounded
from driftwatch.operators.ordered import adjacent_sums

# Gap, defaults and bounds.
TURN_GAP_SECONDS = 3.0
TURNS_IF_UNKNOWN, TURNS_BOUNDS = 25.0, (0.0, 200.0)
SPEECH_IF_UNKNOWN, SPEECH_CAP = 0.12, 0.5


def social_features(keys: Sequence[str], segments: DataFrame | None = None, order: Sequence[str] = ("seq",),
                    speaker_log: DataFrame | None = None, days: DataFrame | None = None,
                    gap_seconds: float = TURN_GAP_SECONDS, gap_from: str = "start",
                    awake_hours: float = 16.0, digits: bool = True) -> DataFrame:
    """Conversation turns and share of time spent talking per key.

    ``segments``: ``start_sec`` (seconds of the day; NULL when unreadable) and
    ``duration_sec``. A new turn starts after a gap, or where a start is unreadable.
    ``gap_from="end"`` measures the gap from the end of the earlier segment.
    """
    def new_turn(a, b):
        since = a["start_sec"] if gap_from == "start" else a["start_sec"] + F.coalesce(a["duration_sec"], F.lit(0.0))
        return F.coalesce(b["start_sec"] - since > gap_seconds, F.lit(True)).cast("long")

    parts = []
    if segments is not None:
        parts.append(adjacent_sums(
            segments, keys, order, ["start_sec", "duration_sec"], {"gaps": new_turn},
            sums={"n_seg": F.lit(1), "talk": F.coalesce("duration_sec", F.lit(0.0))}))
    if speaker_log is not None:
        parts.append(speaker_log.groupBy(*keys).agg(
            F.sum(F.coalesce("utterances", F.lit(0))).alias("said"),
            F.sum(F.coalesce("utterances", F.lit(1))).alias("said_alone")))
    if days is not None:
        parts.append(days.select(*keys).distinct())
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p, allowMissingColumns=True)
    have = set(union.columns)
    g = union.groupBy(*keys).agg(*[
        (F.max(c) if c in have else F.max(F.lit(None).cast("double"))).alias(c)
        for c in ["gaps", "n_seg", "talk", "said", "said_alone"]])
    heard = F.coalesce("n_seg", F.lit(0)) > 0
    turns = (F.when(heard, 1 + F.col("gaps") + F.coalesce("said", F.lit(0)))
              .otherwise(F.coalesce("said_alone", F.lit(TURNS_IF_UNKNOWN))))
    share = F.lit(0.0) if awake_hours <= 0 else F.least(F.col("talk") / (awake_hours * 3600.0), F.lit(SPEECH_CAP))
    return g.select(
        *keys,
        clamp(turns.cast("double"), *TURNS_BOUNDS).alias("social_turns"),
        rounded(F.when(heard, share).otherwise(SPEECH_IF_UNKNOWN), 4, digits).alias("speech_duration_ratio"))
