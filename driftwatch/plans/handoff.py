"""From the speech stream to the daily job: snapshots, look-up order, seven-day history."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.config import ACOUSTIC_DEFAULTS, DAY, KEY, MODALITIES
from driftwatch.functions.scalars import ratio
from driftwatch.operators.acoustic import features_from_sums, utterance_measures
from driftwatch.operators.ordered import trailing_sums

COUNTERS = ["n_utterances", "total_duration"]


def trailing_features(utterances: DataFrame, hours: int = 24, digits: bool = True) -> DataFrame:
    """Acoustic features of the ``hours`` up to each arrival, per person."""
    sums = trailing_sums(utterances, [KEY], "ts", utterance_measures(), hours * 3600)
    return sums.select(KEY, "ts", *features_from_sums(digits))


TIE = 1e-9  # fixed value: a share or speed this near to a limit is on it up to rounding


def with_ties_in_order(arrivals: DataFrame, utterances: DataFrame, limits: Mapping[str, Sequence[float]], hours: int = 24) -> DataFrame:
    """``trailing_features`` with ``sad_ratio`` and ``avg_speed`` of rows on a limit worked out from plain sums in order
    of arrival, so that the last digit, which decides there, does not depend on where buckets cut the window.

    ``limits``: limits by column. Only rows on a limit meet the utterances of their window, by person and day.
    """
    near = reduce(or_, [F.abs(F.col(c) - x) < TIE for c, xs in limits.items() for x in xs])
    back = F.expr(f"INTERVAL {hours} HOURS")
    on = arrivals.filter(near).select(KEY, "ts", F.explode(F.sequence(F.to_date(F.col("ts") - back), F.to_date("ts"))).alias("_day"))
    values = utterance_measures()
    said = utterances.select(KEY, F.to_date("ts").alias("_day"), F.col("ts").alias("_at"), *[
        values[n].alias(n) for n in ("dur_sum", "sad_sum", "speed_sum")])
    rows = on.join(said, [KEY, "_day"]).filter((F.col("_at") <= F.col("ts")) & (F.col("_at") >= F.col("ts") - back))
    held = rows.groupBy(KEY, "ts").agg(F.array_sort(F.collect_list(F.struct("_at", "dur_sum", "sad_sum", "speed_sum"))).alias("_x"))
    added = lambda n: F.aggregate("_x", F.lit(0.0), lambda a, x: a + x[n])
    exact = held.select(KEY, "ts", ratio(added("sad_sum"), added("dur_sum")).alias("_sad"), (added("speed_sum") / F.size("_x")).alias("_speed"))
    return arrivals.join(exact, [KEY, "ts"], "left").withColumns({
        "sad_ratio": F.coalesce("_sad", "sad_ratio"), "avg_speed": F.coalesce("_speed", "avg_speed")}).drop("_sad", "_speed")


def day_snapshots(arrivals: DataFrame) -> DataFrame:
    """The last snapshot of each person and day (the last write wins)."""
    values = MODALITIES["acoustic"] + COUNTERS
    return (arrivals.groupBy(KEY, F.to_date("ts").alias(DAY))
            .agg(F.max_by(F.struct("ts", *values), "ts").alias("s")).select(KEY, DAY, "s.*"))


def resolve_acoustic(wanted: DataFrame, snapshots: DataFrame, live: DataFrame | None = None, today=None) -> DataFrame:
    """Acoustic values for the wanted (person, day) rows: live today, else snapshot, else constants.

    ``live`` holds one current row per person and counts on ``today`` only. A snapshot that
    exists is taken as it is: a feature it lacks stays NULL.
    """
    names = MODALITIES["acoustic"]
    snap = snapshots.select(KEY, DAY, F.struct(*names).alias("_snap"))
    df = wanted.join(snap, [KEY, DAY], "left")
    if live is not None:
        now = live.select(KEY, F.lit(today).cast("date").alias(DAY), F.struct(*names).alias("_live"))
        df = df.join(now, [KEY, DAY], "left")
    else:
        df = df.withColumn("_live", F.lit(None).cast(snap.schema["_snap"].dataType))
    found = F.coalesce("_live", "_snap", F.struct(*[F.lit(ACOUSTIC_DEFAULTS[n]).alias(n) for n in names]))
    source = (F.when(F.col("_live").isNotNull(), "live").when(F.col("_snap").isNotNull(), "snapshot")
               .otherwise("default"))
    return df.select(*wanted.columns, source.alias("source"), found.alias("_f")).select(
        *wanted.columns, "source", "_f.*")


def acoustic_history(asked: DataFrame, snapshots: DataFrame, days: int = 7) -> DataFrame:
    """The ``days`` days up to each asked (person, day), gaps filled with constants."""
    spine = asked.select(KEY, F.col(DAY).alias("end_date"), F.explode(
        F.sequence(F.date_sub(DAY, days - 1), DAY)).alias(DAY))
    return resolve_acoustic(spine, snapshots)


def daily_package(wanted: DataFrame, snapshots: DataFrame, live: DataFrame | None = None, today=None) -> DataFrame:
    """Rows for the daily job: acoustic features filled, the other modalities NULL."""
    acoustic = resolve_acoustic(wanted, snapshots, live, today)
    rest = [f for m, fs in MODALITIES.items() if m != "acoustic" for f in fs]
    return acoustic.select(KEY, DAY, *MODALITIES["acoustic"], *[F.lit(None).cast("double").alias(f) for f in rest])
