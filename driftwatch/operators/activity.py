"""Daily activity and room-transition entropy from motion-sensor events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwatch.functions.scalars import clamp, ratio, rounded
from driftwatch.operators.ordered import BUCKET, adjacent_sums, bucket_summaries, bucketed

# Scale factors, defaults and bounds.
SECONDS_PER_POINT = 36.0
DISPLACEMENT_PER_POINT = 100.0
ONE_FRAME_ACTIVITY = 3000.0
ACTIVITY_IF_UNKNOWN, ACTIVITY_BOUNDS = 5000.0, (100.0, 20000.0)
ENTROPY_IF_UNKNOWN, ENTROPY_BOUNDS = 2.0, (0.1, 5.0)


def joint_displacement(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Path length of all joints per key from ``(keys..., frame, joint, x, y, z)``."""
    step = lambda a, b: F.sqrt(sum((F.pow(b[c] - a[c], F.lit(2.0)) for c in "xyz"), F.lit(0.0)))
    per_joint = adjacent_sums(frames, [*keys, "joint"], ["frame"], ["x", "y", "z"],
                              {"path": step}, sums={"frames": F.lit(1)})
    return per_joint.groupBy(*keys).agg(F.sum("path").alias("displacement"), F.max("frames").alias("n_frames"))


def daily_activity(keys: Sequence[str], reported: DataFrame | None = None, pir: DataFrame | None = None,
                   frames: DataFrame | None = None, days: DataFrame | None = None,
                   digits: bool = True) -> DataFrame:
    """Activity by precedence: reported seconds, motion events, joint paths, constant.

    ``days`` may list further keys that should get the constant.
    """
    parts = []
    if reported is not None:
        parts.append(reported.groupBy(*keys).agg(F.max("activity_seconds").alias("reported")))
    if pir is not None:
        parts.append(pir.groupBy(*keys).agg(F.sum(F.coalesce("duration_sec", F.lit(0.0))).alias("motion")))
    if frames is not None:
        parts.append(joint_displacement(frames, keys))
    if days is not None:
        parts.append(days.select(*keys).distinct())
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p, allowMissingColumns=True)
    values = ["reported", "motion", "displacement", "n_frames"]
    have = set(union.columns)
    g = union.groupBy(*keys).agg(*[
        (F.max(v) if v in have else F.max(F.lit(None).cast("double"))).alias(v) for v in values])
    moved = (F.when(F.col("n_frames") > 1, F.col("displacement") / DISPLACEMENT_PER_POINT)
              .when(F.col("n_frames") == 1, ONE_FRAME_ACTIVITY))
    activity = F.coalesce(F.col("reported") / SECONDS_PER_POINT, F.col("motion") / SECONDS_PER_POINT,
                          moved, F.lit(ACTIVITY_IF_UNKNOWN))
    return g.select(*keys, rounded(clamp(activity.cast("double"), *ACTIVITY_BOUNDS), 1, digits)
                    .alias("daily_activity"))


def room_entropy(pir: DataFrame, keys: Sequence[str], order: Sequence[str], digits: bool = True) -> DataFrame:
    """Shannon entropy of room visits, raised by the share of room changes.

    A bucket leaves one row per room, with visits and changes into it; what a day needs comes from those rows.
    """
    rows = bucketed(pir.select(*keys, *order, F.coalesce("room", F.lit("unknown")).alias("room")), keys, order)
    rooms = bucket_summaries(rows, keys, order, ["room"], {"moves": lambda a, b: (a["room"] != b["room"]).cast("long")},
                             {"visits": F.lit(1)}, per=["room"])
    ends = rooms.groupBy(*keys, BUCKET).agg(
        F.sum("_t_moves").alias("moves"), F.min_by("room", "_first_at").alias("first"), F.max_by("room", "_last_at").alias("last"),
        F.collect_list(F.struct("room", F.col("_s_visits").alias("c"))).alias("seen"))
    before = F.lag("last").over(Window.partitionBy(*keys).orderBy(BUCKET))
    ends = ends.withColumn("moves", F.coalesce("moves", F.lit(0)) + F.coalesce((before != F.col("first")).cast("long"), F.lit(0)))
    per_room = ends.select(*keys, "moves", F.posexplode("seen").alias("i", "v"))
    per_room = per_room.select(*keys, "v.room", "v.c", F.when(F.col("i") == 0, F.col("moves")).alias("moves"))
    visits = per_room.groupBy(*keys, "room").agg(F.sum("c").alias("c"), F.sum("moves").alias("moves"))
    n = F.col("n")
    shares = visits.groupBy(*keys).agg(
        F.sum("c").alias("n"), F.sum(F.col("c") * F.log2(F.col("c").cast("double"))).alias("clogc"),
        F.coalesce(F.sum("moves"), F.lit(0)).alias("moves"))
    entropy = F.greatest(F.log2(n.cast("double")) - ratio(F.col("clogc"), n), F.lit(0.0))
    value = F.when(n >= 2, clamp(entropy * (1 + ratio(F.col("moves"), n)), *ENTROPY_BOUNDS)) \
             .otherwise(ENTROPY_IF_UNKNOWN)
    return shares.select(*keys, n.alias("n_visits"), "moves", rounded(value, 2, digits).alias("space_entropy"))
