"""Sleep features from per-second waveforms in long form.

``samples``: ``(keys..., seq, heart_rate, movement)``, one row per sample, ``seq`` unique
within a key. ``nights``: ``(keys..., in_bed, out_bed)`` with ``HH:MM`` texts; a key found
in only one of the two still gives a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwatch.functions.scalars import clamp, minutes_of, ratio, rounded
from driftwatch.operators.ordered import BUCKET, bucketed, sums_of_buckets

# What is reported without a signal, and the bounds of each feature.
BED_MINUTES = 480.0
EFFICIENCY_IF_STILL = 0.88
DEEP_IF_UNKNOWN, DEEP_CALM, DEEP_RESTLESS, DEEP_BOUNDS = 0.28, 0.30, 0.20, (0.05, 0.50)
SFI_IF_UNKNOWN, SFI_BOUNDS = 4.5, (1.0, 15.0)
HRV_IF_UNKNOWN, HRV_BOUNDS = 48.0, (10.0, 100.0)
AWAKE_STDS, CALM_HEART_STD = 1.5, 5.0
# Comparisons with a mean or deviation tie exactly on two-sample nights; a tie is "not above",
# whatever order the sums were taken in.
TIE = 1e-9


def waveform_long(nights: DataFrame, keys: Sequence[str], heart: str = "heart_rate",
                  movement: str = "movement") -> DataFrame:
    """Per-night arrays to one row per sample."""
    return nights.select(*keys, F.posexplode(F.arrays_zip(heart, movement)).alias("seq", "s")).select(
        *keys, "seq", F.col("s")[heart].alias("heart_rate"), F.col("s")[movement].alias("movement"))


def sleep_features(samples: DataFrame, nights: DataFrame, keys: Sequence[str],
                   order: Sequence[str] = ("seq",), digits: bool = True) -> DataFrame:
    """Efficiency, deep share, fragmentation and HRV per key.

    Samples are dealt out by (keys, bucket) once. From there each bucket gives its moments, which add up to the night's
    mean and deviation; these go back to the buckets, where every sample is held against them. Samples without a key
    are left out.
    """
    known = samples.select(*keys, *order, "heart_rate", "movement").dropna(subset=list(keys))
    rows = bucketed(known, keys, order)
    size = F.abs("movement")
    # Both uses of the dealt rows need the same columns, so that Spark deals them once: the bucket's last position is
    # there for that, and no sample lies behind it.
    own = rows.groupBy(*keys, BUCKET).agg(
        F.avg("movement").alias("_m"), F.var_pop("movement").alias("_mv"), F.sum(size).alias("_ma"), F.count("movement").alias("_mn"),
        F.avg("heart_rate").alias("_h"), F.var_pop("heart_rate").alias("_hv"), F.count("heart_rate").alias("_hn"),
        F.max(F.struct(*order)).alias("_end"))
    night = Window.partitionBy(*keys)

    def moments(mean: str, var: str, n: str) -> Column:
        total = F.sum(n).over(night)
        centre = F.sum(F.col(mean) * F.col(n)).over(night) / F.nullif(total, F.lit(0))
        return F.struct(centre.alias("c"), total.alias("n"), F.col(var).alias("v"), F.col(mean).alias("m"), F.col(n).alias("k"))

    centred = own.withColumns({"_ms": moments("_m", "_mv", "_mn"), "_hs": moments("_h", "_hv", "_hn")})
    spread = lambda s: F.sqrt(F.sum(F.col(f"{s}.k") * (F.col(f"{s}.v") + F.pow(F.col(f"{s}.m") - F.col(f"{s}.c"), F.lit(2.0)))).over(night)
                              / F.nullif(F.col(f"{s}.n"), F.lit(0)))
    nightly = centred.select(*keys, BUCKET, "_end", spread("_ms").alias("m_std"), spread("_hs").alias("h_std"),
                             (F.sum("_ma").over(night) / F.nullif(F.col("_ms.n"), F.lit(0))).alias("m_abs"),
                             F.col("_ms.n").alias("n_m"), F.col("_hs.n").alias("n_h"))
    stats = ["m_std", "h_std", "m_abs", "n_m", "n_h"]
    within = F.col("_end").isNull() | (F.struct(*order) <= F.col("_end"))
    marked = rows.join(nightly, [*keys, BUCKET]).filter(within).select(
        *keys, BUCKET, *order, F.col("heart_rate").alias("hr"), *stats,
        (size > AWAKE_STDS * F.col("m_std") + TIE).cast("int").alias("awake"),
        (size > F.col("m_abs") + F.col("m_std") + TIE).cast("int").alias("high"))
    rr = lambda row: F.lit(60000.0) / F.nullif(row["hr"], F.lit(0.0))
    seen = sums_of_buckets(
        marked, keys, order, ["hr", "high"],
        terms={
            "crossings": lambda a, b: F.coalesce((a["high"] != b["high"]).cast("int"), F.lit(0)),
            "rr_sq": lambda a, b: F.coalesce(F.pow(rr(b) - rr(a), F.lit(2.0)), F.lit(0.0)),
            "rr_n": lambda a, b: (rr(a).isNotNull() & rr(b).isNotNull()).cast("int"),
        },
        sums={"awake_n": F.col("awake")}, same=stats)

    bed = nights.select(*keys, F.pmod(minutes_of(F.col("out_bed")) - minutes_of(F.col("in_bed")), F.lit(1440))
                        .cast("double").alias("bed"))
    rows = seen.join(bed, list(keys), "full_outer")
    bed_min = F.coalesce("bed", F.lit(BED_MINUTES))
    has_m, has_h = F.coalesce("n_m", F.lit(0)) > 0, F.coalesce("n_h", F.lit(0)) > 0

    awake = F.when(has_m, F.col("awake_n") / F.col("n_m"))
    asleep = F.when(has_m, bed_min * (1 - awake)).otherwise(bed_min * EFFICIENCY_IF_STILL)
    efficiency = F.least(ratio(asleep, bed_min), F.lit(1.0))
    calm = (F.col("m_abs") < F.col("m_std") - TIE) & (F.col("h_std") < CALM_HEART_STD - TIE)
    deep = F.when(has_h & has_m, clamp(F.when(calm, DEEP_CALM).otherwise(DEEP_RESTLESS), *DEEP_BOUNDS))
    hours = F.when(bed_min > 0, bed_min / 60)
    sfi = F.when(has_m, F.coalesce(clamp(F.col("crossings") / hours, *SFI_BOUNDS), F.lit(SFI_BOUNDS[1])))
    hrv = F.when(F.col("rr_n") > 0, clamp(F.sqrt(F.col("rr_sq") / F.nullif("rr_n", F.lit(0))), *HRV_BOUNDS))
    return rows.select(
        *keys,
        rounded(efficiency, 4, digits).alias("sleep_efficiency"),
        rounded(F.coalesce(deep, F.lit(DEEP_IF_UNKNOWN)), 4, digits).alias("deep_sleep_ratio"),
        rounded(F.coalesce(sfi, F.lit(SFI_IF_UNKNOWN)), 2, digits).alias("sfi"),
        rounded(F.coalesce(hrv, F.lit(HRV_IF_UNKNOWN)), 1, digits).alias("hrv_rmssd"),
    )
