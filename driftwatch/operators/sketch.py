"""Percentiles of scores from mergeable sketches, kept per person and period.

A sketch (KLL) holds every value up to about ``k`` of them, and beyond that a sample with weights whose ranks are off by
at most ``rank_error(k)`` of all values, with 99 % confidence. Sketches of days or weeks are added up instead of reading
the scores again, so a percentile over a year costs as many rows as the year has periods.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K = 200


def rank_error(k: int = K) -> float:
    """Largest error of a rank as a share of all values (the published bound for one-sided queries)."""
    return 2.296 / k ** 0.9021


def score_sketches(df: DataFrame, keys: Sequence[str], score: str = "anomaly_score", k: int = K) -> DataFrame:
    """``n_scores`` and ``sketch`` per key; scores that are NULL do not count. Combined before the shuffle."""
    return df.groupBy(*keys).agg(F.count(score).alias("n_scores"), F.kll_sketch_agg_double(score, k).alias("sketch"))


def merged_sketches(sketches: DataFrame, keys: Sequence[str], k: int = K) -> DataFrame:
    """Sketches of coarser keys from those of finer ones."""
    return sketches.groupBy(*keys).agg(F.sum("n_scores").alias("n_scores"), F.kll_merge_agg_double("sketch", k).alias("sketch"))


def sketch_percentile(sketches: DataFrame, percent: float, name: str = "score_percentile") -> DataFrame:
    """The smallest score that ``percent`` of all are not above (exact up to ``k`` scores); NULL with none."""
    value = F.when(F.col("n_scores") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(percent / 100.0)))
    return sketches.withColumn(name, value).drop("sketch")
