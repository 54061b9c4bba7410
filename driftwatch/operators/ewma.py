"""Exponentially weighted mean and variance of a score sequence per key.

    m(1) = x(1)            v(1) = 0
    m(n) = (1-a) m(n-1) + a x(n)
    v(n) = a (x(n) - m(n-1))^2 + (1-a) v(n-1)

Each row gets the state before and after its own score.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwatch.config import DEFAULTS, Settings
from driftwatch.functions.text import BEFORE, UPTO, add, num

# Deviation of an empty history, and its floor.
STD_IF_FEW, STD_FLOOR = 1.0, 1e-8


def max_rows(alpha: float) -> int:
    """Longest run for which (1 - alpha)^-n stays far inside the double range."""
    return int(290 * math.log(10) / -math.log1p(-alpha))


def ewma_states(df: DataFrame, keys: Sequence[str], order: Sequence[str], score: str,
                alpha: float = DEFAULTS.ewma_alpha, seed: tuple[str, str, str] | None = None,
                only: str | None = None) -> DataFrame:
    """Add ``n_before, mean_before, var_before, ewma_n, ewma_mean, ewma_var``.

    The recursion is written as running sums of ``x / (1-a)^n``, which are plain window
    aggregates: no array of a key's history. All addends of the variance are positive, so
    nothing cancels. The sums start anew in every block of half ``max_rows(alpha)`` rows from the
    end of the block before, so they never leave the range of doubles, whatever the length
    and alpha. What lies two blocks back has decayed to less than 1e-145 of itself.

    ``seed`` names columns (mean, var, n), constant per key, to continue from. Rows where the
    ``only`` column is false neither change the state nor get one.
    """
    if not 0 < alpha < 1:
        raise ValueError(f"alpha must lie in (0, 1), got {alpha}")
    kept, q, a, use = df.columns, num(1.0 - alpha), num(alpha), only or "true"
    w = f"PARTITION BY {', '.join(keys)} ORDER BY {', '.join(order)}"
    upto, past = f" OVER ({w} {UPTO})", f" OVER ({w} {BEFORE})"
    mean0, var0, n0 = seed or ("NULL", "0D", "0")
    df = add(df, f"CASE WHEN {use} THEN {score} END AS _x")
    df = add(df, f"count(_x){upto} AS _i", f"coalesce({n0}, 0) AS _n0", f"first(_x, true){upto} AS _x1")
    # Without earlier scores the first one is the state itself and has no addend.
    df = add(df, f"CASE WHEN _n0 > 0 THEN {mean0} ELSE _x1 END AS _m0",
             f"CASE WHEN _n0 > 0 THEN {var0} ELSE 0D END AS _v0", "CASE WHEN _n0 > 0 THEN _i ELSE _i - 1 END AS _k")
    size = max(1, max_rows(alpha) // 2)
    df = add(df, f"CAST(floor(greatest(_k - 1, 0) / {size}) AS BIGINT) AS _b")
    df = add(df, f"_k - _b * {size} AS _j")
    df = add(df, f"pow({q}, _j) AS _decay", f"pow({q}, -_j) AS _grow")
    # All windows below ask for the order (keys, block, row), so they share one sort.
    by, rows = ", ".join(keys), ", ".join(order)
    inside = f" OVER (PARTITION BY {by}, _b ORDER BY {rows} {UPTO})"
    upto, past = (f" OVER (PARTITION BY {by} ORDER BY _b, {rows} {frame})" for frame in (UPTO, BEFORE))
    carried = lambda first, end: (
        f"CASE _b WHEN 0 THEN {first} WHEN 1 THEN {end} + pow({q}, {size}) * {first} ELSE {end} END")
    ended = lambda total: f"last(CASE WHEN _x IS NOT NULL AND _j = {size} THEN _decay * {a} * {total} END, true){past}"
    df = add(df, f"sum(CASE WHEN _k > 0 THEN _x * _grow END){inside} AS _sum")
    df = add(df, f"{ended('_sum')} AS _end")
    df = add(df, f"CASE WHEN _x IS NOT NULL THEN _decay * ({carried('_m0', '_end')} + {a} * coalesce(_sum, 0D)) END AS ewma_mean")
    df = add(df, f"coalesce(last(ewma_mean, true){past}, CASE WHEN _n0 > 0 THEN _m0 END) AS mean_before")
    df = add(df, f"sum(coalesce(pow(_x - mean_before, 2D) * _grow, 0D)){inside} AS _gaps")
    df = add(df, f"{ended('_gaps')} AS _gap_end")
    df = add(df, f"CASE WHEN _x IS NOT NULL THEN _decay * ({carried('_v0', '_gap_end')} + {a} * _gaps) END AS ewma_var")
    return df.selectExpr(*kept, "CASE WHEN _x IS NOT NULL THEN _n0 + _i - 1 END AS n_before", "mean_before",
                         f"coalesce(last(ewma_var, true){past}, _v0) AS var_before",
                         "CASE WHEN _x IS NOT NULL THEN _n0 + _i END AS ewma_n", "ewma_mean", "ewma_var")


def fold_state(scores: Column, alpha: float = DEFAULTS.ewma_alpha) -> Column:
    """Final state struct(mean, var, n) of an array of scores, for any alpha."""
    start = F.struct(F.lit(None).cast("double").alias("mean"), F.lit(0.0).alias("var"), F.lit(0).alias("n"))

    def step(st, x):
        fresh = st["n"] == 0
        gap = x - st["mean"]
        return F.struct(
            F.when(fresh, x).otherwise((1 - alpha) * st["mean"] + alpha * x).alias("mean"),
            F.when(fresh, 0.0).otherwise(alpha * gap * gap + (1 - alpha) * st["var"]).alias("var"),
            (st["n"] + 1).alias("n"))

    return F.aggregate(scores, start, step)


def ewma_fold(df: DataFrame, keys: Sequence[str], order: str, score: str,
              alpha: float = DEFAULTS.ewma_alpha) -> DataFrame:
    """Final state per key by folding the ordered scores of its days; any alpha."""
    g = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, score))).alias("_xs"))
    st = fold_state(F.transform("_xs", lambda r: r[score]), alpha)
    return g.select(*keys, st.alias("s")).select(
        *keys, F.col("s.mean").alias("ewma_mean"), F.col("s.var").alias("ewma_var"), F.col("s.n").alias("ewma_n"))


def ewma_std(var: str, n: str) -> str:
    return f"(CASE WHEN {n} < 2 THEN {num(STD_IF_FEW)} ELSE greatest(sqrt({var}), {num(STD_FLOOR)}) END)"


def ewma_threshold(mean: str, var: str, n: str, sigma: float) -> str:
    return f"({mean} + {num(sigma)} * {ewma_std(var, n)})"


def score_percentile(df: DataFrame, keys: Sequence[str], score: str, percent: float, fallback: str,
                     s: Settings = DEFAULTS) -> DataFrame:
    """Exact interpolated percentile of past scores; with fewer than 3, an aggregate ``fallback``."""
    g = df.groupBy(*keys).agg(F.count(score).alias("n_scores"), F.expr(f"percentile({score}, {num(percent / 100.0)})")
                              .alias("_p"), F.expr(fallback).alias("_f"))
    return g.selectExpr(*keys, "n_scores", "CASE WHEN n_scores < 3 THEN _f ELSE _p END AS score_percentile")
