"""Data quality per person and day: spine, imputation, flags, offline rules.

All windows share ``partition by person order by day`` over at most one row per day, so a
stage sorts once and a partition holds a person's calendar, whatever the event volume was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.config import DAY, DEFAULTS, FEATURES, KEY, Settings
from driftwatch.functions.scalars import ratio
from driftwatch.functions.text import BEFORE, BY_DAY, BY_PERSON, add, each, num, plus


def calendar_spine(daily: DataFrame, end=None) -> DataFrame:
    """Every day of each person from the first one on; absent days get NULL features.

    Each row brings forth the empty days up to the person's next row, so there is no join.
    The last row reaches to ``end``, by default the last day found in the table.
    """
    stop = F.lit(end).cast("date") if end is not None else daily.agg(F.max(DAY)).scalar()
    df = daily.withColumn("_stop", stop)
    df = add(df, f"coalesce(date_sub(lead({DAY}) OVER ({BY_DAY}), 1), greatest(_stop, {DAY})) AS _until")
    others = [c for c in daily.columns if c not in (KEY, DAY)]
    df = df.selectExpr(KEY, f"{DAY} AS _own", f"explode(sequence({DAY}, _until)) AS {DAY}", *others)
    return df.selectExpr(KEY, DAY, *[f"CASE WHEN {DAY} = _own THEN {c} END AS {c}" for c in others])


def label_quality(days: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Impute from the last valid day and label each day valid / insufficient / offline.

    A day is insufficient with ``max_missing`` or more absent features or an implausible
    value, and offline if it is short of features and so were the days before it. Only
    observed values of valid days are donors; a feature without donor becomes 0 and is
    counted in ``missing_count``. ``stored`` marks days that have a usable vector.
    """
    return labels_from(add(_flagged(days.select(KEY, DAY, *FEATURES), s), *_looking_back(s)), s)


def _flagged(days: DataFrame, s: Settings) -> DataFrame:
    """``missing_raw``, ``_short`` and ``_bad`` of each row by itself."""
    df = add(days, f"{plus(each('int({f} IS NULL)'))} AS missing_raw",
             f"coalesce(least({', '.join(FEATURES)}) < {num(s.implausible_below)}, false) AS _odd")
    return add(df, f"missing_raw >= {s.max_missing} AS _short", f"(missing_raw >= {s.max_missing} OR _odd) AS _bad")


def _looking_back(s: Settings) -> list[str]:
    """Donors from the days before, and bad days among the last ones."""
    run = "sum(int(_bad)) OVER (" + BY_DAY + " ROWS BETWEEN {} PRECEDING AND {})"
    return [*each("last(CASE WHEN NOT _bad THEN {f} END, true) OVER (" + f"{BY_DAY} {BEFORE}" + ") AS _donor_{f}"),
            run.format(s.offline_days, "1 PRECEDING") + " AS _bad_before",
            run.format(s.offline_days - 1, "CURRENT ROW") + " AS _bad_tail"]


def label_continued(rows: DataFrame, s: Settings = DEFAULTS, carried: str = "carry") -> DataFrame:
    """``label_quality`` for days that follow a stored state.

    ``rows`` holds new days (``carried`` is their person's state, with ``donors``) and days of the person's history,
    which have their features and flags already (``old_short``, ``old_bad``); the history must reach back
    over the last ``offline_days`` days without a gap. Both come out with the same labels a whole run gives.
    """
    new = f"{carried} IS NOT NULL"
    df = _flagged(rows, s)
    df = df.withColumns({"_short": F.expr(f"CASE WHEN {new} THEN _short ELSE old_short END"),
                         "_bad": F.expr(f"CASE WHEN {new} THEN _bad ELSE old_bad END")})
    before = [f"last(CASE WHEN {new} AND NOT _bad THEN {f} END, true) OVER ({BY_DAY} {BEFORE})" for f in FEATURES]
    df = add(df, [f"coalesce({e}, {carried}.donors.{f}) AS _donor_{f}" for e, f in zip(before, FEATURES)], _looking_back(s)[len(FEATURES):])
    return labels_from(df, s, (carried, *each("CASE WHEN NOT _bad THEN coalesce({f}, _donor_{f}) ELSE _donor_{f} END AS donor_{f}"), "_short", "_bad"))


def labels_from(df: DataFrame, s: Settings = DEFAULTS, more: tuple[str, ...] = ()) -> DataFrame:
    """Imputed features and labels from flags, donors and counts of bad days."""
    n = s.offline_days
    return df.selectExpr(
        KEY, DAY, *each("coalesce({f}, _donor_{f}, 0D) AS {f}"), "missing_raw",
        plus(each("int({f} IS NULL AND _donor_{f} IS NULL)")) + " AS missing_count",
        f"CASE WHEN _short AND _bad_before = {n} THEN 'offline' WHEN _bad THEN 'insufficient' ELSE 'valid' END"
        " AS data_quality",
        f"_bad_tail = {n} AS offline_alarm", "NOT _short AS stored", "NOT _bad AS valid", *more)


def usable(df: DataFrame) -> DataFrame:
    """Days that may be trained on and scored."""
    return df.filter(F.col("data_quality") == "valid")


def offline_alarm(days: DataFrame, k: int = 3, quality: str = "data_quality") -> DataFrame:
    """True where the last ``k`` days, today included, are all other than valid."""
    kept = [c for c in days.columns if c != "offline_alarm"]
    return days.selectExpr(*kept, f"sum(int({quality} <> 'valid')) OVER ({BY_DAY} ROWS BETWEEN {k - 1} PRECEDING "
                                  f"AND CURRENT ROW) = {k} AS offline_alarm")


def quality_summary(days: DataFrame, keys: tuple[str, ...] = (KEY,)) -> DataFrame:
    count = lambda q: F.count_if(F.col("data_quality") == q)
    n = F.count(F.lit(1))
    return days.groupBy(*keys).agg(
        count("valid").alias("valid_days"), count("insufficient").alias("insufficient_days"),
        count("offline").alias("offline_days"), n.alias("total_days"),
        ratio(count("valid"), n).alias("valid_ratio"))


def impute_sequence(days: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Fill a person's whole sequence: short gaps forward, long gaps by a straight line.

    A long gap at the end is filled forward; a gap at the start with 0. ``degraded_<f>``
    marks every filled cell except the short forward fills.
    """
    df = add(days.select(KEY, DAY, *FEATURES),
             f"row_number() OVER ({BY_DAY}) AS _n", f"count(1) OVER ({BY_PERSON}) AS _len")
    seen = "last(CASE WHEN {f} IS NOT NULL THEN struct(_n AS n, {f} AS x) END, true) OVER "
    df = add(df, each(seen + f"({BY_DAY} {BEFORE})" + " AS _p_{f}"))
    df = add(df, each(seen + f"({BY_DAY} DESC {BEFORE})" + " AS _q_{f}"))
    df = add(df, each("coalesce(_q_{f}.n, _len + 1) - coalesce(_p_{f}.n, 0) - 1 AS _gap_{f}"))
    short = "_gap_{f} <= " + str(s.max_forward_days)
    line = "_p_{f}.x + (_q_{f}.x - _p_{f}.x) * (_n - _p_{f}.n) / (_gap_{f} + 1)"
    return df.selectExpr(
        KEY, DAY,
        *each("CASE WHEN {f} IS NOT NULL THEN {f} WHEN _p_{f} IS NULL THEN 0D "
              "WHEN " + short + " OR _q_{f} IS NULL THEN _p_{f}.x ELSE " + line + " END AS {f}"),
        *each("int({f} IS NULL AND (_p_{f} IS NULL OR NOT (" + short + "))) AS degraded_{f}"))


def degraded_days(filled: DataFrame) -> DataFrame:
    """How many cells of each feature lost quality, per person."""
    return filled.groupBy(KEY).agg(*[F.sum(f"degraded_{f}").alias(f"degraded_{f}") for f in FEATURES])
