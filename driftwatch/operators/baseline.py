"""Scaler, training windows and the personal baseline row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwatch.config import DAY, DEFAULTS, FEATURES, KEY, Settings
from driftwatch.functions.text import BY_PERSON, add, array, deviation, each, num, plus, weighted
from driftwatch.operators.ewma import fold_state

EPS = 2.220446049250313e-16  # fixed value: spacing of doubles at 1

BASELINE_COLUMNS = ["train_date", "n_train_days", "n_windows", "scaler_mean", "scaler_scale", "resid_mean", "resid_std",
                    "signed_mean", "signed_std", "version", "model", "feature_dim", "ewma_mean_at_train",
                    "ewma_var_at_train", "ewma_n_at_train", "static_threshold"]


def scale_of(mean: str, std: str, n: str) -> str:
    """Population deviation, or 1 for a column that is constant up to rounding."""
    return f"CASE WHEN {std} <= {n} * abs({mean}) * {num(EPS)} THEN 1D ELSE {std} END"


def fit_scaler(days: DataFrame) -> DataFrame:
    """Mean and scale of every feature per person."""
    g = days.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n_days"), *[F.expr(e) for e in each("avg({f}) AS mean_{f}")],
        *[F.expr(e) for e in each(deviation("{f}") + " AS _std_{f}")])
    return g.selectExpr(KEY, "n_days", *each("mean_{f}"),
                        *[scale_of(f"mean_{f}", f"_std_{f}", "n_days") + f" AS scale_{f}" for f in FEATURES])


def apply_scaler(days: DataFrame, scaler: DataFrame, inverse: bool = False) -> DataFrame:
    """Standardise (or restore) with parameters fitted before; never refits."""
    move = "{f} * scale_{f} + mean_{f} AS {f}" if inverse else "({f} - mean_{f}) / scale_{f} AS {f}"
    return days.join(scaler, KEY).selectExpr(*[move.format(f=c) if c in FEATURES else c for c in days.columns])


def scaler_report(baselines: DataFrame) -> DataFrame:
    """Scaler parameters in long form, one row per person and feature."""
    names = ", ".join(f"'{f}'" for f in FEATURES)
    return (baselines.selectExpr(KEY, "posexplode(arrays_zip(scaler_mean, scaler_scale)) AS (pos, s)")
            .selectExpr(KEY, f"element_at(array({names}), pos + 1) AS feature", "s.scaler_mean AS mean",
                        "s.scaler_scale AS scale", "s.scaler_mean IS NOT NULL AND s.scaler_scale IS NOT NULL AS fitted"))


def mean_backwards(x: str, n: int, over: str) -> str:
    """Mean of the ``n`` rows before each, the nearest added first: the order, and so the last bit, of the SQL's sums.

    NULL where there are fewer.
    """
    return f"{plus(f'lag({x}, {k}) {over}' for k in range(1, n + 1))} / {num(n)}"


def mark_windows(flagged: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Training windows: each clean enrolment day against the ``window`` clean rows before it.

    Rows count, not calendar days. ``is_window`` marks days with a full history; their
    ``train_<f>`` is actual - predicted in units of the person's scaler, for the
    moving-average forecaster, and ``train_score`` the weighted absolute residual.
    """
    df = add(flagged, "enrol AND NOT outlier_day AND gate = 'ok' AS _kept")
    own, kept = f" OVER ({BY_PERSON})", f"OVER ({BY_PERSON}, _kept ORDER BY {DAY}"
    df = add(df, f"count(1) {kept} ROWS BETWEEN {s.window} PRECEDING AND 1 PRECEDING) AS _n_past",
             each(mean_backwards("{f}", s.window, kept + ")") + " AS _past_{f}"))
    df = add(df, "sum(int(_kept))" + own + " AS n_train_days",
             each("avg(CASE WHEN _kept THEN {f} END)" + own + " AS mean_{f}"),
             each(deviation("CASE WHEN _kept THEN {f} END", own) + " AS _std_{f}"))
    df = add(df, f"_kept AND _n_past = {s.window} AS is_window",
             [scale_of(f"mean_{f}", f"_std_{f}", "n_train_days") + f" AS scale_{f}" for f in FEATURES])
    df = add(df, each("CASE WHEN is_window THEN ({f} - _past_{f}) / scale_{f} END AS train_{f}"))
    return df.selectExpr(*flagged.columns, "n_train_days", *each("mean_{f}"), *each("scale_{f}"), "is_window",
                         *each("train_{f}"), weighted("abs(train_{f})", s) + " AS train_score")


def static_threshold(mean: str, std: str, s: Settings = DEFAULTS) -> str:
    """Weighted mean residual plus sigma weighted deviations, from arrays in feature order."""
    return f"{weighted(mean + '[{i}]', s)} + {num(s.sigma)} * {weighted(std + '[{i}]', s)}"


def own_baseline(windows: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Give all days of a person their moving-average baseline, without a join.

    Training scores are at most ``enrol_days - window`` per person; they warm up the EWMA.
    """
    own = f" OVER ({BY_PERSON})"
    keep = [c for c in windows.columns if c in (KEY, DAY, *FEATURES, "missing_raw", "missing_count", "data_quality",
                                                "offline_alarm", "stored", "valid", "carry")]
    df = add(windows, "sum(int(is_window))" + own + " AS n_windows",
             each("avg(abs(train_{f}))" + own + " AS _rm_{f}"), each(deviation("abs(train_{f})", own) + " AS _rs_{f}"),
             each("avg(train_{f})" + own + " AS _sm_{f}"), each(deviation("train_{f}", own) + " AS _ss_{f}"),
             f"collect_list(CASE WHEN is_window THEN struct({DAY}, train_score) END){own} AS _scores")
    df = df.selectExpr(
        *keep, "_scores", "n_windows", "CAST(n_train_days AS BIGINT) AS n_train_days",
        "CASE WHEN n_windows > 0 THEN train_date END AS train_date",
        *[f"CASE WHEN n_windows > 0 THEN {array(t)} END AS {n}" for n, t in (
            ("scaler_mean", "mean_{f}"), ("scaler_scale", "scale_{f}"), ("resid_mean", "_rm_{f}"),
            ("resid_std", "_rs_{f}"), ("signed_mean", "_sm_{f}"), ("signed_std", "_ss_{f}"))])
    scores = F.transform(F.array_sort("_scores"), lambda r: r["train_score"])
    return finish_baseline(df, scores, "mean", s).select(*keep, *BASELINE_COLUMNS)


def mean_baselines(windows: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """The baseline table: one row per person who passed the gate."""
    return own_baseline(windows, s).filter(F.col(DAY) == F.col("train_date")).select(KEY, *BASELINE_COLUMNS)


def finish_baseline(df: DataFrame, train_scores, model: str, s: Settings = DEFAULTS) -> DataFrame:
    """EWMA state after warm-up, static threshold and metadata."""
    df = df.withColumn("_st", fold_state(train_scores, s.ewma_alpha))
    return add(df, "1 AS version", f"'{model}' AS model", f"{len(FEATURES)} AS feature_dim",
               "_st.mean AS ewma_mean_at_train", "_st.var AS ewma_var_at_train", "_st.n AS ewma_n_at_train",
               static_threshold("resid_mean", "resid_std", s) + " AS static_threshold")


RESIDUAL_STATS = ("resid_mean", "resid_std", "signed_mean", "signed_std")


def blend_stats(name: str, old: str, new: str, s: Settings = DEFAULTS) -> str:
    """``(1 - a) old + a new`` per element; a side that is absent leaves the other."""
    a, b = num(s.merge_alpha), num(1 - s.merge_alpha)
    return f"coalesce(zip_with({old}, {new}, (o, x) -> {b} * o + {a} * x), {old}, {new}) AS {name}"


def merge_residual_stats(old: DataFrame, new: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Blend residual statistics on fine-tuning: ``(1 - a) old + a new`` per feature.

    A person without old statistics takes the new ones; one without new keeps the old.
    """
    fresh = new.select(KEY, *[F.col(n).alias(f"_new_{n}") for n in RESIDUAL_STATS])
    return old.join(fresh, KEY, "full_outer").selectExpr(*[
        blend_stats(c, c, f"_new_{c}", s) if c in RESIDUAL_STATS else c for c in old.columns])


def recent_stats(recent: DataFrame, baselines: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Residual statistics of the days of ``finetune_days``: each against the ``window`` kept rows before it, in units
    of the person's scaler as it is. People without a full window have no row."""
    w = f"OVER ({BY_PERSON} ORDER BY {DAY} ROWS BETWEEN {s.window} PRECEDING AND 1 PRECEDING)"
    rows = add(recent, f"count(1) {w} AS _n_past", each("avg({f}) " + w + " AS _past_{f}"))
    rows = add(rows.filter(f"_n_past = {s.window}").join(baselines.select(KEY, "scaler_scale"), KEY),
               each("({f} - _past_{f}) / scaler_scale[{i}] AS _d_{f}"))
    return rows.groupBy(KEY).agg(F.max(DAY).alias("tuned_on"), F.count(F.lit(1)).alias("n_windows"), *[
        F.expr(f"{array(t)} AS {n}") for n, t in (
            ("resid_mean", "avg(abs(_d_{f}))"), ("resid_std", deviation("abs(_d_{f})")), ("signed_mean", "avg(_d_{f})"),
            ("signed_std", deviation("_d_{f}")))])


def retrained(recent: DataFrame, baselines: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Next version of moving-average baselines from the days of ``finetune_days``.

    The scaler and the EWMA state at the first training stay; ``recent_stats`` are blended with
    the old statistics, and the static threshold follows.
    """
    base = baselines.filter(F.col("model") == "mean")
    others = [c for c in base.columns if c not in (KEY, "first_train_date", "static_threshold")]
    first = "coalesce(first_train_date, train_date)" if "first_train_date" in base.columns else "train_date"
    fresh = recent_stats(recent, base, s)
    new = fresh.select(KEY, *[F.col(c).alias(f"_new_{c}") for c in fresh.columns if c != KEY])
    changed = {"version": "version + 1 AS version", "train_date": "_new_tuned_on AS train_date",
               "n_windows": "_new_n_windows AS n_windows"}
    out = base.join(new, KEY).selectExpr(KEY, *[
        blend_stats(c, c, f"_new_{c}", s) if c in RESIDUAL_STATS else changed.get(c, c) for c in others],
        f"{first} AS first_train_date")
    return add(out, static_threshold("resid_mean", "resid_std", s) + " AS static_threshold")


def finetune_days(valid_days: DataFrame, deviations: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Last ``recent_days`` valid rows without deviation days, if enough are left."""
    person = Window.partitionBy(KEY)
    recent = (valid_days.withColumn("_r", F.row_number().over(person.orderBy(F.col(DAY).desc())))
              .filter(F.col("_r") <= s.recent_days).drop("_r"))
    kept = recent.join(deviations.select(KEY, DAY), [KEY, DAY], "left_anti")
    return (kept.withColumn("_n", F.count(F.lit(1)).over(person))
            .filter(F.col("_n") >= s.finetune_min_days).drop("_n"))
