"""The daily job for all people and a whole date range as one DataFrame plan.

    daily features -> calendar spine -> impute and label -> own baseline
    -> cold start | forecaster -> thresholds -> streaks, level, risk types -> alerts

The plan is a straight line: events are scanned once, combined per person and day, and
shuffled once more by person. Everything after that works on at most one row per person
and day inside that partitioning, so event volume per person does not matter any more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.config import DAY, DEFAULTS, FEATURES, KEY, Settings
from driftwatch.functions.text import each, num
from driftwatch.operators import alerts, assemble, baseline, health, quality, risk, scoring

SAVED = ("success", "observation", "cold_start_fallback")  # fixed value: statuses that leave a result


def labelled_days(daily: DataFrame, s: Settings = DEFAULTS, end=None) -> DataFrame:
    """Calendar rows with imputed features and quality labels."""
    return quality.label_quality(quality.calendar_spine(daily, end), s)


def training_windows(days: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Days with enrolment marks, outlier flags, gate and training windows."""
    return baseline.mark_windows(health.flag_outliers(health.mark_enrolment(days, s), s), s)


def first_baselines(days: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Moving-average baselines of everyone who passes the enrolment gate."""
    return baseline.mean_baselines(training_windows(days.filter("stored"), s), s)


def score_days(days: DataFrame, baselines: DataFrame | None = None, s: Settings = DEFAULTS,
               as_of: bool = True, predictor=None) -> DataFrame:
    """One result row per valid day.

    Without ``baselines``, each person's moving-average baseline is worked out from the same
    days in passing. ``predictor`` maps rows with a baseline to rows with normalised
    ``pred_<f>``; the default is the moving average. Days up to the first training day take
    the cold-start score; a retrain changes the model of later days, not the running state.
    """
    stored = assemble.check_features(days).filter("stored")
    if baselines is None:
        stored = baseline.own_baseline(training_windows(stored, s), s).withColumn("first_trained", F.col("train_date"))
    stored = scoring.mean_forecast(stored, s) if predictor is None else scoring.window_rows(stored, s)
    rows = scoring.cold_start(quality.usable(stored), s)
    if baselines is not None:
        rows = scoring.attach_baseline(rows, baselines, as_of)
    rows = rows.withColumn("has_baseline", F.coalesce(F.col("first_trained") < F.col(DAY), F.lit(False)))
    rows = rows.withColumn("scored", F.col("has_baseline") & (F.col("n_hist") == s.window))
    rows = scoring.decide(scoring.residuals((predictor or scoring.predict_mean)(rows), s), s)
    return with_status(rows, s)


def with_status(rows: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Choose between forecaster and cold-start values by status."""
    fallback = "(NOT has_baseline AND fallback_score IS NOT NULL)"
    pick = lambda model, cold, none: f"CASE WHEN scored THEN {model} WHEN {fallback} THEN {cold} ELSE {none} END"
    status = ("CASE WHEN scored AND in_observation_period THEN 'observation' WHEN scored THEN 'success' "
              f"WHEN has_baseline THEN 'data_insufficient' WHEN {fallback} THEN 'cold_start_fallback' "
              "ELSE 'cold_start' END")
    out = rows.selectExpr(
        KEY, DAY, "data_quality", "missing_count", f"{status} AS status",
        pick("anomaly_score", "fallback_score", "0D") + " AS anomaly_score",
        *[pick(t, num(s.fallback_sigma), "0D") + f" AS {t}"
          for t in ("static_threshold", "ewma_threshold", "dynamic_threshold")],
        pick("is_deviation", "fallback_deviation", "false") + " AS is_deviation",
        f"CASE WHEN scored THEN in_observation_period ELSE {fallback} END AS in_observation_period",
        *[f"CASE WHEN scored THEN {c} END AS {c}" for c in (
            "ewma_n", "ewma_mean", "ewma_var", "ewma_std", "resid_mean", "resid_std", "signed_mean", "signed_std")],
        *each(pick("res_{f}", "z_{f}", "NULL") + " AS res_{f}"),
        *each(pick("signed_{f}", "z_{f}", "NULL") + " AS signed_{f}"),
        *[c for c in ("hidden_state", "carry") if c in rows.columns])
    return out.withColumn("saved", F.col("status").isin(list(SAVED)))


def judge_days(scored: DataFrame, s: Settings = DEFAULTS, signed: bool = True) -> DataFrame:
    """Streaks, level, risk types and advice; only ``success`` days carry a judgement."""
    keys = (KEY, "saved")
    return advised(risk.judge(risk.classify(scored, s, signed, keys), s, keys))


def advised(judged: DataFrame) -> DataFrame:
    """Advice text, and no judgement on days that are not due one."""
    df = judged.withColumn("recommendation", risk.recommendation(
        F.col("risk_level"), F.col("risk_types"), F.col("judged_streak")))
    when = {c: "status = 'success'" for c in ("risk_level", "risk_label", "risk_types", "recommendation")}
    when |= {c: "saved" for c in ("judged_streak", "consecutive_deviation_days", "reported_streak",
                                  "avg_anomaly_7d", "max_anomaly_7d")}
    return df.selectExpr(*[f"CASE WHEN {when[c]} THEN {c} END AS {c}" if c in when else c for c in df.columns])


def daily_job(daily: DataFrame, s: Settings = DEFAULTS, end=None, baselines: DataFrame | None = None,
              as_of: bool = True, signed: bool = True, predictor=None) -> DataFrame:
    """Results of every valid day of every person."""
    return judge_days(score_days(labelled_days(daily, s, end), baselines, s, as_of, predictor), s, signed)


def daily_alerts(results: DataFrame) -> DataFrame:
    return alerts.alert_rows(results)


def export_results(results: DataFrame) -> DataFrame:
    """Results as stored and exchanged: rounded scores and a residual map per row."""
    entries = ", ".join(f"'{f}', round(res_{f}, 4)" for f in FEATURES)
    keep = [c for c in results.columns if not c.startswith(("res_", "signed_", "resid_")) and c != "saved"]
    four = {"anomaly_score", "static_threshold", "ewma_threshold", "dynamic_threshold", "ewma_mean", "ewma_std",
            "avg_anomaly_7d", "max_anomaly_7d"}
    return results.filter("saved").selectExpr(
        *[f"round({c}, 4) AS {c}" if c in four else c for c in keep], f"map({entries}) AS feature_residuals")
