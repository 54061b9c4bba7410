"""Streaks, risk types, risk levels, recommendations and acute rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwatch.config import DAY, DEFAULTS, FEATURES, KEY, LEVEL_LABELS, RiskRule, Settings
from driftwatch.functions.scalars import join_names
from driftwatch.functions.text import UPTO, add, num, plus

STD_FLOOR = 1e-8       # fixed value: smallest deviation used in a risk z-score
SCORE_MIN = 1.0        # fixed value: a risk type's score must be above this
LOOKBACK = 7           # fixed value: results looked at by a level's streak and its score statistics


def _order(keys: Sequence[str]) -> str:
    return f"PARTITION BY {', '.join(keys)} ORDER BY {DAY}"


def run_length(flag: str, w: str) -> str:
    """Length of the run of true flags that ends at each row; ``_n`` is the row number."""
    return f"_n - coalesce(max(CASE WHEN NOT {flag} THEN _n END) OVER ({w} {UPTO}), 0)"


def streaks(results: DataFrame, keys: Sequence[str] = (KEY,)) -> DataFrame:
    """Deviation streaks and 7-row score statistics.

    ``judged_streak``: run within the last 7 results, today included.
    ``consecutive_deviation_days``: the run up to today, 0 on a normal day.
    ``reported_streak``: earlier run plus today's flag, also on normal days.
    """
    w = _order(keys)
    last7 = f"OVER ({w} ROWS BETWEEN {LOOKBACK - 1} PRECEDING AND CURRENT ROW)"
    df = add(results, f"row_number() OVER ({w}) AS _n")
    df = add(df, f"{run_length('is_deviation', w)} AS _run", f"avg(anomaly_score) {last7} AS avg_anomaly_7d",
             f"max(anomaly_score) {last7} AS max_anomaly_7d")
    df = add(df, f"least(coalesce(lag(_run) OVER ({w}), 0), {LOOKBACK}) AS _earlier")
    return df.selectExpr(
        *results.columns, "avg_anomaly_7d", "max_anomaly_7d",
        f"CAST(least(_run, {LOOKBACK}) AS BIGINT) AS judged_streak",
        "CAST(CASE WHEN is_deviation THEN _earlier + 1 ELSE 0 END AS BIGINT) AS consecutive_deviation_days",
        "CAST(_earlier + int(is_deviation) AS BIGINT) AS reported_streak")


def risk_level(s: Settings = DEFAULTS) -> str:
    """Level from ``judged_streak``, ``avg_anomaly_7d`` and ``max_anomaly_7d``."""
    if max(s.severe_days, s.warning_days, s.attention_days) > LOOKBACK:
        raise ValueError(f"a level's streak is counted over {LOOKBACK} results; no threshold can lie beyond")
    held = f"avg_anomaly_7d > {num(s.sustained_avg)}"
    return (f"CASE WHEN judged_streak >= {s.severe_days} AND {held} THEN 3 "
            f"WHEN judged_streak >= {s.warning_days} AND {held} THEN 2 "
            f"WHEN judged_streak >= {s.attention_days} OR max_anomaly_7d > {num(s.high_spike)} THEN 1 ELSE 0 END")


def judge(results: DataFrame, s: Settings = DEFAULTS, keys: Sequence[str] = (KEY,)) -> DataFrame:
    """Risk level and label of each result row, given the results up to it."""
    df = add(streaks(results, keys), f"{risk_level(s)} AS risk_level")
    labels = " ".join(f"WHEN {n} THEN '{text}'" for n, text in LEVEL_LABELS.items())
    return add(df, f"CASE risk_level {labels} END AS risk_label")


def _exceeds(direction: str, z: str, limit: float) -> str:
    return {"up": f"{z} > {num(limit)}", "down": f"{z} < {num(-limit)}", "any": f"abs({z}) > {num(limit)}"}[direction]


def classify(results: DataFrame, s: Settings = DEFAULTS, signed: bool = True,
             keys: Sequence[str] = (KEY,)) -> DataFrame:
    """Per rule: score, exceeding features, streak and activity, as columns per rule.

    Rules are few and known when the plan is built, so they become expressions on the wide
    row: no join, no explode. Residuals keep their sign by default, so that "down" means
    below the prediction; ``signed=False`` uses absolute residuals and their statistics.
    Rows without residual statistics meet no rule. The streak counts trailing days that
    exceed and score high enough, up to the last 7 results or as many as the rule asks for.
    """
    return rule_streaks(rule_values(results, s, signed), s, keys)


def rule_values(results: DataFrame, s: Settings = DEFAULTS, signed: bool = True) -> DataFrame:
    """Per rule what one day alone shows: ``<rule>_score``, ``_features`` and ``_meets``."""
    kind, value = ("signed", "signed") if signed else ("resid", "res")
    at = {f: i for i, f in enumerate(FEATURES)}
    used = sorted({f for r in s.rules for f in r.features}, key=at.get)
    df = add(results, [f"(coalesce({value}_{f}, 0D) - {kind}_mean[{at[f]}]) / greatest({kind}_std[{at[f]}], "
                       f"{num(STD_FLOOR)}) AS _z_{f}" for f in used])
    df = add(df, [f"{plus(f'abs(_z_{f}) * {num(w)}' for f, w in zip(r.features, r.weights))} / {num(sum(r.weights))} "
                  f"AS {r.key}_score" for r in s.rules],
             ["array_compact(array(%s)) AS %s_features" % (", ".join(
                 f"CASE WHEN {_exceeds(d, f'_z_{f}', r.threshold_ratio)} THEN '{f}' END"
                 for f, d in zip(r.features, r.directions)), r.key) for r in s.rules])
    return df.selectExpr(*results.columns, *[f"{r.key}_{c}" for r in s.rules for c in ("score", "features")], *[
        f"coalesce(size({r.key}_features) >= 1 AND {r.key}_score > {num(SCORE_MIN)}, false) AS {r.key}_meets" for r in s.rules])


def rule_streaks(days: DataFrame, s: Settings = DEFAULTS, keys: Sequence[str] = (KEY,)) -> DataFrame:
    """Per rule the streak up to each day, activity, and the names of the active types."""
    df = add(days, f"row_number() OVER ({_order(keys)}) AS _n")
    df = add(df, [f"CAST(least({run_length(f'{r.key}_meets', _order(keys))}, {max(LOOKBACK, r.consecutive_days)}) AS BIGINT) AS {r.key}_days"
                  for r in s.rules])
    df = add(df, [f"{r.key}_meets AND {r.key}_days >= {r.consecutive_days} AS {r.key}_active" for r in s.rules])
    per_rule = [f"{r.key}_{c}" for r in s.rules for c in ("score", "features", "meets", "days", "active")]
    others = [c for c in days.columns if c not in per_rule]
    return df.selectExpr(*others, *per_rule, f"{active_names(s.rules)} AS risk_types")


def active_names(rules: Sequence[RiskRule]) -> str:
    return "array_compact(array(%s))" % ", ".join(f"CASE WHEN {r.key}_active THEN '{r.name}' END" for r in rules)


def risk_rows(classified: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """One row per person, day and risk type."""
    rows = ", ".join(
        f"named_struct('risk_key', '{r.key}', 'risk_type', '{r.name}', 'score', {r.key}_score, 'exceeding_features', "
        f"array_join({r.key}_features, ','), 'consecutive_days', {r.key}_days, 'threshold_required', "
        f"{r.consecutive_days}, 'is_active', {r.key}_active)" for r in s.rules)
    return classified.selectExpr(KEY, DAY, f"inline(array({rows}))")


def importance(rules: Sequence[RiskRule], key: str) -> dict[str, float]:
    """Share of each feature in a risk type's weight; empty for an unknown type."""
    for r in rules:
        if r.key == key:
            return {f: w / sum(r.weights) for f, w in zip(r.features, r.weights)}
    return {}


def risk_contributions(results: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Mean absolute residual of each feature times its share in each risk type."""
    means = results.agg(*[F.avg(f"res_{f}").alias(f"res_{f}") for f in FEATURES])
    rows = ", ".join(
        f"named_struct('risk_key', '{r.key}', 'feature', '{f}', 'importance', {num(share)}, 'contribution', "
        f"{num(share)} * res_{f})" for r in s.rules for f, share in importance(s.rules, r.key).items())
    return means.selectExpr(f"inline(array({rows}))")


def recommendation(level: Column, names: Column, streak: Column) -> Column:
    """Advice text. The sentences."""
    some = F.size(names) > 0
    n = streak.cast("string")
    return (F.when(level == 0, "老人状态稳定，无异常检测")
        .when((level == 1) & some, F.concat(F.lit("轻度关注："), F.array_join(names, ", "),
                                            F.lit("指标出现波动，建议持续观察")))
        .when(level == 1, F.concat(F.lit("单日轻微偏离（连续"), n, F.lit("天），建议关注后续变化")))
        .when(level == 2, F.concat(F.lit("需要提醒："), join_names(names, "多项指标"), F.lit("已连续"), n,
                                   F.lit("天偏离个人基线，建议子女主动联系老人，了解近期生活状态")))
        .when((level == 3) & some, F.concat(F.lit("严重警告："), F.array_join(names, "、"), F.lit("已连续"), n,
                                            F.lit("天严重偏离基线，建议安排上门探访或就医咨询")))
        .when(level == 3, F.concat(F.lit("连续"), n, F.lit("天异常，建议尽快联系老人")))
        .otherwise("数据不足，无法判定"))


# Acute rules, opt-in. Each form: (level, limits of sad_ratio, avg_speed, distress).
_ACUTE_CONFIG = [(3, 0.25, 3.5, 5), (2, 0.20, 3.8, 3), (1, 0.15, None, 2)]
_ACUTE_SIMPLE = [(3, 0.25), (2, 0.20), (1, 0.15)]
ACUTE_LIMITS = {"sad_ratio": (0.15, 0.20, 0.25, 0.30), "avg_speed": (3.5, 3.8)}  # of all forms


def acute_level(form: str = "demo") -> Column:
    """Acute level of a 24-hour snapshot.

    ``demo``: sadness with slow speech, or sadness or distress alone at level 1;
    ``simple``: sadness only; ``config``: every limit of a level must be passed.
    """
    sad, speed, distress = F.col("sad_ratio"), F.col("avg_speed"), F.col("distress_events")
    if form == "demo":
        return (F.when((sad > 0.30) & (speed < 3.5), 3).when((sad > 0.25) & (speed < 3.8), 2)
                 .when((sad > 0.20) | (distress > 3), 1).otherwise(0))
    out = F
    if form == "simple":
        for level, limit in _ACUTE_SIMPLE:
            out = out.when(sad > limit, level)
        return out.otherwise(0)
    if form == "config":
        for level, limit, slow, count in _ACUTE_CONFIG:
            hit = (sad > limit) & (distress > count)
            out = out.when(hit & (speed < slow) if slow else hit, level)
        return out.otherwise(0)
    raise ValueError(f"unknown form of the acute rules: {form}")
