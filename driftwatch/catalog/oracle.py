"""DuckDB SQL that the catalog's queries must agree with.

Each statement is put together from named common table expressions; only those a statement
needs, directly or through others, are included.
"""

from __future__ import annotations

import re

from driftwatch.config import FEATURES, RISK_RULES, WEIGHTS
from driftwatch.operators import report as rep
from driftwatch.operators.alerts import MESSAGES, ROUTES, executed_actions
from driftwatch.config import LEVEL_LABELS, LEVEL_NAMES

WSUM = sum(WEIGHTS.values())
TIE_SHIFT = 3.3e-8
LABEL_CASE = "CASE risk_level " + " ".join(f"WHEN {n} THEN '{t}'" for n, t in LEVEL_LABELS.items()) + " END"


def fs(template: str, sep: str = ", ") -> str:
    return sep.join(template.replace("{f}", f).replace("{i}", str(i + 1)) for i, f in enumerate(FEATURES))


def r(expr: str, name: str | None = None) -> str:
    """Six digits as in ``queries.tidy``, without negative zero."""
    return f"round({expr} + {TIE_SHIFT}::DOUBLE, 6) + 0.0 AS {name or expr}"


def weighted(template: str) -> str:
    return "((" + " + ".join(f"{template.replace('{f}', f)} * {w}::DOUBLE" for f, w in WEIGHTS.items()) + f") / {WSUM}::DOUBLE)"


CTES: dict[str, str] = {}

CTES["utt"] = """
SELECT user_id AS elder_id, event_id, ts, CAST(ts AS DATE) AS date, event_type, value, k,
       value / 10.0::DOUBLE AS duration_sec,
       CASE event_type WHEN 'error' THEN 'sad' WHEN 'purchase' THEN 'happy' WHEN 'click' THEN 'angry'
                       WHEN 'signup' THEN 'fearful' ELSE 'neutral' END AS emotion,
       k / 12.5::DOUBLE AS speech_rate, 120 + k AS pitch_mean
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)"""

CTES["daily"] = """
SELECT elder_id, date,
  sum(CASE WHEN emotion = 'sad' THEN duration_sec ELSE 0 END) / nullif(sum(duration_sec), 0) AS sad_ratio,
  avg(speech_rate) AS avg_speed,
  CASE WHEN count(*) >= 2 THEN stddev_pop(pitch_mean) END AS pitch_variability,
  CAST(sum(CASE WHEN emotion IN ('sad', 'angry', 'fearful') THEN 1 ELSE 0 END) AS DOUBLE) AS distress_events,
  avg(least(duration_sec, 10.0::DOUBLE)) / 10.0::DOUBLE AS sleep_efficiency,
  min(duration_sec) / (max(duration_sec) + 1) AS deep_sleep_ratio,
  CAST(count(*) AS DOUBLE) AS sfi, avg(pitch_mean) AS hrv_rmssd,
  CASE WHEN sum(CASE WHEN emotion IN ('angry', 'neutral', 'fearful') THEN 1 ELSE 0 END) > 0
       THEN sum(duration_sec) * 10 / 36 END AS daily_activity,
  CASE WHEN sum(CASE WHEN emotion <> 'sad' THEN 1 ELSE 0 END) > 0
       THEN CAST(count(DISTINCT hour(ts)) AS DOUBLE) END AS social_turns
FROM utt GROUP BY 1, 2"""

CTES["calendar"] = """
SELECT elder_id, CAST(unnest(generate_series(first_day, (SELECT max(date) FROM daily), INTERVAL 1 DAY)) AS DATE) AS date
FROM (SELECT elder_id, min(date) AS first_day FROM daily GROUP BY 1)"""

CTES["spine"] = f"SELECT c.elder_id, c.date, {fs('d.{f}')} FROM calendar c LEFT JOIN daily d USING (elder_id, date)"

CTES["lab0"] = f"""
SELECT *, ({fs('({f} IS NULL)::INT', ' + ')}) AS missing_raw,
       ({fs('coalesce({f} < -100, false)', ' OR ')}) AS odd FROM spine"""

CTES["lab1"] = "SELECT *, missing_raw >= 3 AS short, (missing_raw >= 3 OR odd) AS bad FROM lab0"

CTES["lab2"] = f"""
SELECT *, {fs('last_value(CASE WHEN NOT bad THEN {f} END IGNORE NULLS) OVER before AS donor_{f}')},
  sum(bad::INT) OVER (PARTITION BY elder_id ORDER BY date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS bad_before,
  sum(bad::INT) OVER (PARTITION BY elder_id ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS bad_tail
FROM lab1 WINDOW before AS (PARTITION BY elder_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""

CTES["days"] = f"""
SELECT elder_id, date, {fs('coalesce({f}, donor_{f}, 0) AS {f}')}, missing_raw,
  ({fs('({f} IS NULL AND donor_{f} IS NULL)::INT', ' + ')}) AS missing_count,
  CASE WHEN short AND bad_before = 3 THEN 'offline' WHEN bad THEN 'insufficient' ELSE 'valid' END AS data_quality,
  coalesce(bad_tail = 3, false) AS offline_alarm, NOT short AS stored, NOT bad AS valid
FROM lab2"""

CTES["stored"] = "SELECT * FROM days WHERE stored"
CTES["valid"] = "SELECT * FROM stored WHERE valid"

# ---- enrolment: written with joins and group-by, unlike the windows of the Spark side ----
CTES["enrol"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY elder_id ORDER BY date) AS enrol_no FROM valid)
WHERE enrol_no <= 14"""
CTES["enrol_long"] = f"UNPIVOT (SELECT elder_id, date, {fs('{f}')} FROM enrol) ON {fs('{f}')} INTO NAME feature VALUE x"
CTES["meds"] = "SELECT elder_id, feature, median(x) AS med FROM enrol_long GROUP BY 1, 2"
CTES["devs"] = "SELECT l.*, abs(x - med) AS dev FROM enrol_long l JOIN meds USING (elder_id, feature)"
CTES["mads"] = "SELECT elder_id, feature, median(dev) AS mad, avg(dev) AS mean_dev, count(*) AS n FROM devs GROUP BY 1, 2"
CTES["cells"] = """
SELECT d.elder_id, d.date, d.feature,
  coalesce(n >= 3 AND CASE WHEN mad >= 1e-9 THEN 0.6745::DOUBLE * dev / mad
                           WHEN mean_dev >= 1e-9 THEN 0.7979::DOUBLE * dev / mean_dev END > 3.5, false) AS bad
FROM devs d JOIN mads USING (elder_id, feature)"""
CTES["outl"] = f"""
SELECT e.elder_id, e.date, e.enrol_no, sum(bad::INT) AS bad_count, sum(bad::INT) >= 2 AS outlier_day,
  {fs("bool_or(bad AND feature = '{f}') AS bad_{f}")}
FROM enrol e JOIN cells USING (elder_id, date) GROUP BY 1, 2, 3"""
CTES["gate"] = """
SELECT elder_id, n_enrol, n_outliers, train_date,
  CASE WHEN n_enrol < 14 THEN 'too_few_valid_days' WHEN n_outliers / n_enrol > 0.5 THEN 'too_many_outliers'
       WHEN n_enrol - n_outliers < 8 THEN 'too_few_after_removal' ELSE 'ok' END AS gate
FROM (SELECT elder_id, count(*) AS n_enrol, sum(outlier_day::INT) AS n_outliers, max(date) AS train_date
      FROM outl GROUP BY 1)"""
CTES["kept"] = f"""
SELECT e.elder_id, e.date, {fs('e.{f}')}, g.train_date, row_number() OVER (PARTITION BY e.elder_id ORDER BY e.date) AS pos
FROM enrol e JOIN outl o USING (elder_id, date) JOIN gate g ON g.elder_id = e.elder_id
WHERE NOT o.outlier_day AND g.gate = 'ok'"""
CTES["scaler"] = f"""
SELECT elder_id, count(*) AS n_train_days, {fs('avg({f}) AS mean_{f}')},
  {fs('CASE WHEN stddev_pop({f}) <= count(*) * abs(avg({f})) * 2.220446049250313e-16 THEN 1.0::DOUBLE ELSE stddev_pop({f}) END AS scale_{f}')}
FROM kept GROUP BY 1"""
CTES["wins"] = f"""
SELECT k.elder_id, k.date, k.train_date, {fs('(k.{f} - p.{f}) / s.scale_{f} AS train_{f}')}
FROM kept k JOIN scaler s USING (elder_id)
JOIN (SELECT a.elder_id, a.pos, {fs('avg(b.{f}) AS {f}')}
      FROM kept a JOIN kept b ON a.elder_id = b.elder_id AND b.pos BETWEEN a.pos - 7 AND a.pos - 1
      WHERE a.pos > 7 GROUP BY 1, 2) p ON p.elder_id = k.elder_id AND p.pos = k.pos"""
CTES["wscored"] = f"SELECT *, {weighted('abs(train_{f})')} AS train_score FROM wins"
CTES["resid"] = f"""
SELECT elder_id, max(train_date) AS train_date, count(*) AS n_windows,
  {fs('avg(abs(train_{f})) AS rm_{f}')}, {fs('stddev_pop(abs(train_{f})) AS rs_{f}')},
  {fs('avg(train_{f}) AS sm_{f}')}, {fs('stddev_pop(train_{f}) AS ss_{f}')}
FROM wscored GROUP BY 1"""


def baselines(sigma: float) -> str:
    return f"""
SELECT *, {weighted('rm_{f}')} + {sigma}::DOUBLE * {weighted('rs_{f}')} AS static_threshold
FROM resid JOIN scaler USING (elder_id)"""


CTES["base"] = baselines(2.5)
CTES["base_low"] = baselines(0.25)


def recursion(rows: str) -> str:
    """EWMA over ``rows(elder_id, i, x)`` by the definition, one step per row."""
    return f"""
SELECT elder_id, i, x, 0::BIGINT AS n_before, NULL::DOUBLE AS mean_before, 0.0::DOUBLE AS var_before,
       x AS ewma_mean, 0.0::DOUBLE AS ewma_var FROM {rows} WHERE i = 1
UNION ALL
SELECT r.elder_id, r.i, r.x, e.n_before + 1, e.ewma_mean, e.ewma_var,
       0.95::DOUBLE * e.ewma_mean + 0.05::DOUBLE * r.x,
       0.05::DOUBLE * (r.x - e.ewma_mean) * (r.x - e.ewma_mean) + 0.95::DOUBLE * e.ewma_var
FROM {rows}_ewma e JOIN {rows} r ON r.elder_id = e.elder_id AND r.i = e.i + 1"""


CTES["warm"] = "SELECT elder_id, row_number() OVER (PARTITION BY elder_id ORDER BY date) AS i, train_score AS x FROM wscored"
CTES["warm_ewma"] = recursion("warm")
CTES["warm_end"] = """
SELECT elder_id, max(i) AS ewma_n_at_train, arg_max(ewma_mean, i) AS ewma_mean_at_train,
       arg_max(ewma_var, i) AS ewma_var_at_train FROM warm_ewma GROUP BY 1"""

# ---- cold start ----
CTES["cold0"] = f"""
SELECT *, count(*) OVER w AS hist_n, {fs('count({f}) OVER w AS n_{f}')}, {fs('avg({f}) OVER w AS m_{f}')},
  {fs('stddev_pop({f}) OVER w AS s_{f}')}
FROM valid WINDOW w AS (PARTITION BY elder_id ORDER BY date ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)"""
CTES["cold1"] = f"""
SELECT *, {fs('CASE WHEN n_{f} >= 2 AND s_{f} >= 1e-9 THEN ({f} - m_{f}) / s_{f} ELSE 0 END AS z_{f}')} FROM cold0"""
CTES["cold"] = f"SELECT *, {weighted('abs(z_{f})')} AS anomaly_score FROM cold1 WHERE hist_n >= 5"
CTES["cold_seq"] = "SELECT elder_id, date, row_number() OVER (PARTITION BY elder_id ORDER BY date) AS i, anomaly_score AS x FROM cold"
CTES["cold_seq_ewma"] = recursion("cold_seq")


def streak_ctes(name: str, source: str, where: str = "true") -> None:
    """Streaks by counting, per row, the rows after the last normal one among the last seven."""
    CTES[f"{name}_n"] = (f"SELECT *, row_number() OVER (PARTITION BY elder_id ORDER BY date) AS n FROM {source} "
                         f"WHERE {where}")
    CTES[f"{name}_pairs"] = f"""
SELECT a.elder_id, a.n, coalesce(max(CASE WHEN NOT b.is_deviation THEN b.n END), max(a.n) - 8) AS calm,
  coalesce(max(CASE WHEN NOT b.is_deviation AND b.n < a.n THEN b.n END), max(a.n) - 8) AS calm_before,
  avg(CASE WHEN b.n > a.n - 7 THEN b.anomaly_score END) AS avg_anomaly_7d,
  max(CASE WHEN b.n > a.n - 7 THEN b.anomaly_score END) AS max_anomaly_7d
FROM {name}_n a JOIN {name}_n b ON a.elder_id = b.elder_id AND b.n BETWEEN a.n - 7 AND a.n GROUP BY 1, 2"""
    CTES[f"{name}_streak"] = f"""
SELECT r.*, p.avg_anomaly_7d, p.max_anomaly_7d,
  CAST(least(r.n - greatest(p.calm, 0), 7) AS BIGINT) AS judged_streak,
  CAST(least(r.n - 1 - greatest(p.calm_before, 0), 7) AS BIGINT) AS earlier
FROM {name}_n r JOIN {name}_pairs p USING (elder_id, n)"""
    CTES[f"{name}_judged"] = f"""
SELECT *, CAST(CASE WHEN is_deviation THEN earlier + 1 ELSE 0 END AS BIGINT) AS consecutive_deviation_days,
  CAST(earlier + is_deviation::INT AS BIGINT) AS reported_streak,
  CAST(CASE WHEN judged_streak >= 5 AND avg_anomaly_7d > 1.0 THEN 3 WHEN judged_streak >= 3 AND avg_anomaly_7d > 1.0 THEN 2
       WHEN judged_streak >= 1 OR max_anomaly_7d > 1.5 THEN 1 ELSE 0 END AS BIGINT) AS risk_level
FROM {name}_streak"""


for _name, _limit in (("c30", 3.0), ("c10", 1.0)):
    CTES[f"{_name}_src"] = f"SELECT *, anomaly_score > {_limit} AS is_deviation FROM cold"
    streak_ctes(_name, f"{_name}_src")


def advice(level: str, some: str, comma: str, names: str, streak: str) -> str:
    n = f"CAST({streak} AS VARCHAR)"
    return f"""CASE WHEN {level} = 0 THEN '老人状态稳定，无异常检测'
  WHEN {level} = 1 AND {some} THEN '轻度关注：' || {comma} || '指标出现波动，建议持续观察'
  WHEN {level} = 1 THEN '单日轻微偏离（连续' || {n} || '天），建议关注后续变化'
  WHEN {level} = 2 THEN '需要提醒：' || CASE WHEN {some} THEN {names} ELSE '多项指标' END || '已连续' || {n} || '天偏离个人基线，建议子女主动联系老人，了解近期生活状态'
  WHEN {level} = 3 AND {some} THEN '严重警告：' || {names} || '已连续' || {n} || '天严重偏离基线，建议安排上门探访或就医咨询'
  WHEN {level} = 3 THEN '连续' || {n} || '天异常，建议尽快联系老人' ELSE '数据不足，无法判定' END"""


# ---- the daily job ----
CTES["hist"] = f"""
SELECT elder_id, date, count(*) OVER w AS n_hist, {fs('avg({f}) OVER w AS past_{f}')}
FROM stored WINDOW w AS (PARTITION BY elder_id ORDER BY date
                         RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING)"""


def daily_job(p: str, base: str, sigma: float, fallback: float, observe: int, min_samples: int, low: bool) -> None:
    CTES[f"{p}_rows"] = f"""
SELECT c.elder_id, c.date, c.data_quality, c.missing_count, coalesce(b.train_date < c.date, false) AS has_baseline,
  coalesce(b.train_date < c.date, false) AND h.n_hist = 7 AS scored, b.static_threshold,
  CASE WHEN c.hist_n >= 5 THEN {weighted('abs(c.z_{f})')} END AS fallback_score, {fs('c.z_{f}')},
  {fs('(c.{f} - b.mean_{f}) / b.scale_{f} - (h.past_{f} - b.mean_{f}) / b.scale_{f} AS sg_{f}')},
  {fs('b.rm_{f}')}, {fs('b.rs_{f}')}, {fs('b.sm_{f}')}, {fs('b.ss_{f}')}
FROM cold1 c JOIN hist h USING (elder_id, date) LEFT JOIN {base} b USING (elder_id)"""
    CTES[f"{p}_seq"] = f"""
SELECT elder_id, date, x, trained, row_number() OVER (PARTITION BY elder_id ORDER BY date) AS i
FROM (SELECT elder_id, date, train_score AS x, 1 AS trained FROM wscored
      UNION ALL SELECT elder_id, date, {weighted('abs(sg_{f})')}, 0 FROM {p}_rows WHERE scored)"""
    CTES[f"{p}_seq_ewma"] = recursion(f"{p}_seq")
    std = lambda v, n: f"(CASE WHEN {n} < 2 THEN 1.0 ELSE greatest(sqrt({v}), 1e-8) END)"
    CTES[f"{p}_state"] = f"""
SELECT e.elder_id, s.date, e.x, e.n_before, e.mean_before, e.var_before, e.ewma_mean, e.i AS ewma_n,
  {std('e.ewma_var', 'e.i')} AS ewma_std, e.i - t.n <= {observe} AS in_obs,
  {std('e.var_before', 'e.n_before')} AS std_before
FROM {p}_seq_ewma e JOIN {p}_seq s USING (elder_id, i) JOIN (SELECT elder_id, count(*) AS n FROM wscored GROUP BY 1) t USING (elder_id)"""
    fb = "NOT has_baseline AND fallback_score IS NOT NULL"
    CTES[f"{p}_thr"] = f"""
SELECT r.*, s.x, s.n_before, s.ewma_mean, s.ewma_n, s.ewma_std, s.in_obs,
  CASE WHEN s.n_before >= {min_samples} THEN s.mean_before + {sigma}::DOUBLE * s.std_before ELSE r.static_threshold END AS own
FROM {p}_rows r LEFT JOIN {p}_state s ON r.scored AND s.elder_id = r.elder_id AND s.date = r.date"""
    pick = lambda m, c, n: f"CASE WHEN scored THEN {m} WHEN {fb} THEN {c} ELSE {n} END"
    CTES[f"{p}_res"] = f"""
SELECT elder_id, date, data_quality, missing_count,
  CASE WHEN scored AND in_obs THEN 'observation' WHEN scored THEN 'success' WHEN has_baseline THEN 'data_insufficient'
       WHEN {fb} THEN 'cold_start_fallback' ELSE 'cold_start' END AS status,
  {pick('x', 'fallback_score', '0')} AS anomaly_score, {pick('static_threshold', f'{fallback}::DOUBLE', '0')} AS static_threshold,
  {pick('own', f'{fallback}::DOUBLE', '0')} AS ewma_threshold,
  {pick('least(static_threshold, own)', f'{fallback}::DOUBLE', '0')} AS dynamic_threshold,
  {pick('x > least(static_threshold, own)', f'fallback_score > {fallback}', 'false')} AS is_deviation,
  CASE WHEN scored THEN in_obs ELSE {fb} END AS in_observation_period,
  CASE WHEN scored THEN ewma_n END AS ewma_n, CASE WHEN scored THEN ewma_mean END AS ewma_mean,
  CASE WHEN scored THEN ewma_std END AS ewma_std,
  {fs(pick('abs(sg_{f})', 'z_{f}', 'NULL') + ' AS res_{f}')}, {fs(pick('sg_{f}', 'z_{f}', 'NULL') + ' AS signed_{f}')},
  {fs('CASE WHEN scored THEN rm_{f} END AS rm_{f}')}, {fs('CASE WHEN scored THEN rs_{f} END AS rs_{f}')},
  {fs('CASE WHEN scored THEN sm_{f} END AS sm_{f}')}, {fs('CASE WHEN scored THEN ss_{f} END AS ss_{f}')}
FROM {p}_thr"""
    streak_ctes(p, f"{p}_res", "status IN ('success', 'observation', 'cold_start_fallback')")
    for kind, value, mean, std_ in (("s", "signed", "sm", "ss"), ("u", "res", "rm", "rs")):
        rows = []
        for rule in RISK_RULES:
            zs = {f: f"((coalesce({value}_{f}, 0) - {mean}_{f}) / greatest({std_}_{f}, 1e-8))" for f in rule.features}
            hit = {f: {"up": f"{zs[f]} > {rule.threshold_ratio}", "down": f"{zs[f]} < -{rule.threshold_ratio}",
                       "any": f"abs({zs[f]}) > {rule.threshold_ratio}"}[d] for f, d in zip(rule.features, rule.directions)}
            score = "(" + " + ".join(f"abs({zs[f]}) * {w}::DOUBLE" for f, w in zip(rule.features, rule.weights)) \
                + f") / {sum(rule.weights)}::DOUBLE"
            names = "concat_ws(',', " + ", ".join(f"CASE WHEN {h} THEN '{f}' END" for f, h in hit.items()) + ")"
            rows.append(f"SELECT elder_id, date, n, status, '{rule.key}' AS risk_key, '{rule.name}' AS risk_type, {score} AS score, "
                        f"{names} AS exceeding_features, {rule.consecutive_days} AS threshold_required FROM {p}_judged")
        CTES[f"{p}_types0{kind}"] = " UNION ALL ".join(rows)
        CTES[f"{p}_types1{kind}"] = (f"SELECT *, coalesce(exceeding_features <> '' AND score > 1.0, false) AS meets "
                                     f"FROM {p}_types0{kind}")
        CTES[f"{p}_types2{kind}"] = f"""
SELECT *, CAST(least(n - coalesce(max(CASE WHEN NOT meets THEN n END) OVER (PARTITION BY elder_id, risk_key ORDER BY n
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0), 7) AS BIGINT) AS consecutive_days FROM {p}_types1{kind}"""
        CTES[f"{p}_types{kind}"] = f"SELECT *, meets AND consecutive_days >= threshold_required AS is_active FROM {p}_types2{kind}"
    CTES[f"{p}_names"] = f"""
SELECT elder_id, date, coalesce(string_agg(CASE WHEN is_active THEN risk_type END, ',' ORDER BY o), '') AS risk_types,
  coalesce(string_agg(CASE WHEN is_active THEN risk_type END, '、' ORDER BY o), '') AS names,
  coalesce(string_agg(CASE WHEN is_active THEN risk_type END, ', ' ORDER BY o), '') AS comma
FROM (SELECT *, CASE risk_key {' '.join(f"WHEN '{x.key}' THEN {i}" for i, x in enumerate(RISK_RULES))} END AS o FROM {p}_typess)
GROUP BY 1, 2"""
    CTES[f"{p}_final"] = f"""
SELECT r.*, j.judged_streak, j.consecutive_deviation_days, j.reported_streak, j.avg_anomaly_7d, j.max_anomaly_7d,
  CASE WHEN r.status = 'success' THEN j.risk_level END AS risk_level,
  CASE WHEN r.status = 'success' THEN t.risk_types END AS risk_types, t.names, t.comma
FROM {p}_res r LEFT JOIN {p}_judged j USING (elder_id, date) LEFT JOIN {p}_names t USING (elder_id, date)"""


daily_job("std", "base", 2.5, 3.0, 7, 20, False)
daily_job("two", "base", 2.5, 3.0, 7, 20, False)
CTES["two_rows0"] = CTES["two_rows"]
CTES["two_rows"] = """
SELECT r.* REPLACE (CASE WHEN r.date > b.train_date + 9 THEN r.static_threshold / 2 ELSE r.static_threshold END AS static_threshold)
FROM two_rows0 r LEFT JOIN base b USING (elder_id)"""
daily_job("low", "base_low", 0.25, 1.0, 1, 8, True)

# ---- weekly ----
CTES["wk0"] = """
SELECT j.*, CAST((SELECT max(date) FROM daily) - CAST(7 * ((((SELECT max(date) FROM daily) - date)) // 7) AS INTEGER) AS DATE) AS week_end
FROM low_judged j"""
CTES["wk1"] = """
SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY elder_id, week_end) AS cnt,
  max(CASE WHEN NOT is_deviation THEN date END) OVER (PARTITION BY elder_id, week_end) AS calm_day
FROM wk0 WINDOW w AS (PARTITION BY elder_id, week_end ORDER BY date)"""
_lines = {k: (f"res_{f}" if k == "sad" else f"abs(res_{f})") for k, f in rep.LINES.items()}
CTES["wk2"] = f"""
SELECT elder_id, week_end, count(*) AS n_results, CAST(sum(is_deviation::INT) AS BIGINT) AS deviation_days,
  CAST(sum((calm_day IS NULL OR date > calm_day)::INT) AS BIGINT) AS judged_streak, avg(anomaly_score) AS avg_anomaly_7d,
  max(anomaly_score) AS max_anomaly_7d, max(date) AS last_day,
  {', '.join(f"avg(CASE WHEN pos > cnt // 2 THEN {v} END) - avg(CASE WHEN pos <= cnt // 2 THEN {v} END) AS {k}_step, avg({v}) AS {k}_mean" for k, v in _lines.items())}
FROM wk1 GROUP BY 1, 2"""
CTES["wk3"] = f"""
SELECT *, CAST(CASE WHEN judged_streak >= 5 AND avg_anomaly_7d > 1.0 THEN 3 WHEN judged_streak >= 3 AND avg_anomaly_7d > 1.0 THEN 2
       WHEN judged_streak >= 1 OR max_anomaly_7d > 1.5 THEN 1 ELSE 0 END AS BIGINT) AS risk_level,
  CAST(week_end - 6 AS DATE) AS week_start,
  {', '.join(f"CASE WHEN n_results < 2 THEN '平稳' WHEN {k}_step > 0.3 THEN '上升' WHEN {k}_step < -0.3 THEN '下降' ELSE '平稳' END AS {k}_residual_trend" for k in _lines)},
  {', '.join(f"CASE WHEN n_results < 2 THEN '无明显变化' WHEN {k}_mean > 1.0 THEN '有明显增加' WHEN {k}_mean < -1.0 THEN '有明显减少' ELSE '无明显变化' END AS {k}_week_change" for k in _lines)}
FROM wk2"""
CTES["week"] = f"""
SELECT w.*, {LABEL_CASE} AS risk_label, t.risk_types, t.names, t.comma,
  {advice('risk_level', "t.names <> ''", 't.comma', 't.names', 'judged_streak')} AS recommendation
FROM wk3 w JOIN low_names t ON t.elder_id = w.elder_id AND t.date = w.last_day"""


def _say(col: str, texts: dict[str, str]) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in texts.items()) + " END"


_who, _n = "CAST(elder_id AS VARCHAR)", "CAST(deviation_days AS VARCHAR)"
BODY = f"""CASE WHEN deviation_days = 0 THEN {_who} || '老人本周整体状态平稳，各项监测指标与上周相近。'
  WHEN deviation_days <= 2 THEN {_who} || '老人本周大多数时间状态良好，偶有轻微波动。'
  WHEN deviation_days <= 4 THEN {_who} || '老人本周有' || {_n} || '天出现偏离常态的情况，需要关注。'
  ELSE {_who} || '老人本周有' || {_n} || '天明显偏离日常状态，建议多加留意。' END
  || {_say('sad_residual_trend', rep.MOOD)} || '；' || {_say('social_residual_trend', rep.SOCIAL)} || '；'
  || {_say('sleep_residual_trend', rep.SLEEP)} || '。'
  || CASE WHEN deviation_days >= 3 THEN '{rep.ADVICE_MANY}' WHEN deviation_days >= 1 THEN '{rep.ADVICE_FEW}' ELSE '{rep.ADVICE_NONE}' END"""


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _prompt() -> str:
    parts = re.split(r"\{(\w+)\}", rep.PROMPT_TEMPLATE)
    cols = {f"{k}_trend": f"{k}_residual_trend" for k in rep.LINES} | {
        "deviation_days": "CAST(judged_streak AS VARCHAR)", "risk_types": "CASE WHEN names <> '' THEN names ELSE '无' END"}
    return " || ".join(_quote(p) if i % 2 == 0 else f"({cols.get(p, p)})" for i, p in enumerate(parts))


def _markdown() -> str:
    detail = " || ".join(f"'| {t} | ' || {k}_residual_trend || ' | {x}' || {k}_week_change || ' |' || chr(10)"
                         for t, k, x in rep.DETAIL)
    text = lambda s: " || chr(10) || ".join(_quote(x) for x in s.split("\n"))
    return f"""'# ' || {_who} || {text(' 心理健康周报' + chr(10) * 2 + '**周期**：')} || CAST(week_start AS VARCHAR) || ' ~ '
  || CAST(week_end AS VARCHAR) || {text(chr(10) + '**风险等级**：')} || risk_label
  || {text(chr(10) + '**生成时间**：2024-02-01 00:00' + chr(10) * 2 + '---' + chr(10) * 2 + '## 本周概况' + chr(10) * 2)}
  || {BODY} || {text(chr(10) * 2 + '---' + chr(10) * 2 + '## 监测详情' + chr(10) * 2 + '| 维度 | 本周趋势 | 上周对比 |' + chr(10) + '| :--- | :--- | :--- |' + chr(10))}
  || {detail} || {text(chr(10) + '## 统计指标' + chr(10) * 2 + '- 本周异常天数：')} || {_n}
  || {text('/7' + chr(10) + '- 平均异常分：')} || printf('%.2f', avg_anomaly_7d)
  || {text(chr(10) + '- 最高异常分：')} || printf('%.2f', max_anomaly_7d)
  || {text(chr(10) * 2 + '## 处置建议' + chr(10) * 2)} || recommendation || chr(10)"""


# ---- trailing windows ----
def trailing(hours: int) -> str:
    return f"""
SELECT elder_id, ts, CASE WHEN sum(duration_sec) OVER w = 0 THEN 0 ELSE
    sum(CASE WHEN emotion = 'sad' THEN duration_sec ELSE 0 END) OVER w / sum(duration_sec) OVER w END AS sad_ratio,
  avg(speech_rate) OVER w AS avg_speed,
  CASE WHEN count(*) OVER w >= 2 THEN stddev_pop(pitch_mean) OVER w ELSE 25 END AS pitch_variability,
  CAST(sum(CASE WHEN emotion IN ('sad', 'angry', 'fearful') THEN 1 ELSE 0 END) OVER w AS DOUBLE) AS distress_events,
  count(*) OVER w AS n_utterances, sum(duration_sec) OVER w AS total_duration
FROM utt WINDOW w AS (PARTITION BY elder_id ORDER BY ts RANGE BETWEEN INTERVAL {hours} HOURS PRECEDING AND CURRENT ROW)"""


for _h in (24, 4, 1):
    CTES[f"tr{_h}"] = trailing(_h)
CTES["snap"] = """
SELECT * EXCLUDE (rn) FROM (SELECT *, CAST(ts AS DATE) AS date, row_number() OVER (PARTITION BY elder_id, CAST(ts AS DATE) ORDER BY ts DESC) AS rn
                            FROM tr24) WHERE rn = 1"""
ACOUSTIC = ["sad_ratio", "avg_speed", "pitch_variability", "distress_events"]
ACOUSTIC_COLS = ", ".join(r(c) for c in ACOUSTIC)
TRAIL_COLS = f"elder_id, epoch_us(ts) AS ts, {ACOUSTIC_COLS}, n_utterances, {r('total_duration')}"


def acoustic_agg(source: str, keys: str) -> str:
    return f"""
SELECT {keys}, CASE WHEN sum(duration_sec) = 0 THEN 0 ELSE sum(CASE WHEN emotion = 'sad' THEN duration_sec ELSE 0 END) / sum(duration_sec) END AS sad_ratio,
  avg(speech_rate) AS avg_speed, CASE WHEN count(*) >= 2 THEN stddev_pop(pitch_mean) ELSE 25 END AS pitch_variability,
  CAST(sum(CASE WHEN emotion IN ('sad', 'angry', 'fearful') THEN 1 ELSE 0 END) AS DOUBLE) AS distress_events,
  count(*) AS n_utterances, sum(duration_sec) AS total_duration FROM {source} GROUP BY {keys}"""


CTES["day_ac"] = acoustic_agg("utt", "elder_id, date")


def sliding(hours: int) -> str:
    """Every row counted into each half-hour-aligned window that holds it."""
    n = hours * 2
    return f"""
SELECT *, w_end - INTERVAL {hours} HOURS AS w_start FROM (
  SELECT *, time_bucket(INTERVAL 30 MINUTES, ts) + INTERVAL 30 MINUTES * unnest(generate_series(1, {n})) AS w_end FROM utt)"""


for _h in (24, 4):
    CTES[f"sl{_h}_rows"] = sliding(_h)
    CTES[f"sl{_h}"] = acoustic_agg(f"sl{_h}_rows", "elder_id, w_start, w_end")
SLIDE_COLS = (f"elder_id, epoch_us(w_start) AS window_start, epoch_us(w_end) AS window_end, {ACOUSTIC_COLS}, "
              f"n_utterances, {r('total_duration')}")

# ---- sensors ----
CTES["wave0"] = """
SELECT elder_id, date, ts, event_id, k + 40 AS hr, value - 50 AS m FROM utt"""
CTES["wave1"] = """
SELECT elder_id, date, stddev_pop(m) AS m_std, avg(abs(m)) AS m_abs, stddev_pop(hr) AS h_std, count(*) AS n FROM wave0 GROUP BY 1, 2"""
CTES["wave2"] = """
SELECT w.*, (abs(m) > 1.5 * m_std + 1e-9)::INT AS awake, (abs(m) > m_abs + m_std + 1e-9)::INT AS high, 60000 / hr AS rr
FROM wave0 w JOIN wave1 USING (elder_id, date)"""
CTES["wave3"] = """
SELECT *, abs(high - lag(high) OVER o) AS cross_, rr - lag(rr) OVER o AS drr FROM wave2
WINDOW o AS (PARTITION BY elder_id, date ORDER BY ts, event_id)"""

# ---- dialogue ----
CTES["doc_seg"] = """
SELECT doc_id, false AS whole, pos, line AS raw0, length(line) AS n FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM documents WHERE doc_id % 5 <> 0)"""
CTES["doc_raw"] = """
SELECT doc_id, whole, pos, (n + pos) % 3 AS spk, pos * 1500 AS start_ms, pos * 1500 + n * 10 AS end_ms,
  CASE n % 7 WHEN 0 THEN '<|HAPPY|>' WHEN 1 THEN '<|SAD|>' WHEN 2 THEN '<|ANGRY|>' WHEN 3 THEN '' WHEN 4 THEN '<|FEARFUL|><|SAD|>'
             WHEN 5 THEN '<b>' ELSE '<|SURPRISED|>' END || raw0 AS raw FROM doc_seg
UNION ALL SELECT doc_id, true, 0, 0, 0, 0, text FROM documents WHERE doc_id % 5 = 0"""


def strip(col: str) -> str:
    blank = r"[\s\p{Z}\x0B\x1C-\x1F\x{85}]+"
    return f"regexp_replace(regexp_replace({col}, '<[^>]+>', '', 'g'), '^{blank}|{blank}$', '', 'g')"


def emotion(col: str) -> str:
    tags = ["HAPPY", "SAD", "ANGRY", "NEUTRAL", "FEARFUL", "DISGUSTED", "SURPRISED"]
    return "CASE " + " ".join(f"WHEN contains({col}, '<|{t}|>') THEN '{t.lower()}'" for t in tags) + " ELSE 'neutral' END"


CTES["doc_clean"] = f"SELECT * FROM (SELECT *, {strip('raw')} AS text FROM doc_raw) WHERE text <> ''"
CTES["doc_spk"] = """
SELECT doc_id, spk, 'speaker_' || row_number() OVER (PARTITION BY doc_id ORDER BY p) AS speaker
FROM (SELECT doc_id, spk, min(pos) AS p FROM doc_clean GROUP BY 1, 2)"""
CTES["doc_utt"] = f"""
SELECT doc_id, pos, start_ms, end_ms, start_ms / 1000 AS start_sec, end_ms / 1000 AS end_sec,
  CASE WHEN whole THEN 0 ELSE round(greatest(0.1::DOUBLE, end_ms / 1000 - start_ms / 1000), 3) END AS duration_sec, text, speaker,
  CASE WHEN whole THEN 'neutral' ELSE {emotion('raw')} END AS emotion,
  CASE WHEN whole THEN 4.0::DOUBLE ELSE length(text) / greatest(0.1::DOUBLE, end_ms / 1000 - start_ms / 1000) END AS speech_rate,
  200.0::DOUBLE AS pitch_mean
FROM doc_clean JOIN doc_spk USING (doc_id, spk)"""


def turns(source: str, keys: str, order: str, sep: str, first: str) -> str:
    clock = lambda c: f"printf('%02d:%02d.%03d', {c} // 60000, ({c} // 1000) % 60, {c} % 1000)"
    return f"""
SELECT {keys}, first_pos AS {first}, speaker, text, start_ms, end_ms, n_merged, {clock('start_ms')} AS start_time, {clock('end_ms')} AS end_time
FROM (SELECT {keys}, turn_no, min({first.replace('first_', '')}) AS first_pos, any_value(speaker) AS speaker,
        string_agg(text, {sep} ORDER BY {order}) AS text, arg_min(start_ms, rn) AS start_ms, arg_max(end_ms, rn) AS end_ms,
        count(*) AS n_merged
      FROM (SELECT *, sum(fresh) OVER (PARTITION BY {keys} ORDER BY rn) AS turn_no
            FROM (SELECT *, row_number() OVER o AS rn,
                    CASE WHEN lag(speaker) OVER o IS NOT DISTINCT FROM speaker AND row_number() OVER o > 1 THEN 0 ELSE 1 END AS fresh
                  FROM {source} WINDOW o AS (PARTITION BY {keys} ORDER BY {order})))
      GROUP BY {keys}, turn_no)"""


CTES["day_talk"] = """
SELECT elder_id, date, ts, event_id, event_type AS speaker, CAST(CAST(k AS INT) AS VARCHAR) AS text,
  CAST(floor((epoch_us(ts) - epoch_us(date::TIMESTAMP)) / 1000) AS BIGINT) AS start_ms,
  CAST(floor((epoch_us(ts) - epoch_us(date::TIMESTAMP)) / 1000) AS BIGINT) + CAST(floor(value * 100) AS BIGINT) AS end_ms
FROM utt"""
CTES["conv"] = f"""
SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'user' ELSE role END AS speaker, {strip('text')} AS text,
  turn * 1000 AS start_ms, turn * 1000 + 999 AS end_ms FROM conversations"""


def confusion(actual: str = "actual", predicted: str = "predicted") -> str:
    return (f"count(*) FILTER ({actual} AND {predicted}) AS tp, count(*) FILTER (NOT {actual} AND {predicted}) AS fp, "
            f"count(*) FILTER (NOT {actual} AND NOT {predicted}) AS tn, count(*) FILTER ({actual} AND NOT {predicted}) AS fn")


RATES = {
    "accuracy": "CASE WHEN tp + fp + tn + fn > 0 THEN (tp + tn) / (tp + fp + tn + fn) ELSE 0 END",
    "precision": "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END",
    "recall": "CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END",
    "f1_score": "CASE WHEN tp > 0 THEN 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) ELSE 0 END",
    "fpr": "CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END",
    "specificity": "CASE WHEN fp + tn > 0 THEN 1 - fp / (fp + tn) ELSE 0 END",
}
CTES["truth"] = "SELECT doc_id, toxic = 1 AS actual, quality = 0 AS predicted FROM labels"
CTES["truth_conf"] = f"SELECT {confusion()} FROM truth"
CTES["truth_lang"] = f"SELECT lang, {confusion()} FROM truth JOIN documents USING (doc_id) GROUP BY 1"
CTES["truth_source"] = f"SELECT source, {confusion()} FROM truth JOIN documents USING (doc_id) GROUP BY 1"
CTES["sad_days"] = "SELECT elder_id, date, sad_ratio > 0.35 AS actual FROM daily"
CTES["cmp"] = """
SELECT c.anomaly_score > 1.0 AS personal, d.distress_events / 3 > 1.0 AS population, s.actual
FROM cold c JOIN daily d USING (elder_id, date) JOIN sad_days s USING (elder_id, date)"""
for _n2 in ("personal", "population"):
    CTES[f"cmp_{_n2}"] = (f"SELECT {', '.join(f'round({e}, 4) AS {_n2}_{k}' for k, e in RATES.items())} "
                          f"FROM (SELECT {confusion('actual', _n2)} FROM cmp)")

ORACLE: dict[str, str] = {}


def statement(final: str) -> str:
    """``final`` with every common table expression it needs, in order of dependence."""
    found: list[str] = []

    def visit(text: str, self_name: str = "") -> None:
        for name in re.findall(r"\b(?:FROM|JOIN)\s+([a-z]\w*)", text):
            if name in CTES and name != self_name and name not in found:
                visit(CTES[name], name)
                if name not in found:
                    found.append(name)

    visit(final)
    ctes = ",\n".join(f"{n} AS ({CTES[n].strip()})" for n in found)
    return (f"WITH RECURSIVE {ctes}\n" if ctes else "") + final


def oracle(name: str, final: str) -> None:
    ORACLE[name] = statement(final)


D = "CAST(date AS VARCHAR) AS date"
KD = f"elder_id, {D}"
FEATS = ", ".join(r(f) for f in FEATURES)

oracle("daily_acoustic", f"SELECT {KD}, {ACOUSTIC_COLS}, n_utterances, {r('total_duration')} FROM day_ac")
oracle("daily_acoustic_batch", f"""
SELECT {KD}, {r("CASE WHEN w > 0 THEN w / d ELSE sad_n / n END", "sad_ratio")},
  {r("greatest(1, least(8, coalesce(speed, 4)))", "avg_speed")},
  {r("CASE WHEN np >= 2 THEN greatest(0, least(150, pstd)) ELSE 25 END", "pitch_variability")},
  CAST(least(100, sounds + errors) AS DOUBLE) AS distress_events
FROM (SELECT elder_id, date, count(*) AS n, sum(duration_sec) AS d,
        sum(CASE WHEN event_id % 2 = 0 THEN k / 100 * duration_sec ELSE 0 END) AS w,
        sum(CASE WHEN event_id % 2 <> 0 AND event_type = 'error' THEN 1 ELSE 0 END) AS sad_n,
        avg(CASE WHEN k % 7 <> 0 THEN speech_rate END) AS speed,
        stddev_pop(CASE WHEN k % 5 <> 0 THEN pitch_mean END) AS pstd, count(CASE WHEN k % 5 <> 0 THEN 1 END) AS np,
        sum((k < 20)::INT) AS sounds, sum((event_type = 'error')::INT) AS errors FROM utt GROUP BY 1, 2)""")
oracle("sleep_features", f"""
SELECT {KD}, {r("least(1 - awake_n / n, 1)", "sleep_efficiency")},
  {r("CASE WHEN m_abs < m_std - 1e-9 AND h_std < 5 - 1e-9 THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END", "deep_sleep_ratio")},
  {r("greatest(1, least(15, crossings / 8))", "sfi")},
  {r("CASE WHEN n > 1 THEN greatest(10, least(100, sqrt(rr_sq))) ELSE 48 END", "hrv_rmssd")}
FROM (SELECT elder_id, date, sum(awake) AS awake_n, coalesce(sum(cross_), 0) AS crossings, avg(drr * drr) AS rr_sq FROM wave3 GROUP BY 1, 2)
JOIN wave1 USING (elder_id, date)""")
oracle("activity_from_motion", f"SELECT {KD}, {r('greatest(100, least(20000, sum(value) / 36))', 'daily_activity')} FROM utt GROUP BY elder_id, date")
CTES["frm"] = """
SELECT elder_id, date, event_type, count(*) AS n, coalesce(sum(sqrt(dx * dx + dy * dy + dz * dz)), 0) AS path FROM (
  SELECT elder_id, date, event_type, value - lag(value) OVER o AS dx, k - lag(k) OVER o AS dy,
         (value - k) - lag(value - k) OVER o AS dz
  FROM utt WINDOW o AS (PARTITION BY elder_id, date, event_type ORDER BY event_id)) GROUP BY 1, 2, 3"""
oracle("joint_displacement", f"SELECT {KD}, {r('sum(path)', 'displacement')}, max(n) AS n_frames FROM frm GROUP BY elder_id, date")
oracle("activity_by_precedence", f"""
SELECT {KD}, {r("greatest(100, least(20000, coalesce(rep / 36, CASE WHEN nf > 1 THEN disp / 100 WHEN nf = 1 THEN 3000 END, 5000)))", "daily_activity")}
FROM (SELECT DISTINCT elder_id, date FROM utt)
LEFT JOIN (SELECT elder_id, date, max(k * 3600) AS rep FROM utt WHERE event_type = 'purchase' GROUP BY 1, 2) USING (elder_id, date)
LEFT JOIN (SELECT elder_id, date, sum(path) AS disp, max(n) AS nf FROM frm GROUP BY 1, 2) USING (elder_id, date)""")
oracle("room_entropy", f"""
SELECT {KD}, n AS n_visits, moves, {r("CASE WHEN n >= 2 THEN greatest(0.1, least(5, h * (1 + moves / n))) ELSE 2 END", "space_entropy")}
FROM (SELECT elder_id, date, CAST(sum(c) AS BIGINT) AS n, -sum(c / tot * log2(c / tot)) AS h
      FROM (SELECT elder_id, date, event_type, count(*) AS c, sum(count(*)) OVER (PARTITION BY elder_id, date) AS tot FROM utt GROUP BY 1, 2, 3)
      GROUP BY 1, 2)
JOIN (SELECT elder_id, date, CAST(coalesce(sum(mv), 0) AS BIGINT) AS moves FROM (
        SELECT elder_id, date, (event_type <> lag(event_type) OVER (PARTITION BY elder_id, date ORDER BY ts, event_id))::INT AS mv FROM utt)
      GROUP BY 1, 2) USING (elder_id, date)""")
CTES["gaps"] = """
SELECT elder_id, date, event_type, duration_sec, epoch_us(ts) / 1e6 AS s FROM utt"""


def social(gap: int, where: str, log: bool) -> str:
    said = ("LEFT JOIN (SELECT elder_id, date, sum(CASE WHEN k > 20 THEN k ELSE 0 END) AS said, "
            "sum(CASE WHEN k > 20 THEN k ELSE 1 END) AS alone FROM utt WHERE event_type = 'purchase' GROUP BY 1, 2) USING (elder_id, date)"
            if log else "")
    turns_ = "1 + g + coalesce(said, 0)" if log else "1 + g"
    other = "alone" if log else "25"
    return f"""
SELECT {KD}, CAST(greatest(0, least(200, CASE WHEN n > 0 THEN {turns_} ELSE {other} END)) AS DOUBLE) AS social_turns,
  {r("CASE WHEN n > 0 THEN least(talk / 57600, 0.5) ELSE 0.12 END", "speech_duration_ratio")}
FROM (SELECT DISTINCT elder_id, date FROM utt)
LEFT JOIN (SELECT elder_id, date, count(*) AS n, sum(duration_sec) AS talk, coalesce(sum((gap > {gap})::INT), 0) AS g FROM (
   SELECT *, s - lag(s) OVER (PARTITION BY elder_id, date ORDER BY s) AS gap FROM gaps WHERE {where}) GROUP BY 1, 2) USING (elder_id, date) {said}"""


oracle("social_features", social(3600, "event_type <> 'purchase'", True))
oracle("social_features_strict_gap", social(3, "true", False))
oracle("daily_vectors", f"SELECT {KD}, {FEATS} FROM daily")
_mod = [(f, n) for n, fs_ in ((5, FEATURES[:4]), (7, FEATURES[4:8]), (3, FEATURES[8:9]), (4, FEATURES[9:])) for f in fs_]
CTES["part"] = ("SELECT elder_id, date, " + ", ".join(
    f"CASE WHEN (elder_id + day(date)) % {n} <> 0 THEN {f} END AS {f}" for f, n in _mod)
    + " FROM daily WHERE (elder_id + day(date)) % 420 <> 0")
_miss = " + ".join(f"({f} IS NULL)::INT" for f in FEATURES)
oracle("assembled_days", f"""
SELECT {KD}, {FEATS}, CAST({_miss} AS BIGINT) AS missing_raw,
  concat_ws(',', {fs("CASE WHEN {f} IS NULL THEN '{f}' END")}) AS missing_names FROM part""")
oracle("quality_labels", f"""
SELECT {KD}, {FEATS}, CAST(missing_raw AS BIGINT) AS missing_raw, CAST(missing_count AS BIGINT) AS missing_count, data_quality,
  offline_alarm, stored, valid FROM days""")
oracle("quality_summary", f"""
SELECT elder_id, count(*) FILTER (data_quality = 'valid') AS valid_days, count(*) FILTER (data_quality = 'insufficient') AS insufficient_days,
  count(*) FILTER (data_quality = 'offline') AS offline_days, count(*) AS total_days,
  {r("count(*) FILTER (data_quality = 'valid') / count(*)", "valid_ratio")} FROM days GROUP BY 1""")
CTES["seq_long"] = " UNION ALL ".join(f"SELECT elder_id, date, '{f}' AS feature, {f} AS x FROM spine" for f in FEATURES)
CTES["seq_n"] = """
SELECT *, row_number() OVER (PARTITION BY elder_id, feature ORDER BY date) AS n,
  count(*) OVER (PARTITION BY elder_id, feature) AS len FROM seq_long"""
CTES["seq_pq"] = """
SELECT *, last_value(CASE WHEN x IS NOT NULL THEN n END IGNORE NULLS) OVER b AS pn, last_value(x IGNORE NULLS) OVER b AS px,
  first_value(CASE WHEN x IS NOT NULL THEN n END IGNORE NULLS) OVER a AS qn, first_value(x IGNORE NULLS) OVER a AS qx
FROM seq_n WINDOW b AS (PARTITION BY elder_id, feature ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  a AS (PARTITION BY elder_id, feature ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"""
CTES["seq_fill"] = """
SELECT elder_id, date, feature, (x IS NULL AND (pn IS NULL OR gap > 3))::INT AS degraded,
  CASE WHEN x IS NOT NULL THEN x WHEN pn IS NULL THEN 0 WHEN gap <= 3 OR qn IS NULL THEN px
       ELSE px + (qx - px) * (n - pn) / (gap + 1) END AS y
FROM (SELECT *, coalesce(qn, len + 1) - coalesce(pn, 0) - 1 AS gap FROM seq_pq)"""
oracle("imputed_sequence", f"""
SELECT {KD}, {', '.join(r(f"max(CASE WHEN feature = '{f}' THEN y END)", f) for f in FEATURES)},
  {', '.join(f"CAST(max(CASE WHEN feature = '{f}' THEN degraded END) AS BIGINT) AS degraded_{f}" for f in FEATURES)}
FROM seq_fill GROUP BY elder_id, seq_fill.date""")
oracle("degraded_days", f"""
SELECT elder_id, {', '.join(f"CAST(sum(CASE WHEN feature = '{f}' THEN degraded END) AS BIGINT) AS degraded_{f}" for f in FEATURES)}
FROM seq_fill GROUP BY 1""")
oracle("feature_range", f"SELECT {KD}, {FEATS} FROM daily WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-18'")
oracle("recent_days", f"""
SELECT {KD}, {FEATS} FROM (SELECT *, row_number() OVER (PARTITION BY elder_id ORDER BY date DESC) AS rn FROM daily) WHERE rn <= 7""")
oracle("deduplicated_days", f"SELECT {KD}, {FEATS}, CAST({_miss} AS BIGINT) AS missing_count FROM daily")
oracle("outlier_days", f"""
SELECT elder_id, CAST(o.date AS VARCHAR) AS date, enrol_no, CAST(bad_count AS BIGINT) AS bad_count, outlier_day,
  {r("n_outliers / n_enrol", "outlier_ratio")}, concat_ws(',', {fs("CASE WHEN bad_{f} THEN '{f}' END")}) AS bad_features, {fs('bad_{f}')}
FROM outl o JOIN gate USING (elder_id)""")
oracle("outlier_text", f"""
SELECT {KD}, 'Day#' || (enrol_no - 1) || ': 离群特征=[' || concat_ws(', ', {fs("CASE WHEN bad_{f} THEN '{f}' END")}) || ']' AS description
FROM outl WHERE outlier_day""")
oracle("training_gate", """
SELECT p.elder_id, CAST(coalesce(n_enrol, 0) AS BIGINT) AS n_enrol, CAST(coalesce(n_outliers, 0) AS BIGINT) AS n_outliers,
  coalesce(gate.gate, 'too_few_valid_days') AS gate FROM (SELECT DISTINCT elder_id FROM stored) p LEFT JOIN gate USING (elder_id)""")
oracle("scaled_days", f"SELECT {KD}, {', '.join(r(f'(v.{f} - s.mean_{f}) / s.scale_{f}', f) for f in FEATURES)} FROM valid v JOIN scaler s USING (elder_id)")
oracle("training_windows", f"SELECT {KD}, {', '.join(r(f'train_{f}') for f in FEATURES)}, {r('train_score')} FROM wscored")


def _long(select: str, source: str) -> str:
    return " UNION ALL ".join(select.replace("{f}", f) + f" FROM {source}" for f in FEATURES)


oracle("mean_baselines", _long(
    f"""SELECT elder_id, CAST(train_date AS VARCHAR) AS train_date, n_train_days, n_windows, {r('static_threshold')},
  CAST(ewma_n_at_train AS BIGINT) AS ewma_n_at_train, {r('ewma_mean_at_train')}, {r('ewma_var_at_train')}, '{{f}}' AS feature,
  {r('mean_{f}', 'scaler_mean')}, {r('scale_{f}', 'scaler_scale')}, {r('rm_{f}', 'resid_mean')}, {r('rs_{f}', 'resid_std')},
  {r('sm_{f}', 'signed_mean')}, {r('ss_{f}', 'signed_std')}""", "base JOIN warm_end USING (elder_id)"))
oracle("scaler_report", _long(f"SELECT elder_id, '{{f}}' AS feature, {r('mean_{f}', 'mean')}, {r('scale_{f}', 'scale')}, true AS fitted", "base"))
oracle("baseline_as_of", f"""
SELECT s.elder_id, CAST(s.date AS VARCHAR) AS date, CAST(b.train_date AS VARCHAR) AS train_date, {r('b.static_threshold', 'static_threshold')}
FROM stored s LEFT JOIN base b ON b.elder_id = s.elder_id AND b.train_date < s.date""")
oracle("finetune_days", f"""
SELECT {KD}, {FEATS} FROM (
  SELECT *, count(*) OVER (PARTITION BY elder_id) AS cnt FROM (
    SELECT *, row_number() OVER (PARTITION BY elder_id ORDER BY date DESC) AS rn FROM valid) v
  WHERE rn <= 30 AND NOT EXISTS (SELECT 1 FROM c10_src c WHERE c.elder_id = v.elder_id AND c.date = v.date AND c.is_deviation))
WHERE cnt >= 14""")
CTES["tuned"] = f"""
SELECT *, count(*) OVER w AS np, {fs('avg({f}) OVER w AS p_{f}')} FROM (
  SELECT *, count(*) OVER (PARTITION BY elder_id) AS cnt FROM (
    SELECT *, row_number() OVER (PARTITION BY elder_id ORDER BY date DESC) AS rn FROM valid) v
  WHERE rn <= 30 AND NOT EXISTS (SELECT 1 FROM c10_src c WHERE c.elder_id = v.elder_id AND c.date = v.date AND c.is_deviation))
WHERE cnt >= 14 WINDOW w AS (PARTITION BY elder_id ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)"""
_dev = "(t.{f} - t.p_{f}) / b.scale_{f}"
CTES["half"] = f"""
SELECT elder_id, max(t.date) AS tuned_on, count(*) AS nw, {fs(f'avg(abs({_dev})) AS rm_{{f}}')}, {fs(f'stddev_pop(abs({_dev})) AS rs_{{f}}')},
  {fs(f'avg({_dev}) AS sm_{{f}}')}, {fs(f'stddev_pop({_dev}) AS ss_{{f}}')}
FROM tuned t JOIN base b USING (elder_id) WHERE np = 7 GROUP BY 1"""
CTES["tuned_stats"] = f"""
SELECT elder_id, h.tuned_on, h.nw, {", ".join(fs(f'0.7::DOUBLE * b.{c}_{{f}} + 0.3::DOUBLE * h.{c}_{{f}} AS {c}_{{f}}') for c in ("rm", "rs", "sm", "ss"))}
FROM half h JOIN base b USING (elder_id)"""
_mix = lambda c, n: r(f"coalesce(0.7::DOUBLE * b.{c}_{{f}} + 0.3::DOUBLE * h.{c}_{{f}}, b.{c}_{{f}})", n)
oracle("merged_residual_stats", _long(
    f"SELECT elder_id, '{{f}}' AS feature, {_mix('rm', 'resid_mean')}, {_mix('rs', 'resid_std')}, {_mix('sm', 'signed_mean')}, {_mix('ss', 'signed_std')}",
    "base b LEFT JOIN half h USING (elder_id)"))
_tuned_limit = f"{weighted('n.rm_{f}')} + 2.5::DOUBLE * {weighted('n.rs_{f}')}"
oracle("weekly_baselines", _long(
    f"""SELECT elder_id, CAST(n.tuned_on AS VARCHAR) AS train_date, b.n_train_days, n.nw AS n_windows,
  {r(_tuned_limit, 'static_threshold')},
  CAST(w.ewma_n_at_train AS BIGINT) AS ewma_n_at_train, {r('w.ewma_mean_at_train', 'ewma_mean_at_train')}, {r('w.ewma_var_at_train', 'ewma_var_at_train')},
  '{{f}}' AS feature, {r('b.mean_{f}', 'scaler_mean')}, {r('b.scale_{f}', 'scaler_scale')}, {r('n.rm_{f}', 'resid_mean')},
  {r('n.rs_{f}', 'resid_std')}, {r('n.sm_{f}', 'signed_mean')}, {r('n.ss_{f}', 'signed_std')}""",
    "tuned_stats n JOIN base b USING (elder_id) JOIN warm_end w USING (elder_id)"))
oracle("cold_start_scores", f"SELECT {KD}, {r('anomaly_score')}, is_deviation, {', '.join(r(f'z_{f}') for f in FEATURES)} FROM c30_src")
oracle("mean_forecast", f"SELECT {KD}, n_hist, {', '.join(r(f'past_{f}') for f in FEATURES)} FROM hist")
_std = lambda v, n: f"(CASE WHEN {n} < 2 THEN 1.0 ELSE greatest(sqrt({v}), 1e-8) END)"
oracle("ewma_states", f"""
SELECT elder_id, CAST(s.date AS VARCHAR) AS date, n_before, {r('mean_before')}, {r('var_before')}, e.i AS ewma_n, {r('ewma_mean')}, {r('ewma_var')},
  {r(_std('ewma_var', 'e.i'), 'ewma_std')}, {r('mean_before + 2.5::DOUBLE * ' + _std('var_before', 'n_before'), 'threshold_before')}
FROM cold_seq_ewma e JOIN cold_seq s USING (elder_id, i)""")
oracle("ewma_final", f"""
SELECT elder_id, {r('arg_max(ewma_mean, i)', 'ewma_mean')}, {r('arg_max(ewma_var, i)', 'ewma_var')}, max(i) AS ewma_n FROM cold_seq_ewma GROUP BY 1""")
oracle("score_percentiles", f"""
SELECT elder_id, count(*) AS n_scores, {r('CASE WHEN count(*) < 3 THEN max(anomaly_score) + 2.5 ELSE quantile_cont(anomaly_score, 0.9) END', 'score_percentile')}
FROM cold GROUP BY 1""")
oracle("score_percentiles_merged", f"SELECT elder_id, count(*) AS n_scores, {r('quantile_disc(anomaly_score, 0.9)', 'score_percentile')} FROM cold GROUP BY 1")
_some, _rows = "names <> ''", ", ".join(r(c) for c in ("anomaly_score", "static_threshold", "ewma_threshold", "dynamic_threshold"))
for _q, _p in (("daily_results", "std"), ("daily_results_stored", "std"), ("daily_results_two_versions", "two"),
               ("daily_results_sensitive", "low"), ("daily_results_by_steps", "std")):
    oracle(_q, f"""
SELECT {KD}, data_quality, CAST(missing_count AS BIGINT) AS missing_count, status, {_rows}, is_deviation, in_observation_period,
  {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in ('ewma_n', 'judged_streak', 'consecutive_deviation_days', 'reported_streak', 'risk_level'))},
  {r('ewma_mean')}, {r('ewma_std')}, {r('avg_anomaly_7d')}, {r('max_anomaly_7d')}, {LABEL_CASE} AS risk_label, risk_types,
  CASE WHEN status = 'success' THEN {advice('risk_level', _some, 'comma', 'names', 'judged_streak')} END AS recommendation,
  {', '.join(r(f'res_{f}') for f in FEATURES)} FROM {_p}_final""")
_judged = f"""{KD}, {r('anomaly_score')}, is_deviation, {r('avg_anomaly_7d')}, {r('max_anomaly_7d')}, judged_streak,
  consecutive_deviation_days, reported_streak, risk_level, {LABEL_CASE} AS risk_label"""
oracle("risk_levels", f"SELECT {_judged} FROM c30_judged")
oracle("risk_levels_sensitive", f"SELECT {_judged}, {advice('risk_level', 'false', chr(39) * 2, chr(39) * 2, 'judged_streak')} AS recommendation FROM c10_judged")
for _q, _k in (("risk_types", "s"), ("risk_types_unsigned", "u")):
    oracle(_q, f"""
SELECT {KD}, risk_key, risk_type, {r('score')}, exceeding_features, consecutive_days, CAST(threshold_required AS BIGINT) AS threshold_required,
  is_active FROM low_types{_k} WHERE status = 'success'""")
oracle("risk_contributions", " UNION ALL ".join(
    f"SELECT '{x.key}' AS risk_key, '{f}' AS feature, {r(f'{w / sum(x.weights)}::DOUBLE', 'importance')}, "
    f"{r(f'{w / sum(x.weights)}::DOUBLE * avg(res_{f})', 'contribution')} FROM low_judged"
    for x in RISK_RULES for f, w in zip(x.features, x.weights)))


def alert_select(source: str, names: str) -> str:
    pick = lambda fn: "CASE risk_level " + " ".join(f"WHEN {n} THEN {fn(n)}" for n in ROUTES) + " END"
    who = f"CASE WHEN {names} <> '' THEN {names} ELSE '多项指标' END"
    msg = lambda n: "''" if n == 0 else f"'{MESSAGES[n][0]}' || CAST(elder_id AS VARCHAR) || '老人' || {who} || '{MESSAGES[n][1]}'"
    q = lambda xs: "'" + ",".join(xs) + "'"
    return f"""
SELECT {KD}, risk_level, risk_level >= 2 AS alerted, {pick(lambda n: f"'{LEVEL_NAMES[n]}'")} AS alert_level, {LABEL_CASE} AS alert_label,
  {pick(lambda n: f"'{ROUTES[n]['action']}'")} AS action, {pick(lambda n: q(ROUTES[n]['notify']))} AS recipients,
  {pick(lambda n: q(executed_actions(n)))} AS actions, {pick(lambda n: str(ROUTES[n]['in_report']))} AS in_report,
  {pick(lambda n: str(ROUTES[n]['highlight']))} AS highlight, {pick(msg)} AS message FROM {source}"""


oracle("alert_rows", alert_select("low_final WHERE status = 'success' AND risk_level >= 1", "names"))
CTES["c10_named"] = f"SELECT *, CASE WHEN z_sad_ratio > 1 THEN '{RISK_RULES[0].name}' ELSE '' END AS names FROM c10_judged"
oracle("cold_start_alerts", alert_select("c10_named", "names"))
oracle("acute_levels", """
SELECT elder_id, epoch_us(ts) AS ts,
  CASE WHEN sad_ratio > 0.3 AND avg_speed < 3.5 THEN 3 WHEN sad_ratio > 0.25 AND avg_speed < 3.8 THEN 2
       WHEN sad_ratio > 0.2 OR distress_events > 3 THEN 1 ELSE 0 END::BIGINT AS demo_level,
  CASE WHEN sad_ratio > 0.25 THEN 3 WHEN sad_ratio > 0.2 THEN 2 WHEN sad_ratio > 0.15 THEN 1 ELSE 0 END::BIGINT AS simple_level,
  CASE WHEN sad_ratio > 0.25 AND avg_speed < 3.5 AND distress_events > 5 THEN 3
       WHEN sad_ratio > 0.2 AND avg_speed < 3.8 AND distress_events > 3 THEN 2
       WHEN sad_ratio > 0.15 AND distress_events > 2 THEN 1 ELSE 0 END::BIGINT AS config_level FROM tr24""")
_weekkey = "elder_id, CAST(week_start AS VARCHAR) AS week_start, CAST(week_end AS VARCHAR) AS week_end"
oracle("weekly_summary", f"""
SELECT {_weekkey}, n_results, deviation_days, judged_streak, {r('avg_anomaly_7d')}, {r('max_anomaly_7d')}, risk_level, risk_label, risk_types,
  {', '.join(f'{k}_residual_trend' for k in _lines)}, {', '.join(f'{k}_week_change' for k in _lines)}, recommendation FROM week""")
oracle("weekly_text", f"SELECT elder_id, CAST(week_end AS VARCHAR) AS week_end, {BODY} AS body FROM week")
oracle("weekly_prompts", f"SELECT {_weekkey}, {_prompt()} AS prompt FROM week")
oracle("weekly_reports", f"SELECT {_weekkey}, {_markdown()} AS report, risk_label FROM week")
oracle("recognized_utterances", f"""
SELECT doc_id, CAST(pos AS BIGINT) AS pos, {r('start_sec')}, {r('end_sec')}, {r('duration_sec')}, text, speaker, emotion, {r('speech_rate')},
  pitch_mean FROM doc_utt""")
oracle("recognized_turns", turns("doc_utt", "doc_id", "pos", "''", "first_pos"))
oracle("speaker_turns", turns("day_talk", "elder_id, date", "ts, event_id", "'|'", "first_event_id").replace(
    "SELECT elder_id, date, first_pos", f"SELECT {KD}, first_pos", 1))
oracle("speaker_names", f"""
SELECT u.elder_id, CAST(u.date AS VARCHAR) AS date, event_id, speaker FROM utt u JOIN (
  SELECT elder_id, date, event_type, 'speaker_' || row_number() OVER (PARTITION BY elder_id, date ORDER BY t, e) AS speaker
  FROM (SELECT elder_id, date, event_type, min(ts) AS t, arg_min(event_id, (ts, event_id)) AS e FROM utt GROUP BY 1, 2, 3)) USING (elder_id, date, event_type)""")
oracle("conversation_turns", turns("conv", "conv_id", "turn", "chr(10)", "first_turn"))
oracle("page_text", f"""
SELECT page_id, {strip('html')} AS text, {emotion('html')} AS emotion, CAST(length({strip('html')}) AS BIGINT) AS n_chars,
  {r(f"length({strip('html')}) / greatest(0.1::DOUBLE, length(html) / 40)", 'speech_rate')} FROM pages""")
for _h in (24, 4, 1):
    oracle(f"trailing_{_h}h", f"SELECT {TRAIL_COLS} FROM tr{_h}")
oracle("day_snapshots", f"SELECT {KD}, {TRAIL_COLS.replace('elder_id, ', '', 1)} FROM snap")
_pick = lambda c, d, *src: "CASE " + " ".join(f"WHEN {s}.elder_id IS NOT NULL THEN {s}.{c}" for s in src) + f" ELSE {d} END"
_const = dict(zip(ACOUSTIC, ("0.05::DOUBLE", "4", "25", "0")))
oracle("acoustic_history", f"""
SELECT h.elder_id, CAST(end_date AS VARCHAR) AS end_date, CAST(h.date AS VARCHAR) AS date,
  CASE WHEN s.elder_id IS NOT NULL THEN 'snapshot' ELSE 'default' END AS source,
  {', '.join(r(_pick(c, d, 's'), c) for c, d in _const.items())}
FROM (SELECT elder_id, end_date, CAST(unnest(generate_series(end_date - 6, end_date, INTERVAL 1 DAY)) AS DATE) AS date
      FROM (SELECT elder_id, max(date) AS end_date FROM utt GROUP BY 1)) h
LEFT JOIN snap s ON s.elder_id = h.elder_id AND s.date = h.date""")
CTES["now_ac"] = acoustic_agg("(SELECT * FROM utt WHERE date = (SELECT max(date) FROM utt))", "elder_id")
oracle("daily_packages", f"""
SELECT c.elder_id, CAST(c.date AS VARCHAR) AS date,
  CASE WHEN l.elder_id IS NOT NULL THEN 'live' WHEN s.elder_id IS NOT NULL THEN 'snapshot' ELSE 'default' END AS source,
  {', '.join(r(_pick(c, d, 'l', 's'), c) for c, d in _const.items())}
FROM calendar c LEFT JOIN snap s ON s.elder_id = c.elder_id AND s.date = c.date
LEFT JOIN now_ac l ON l.elder_id = c.elder_id AND c.date = (SELECT max(date) FROM utt)""")
oracle("sliding_24h", f"SELECT {SLIDE_COLS} FROM sl24")
oracle("sliding_4h", f"SELECT {SLIDE_COLS} FROM sl4")
oracle("front_end_counters", f"""
SELECT elder_id, count(*) AS chunks, CAST(sum(CASE WHEN duration_sec > 5 THEN 2 ELSE 1 END) AS BIGINT) AS utterances,
  {r('sum(CASE WHEN duration_sec > 5 THEN duration_sec * 1.5::DOUBLE ELSE duration_sec END)', 'seconds')} FROM utt GROUP BY 1""")
_rates = ", ".join(f"round({e}, 4) AS {k}" for k, e in RATES.items()) + ", tp, fp, tn, fn, tp + fp + tn + fn AS total"
oracle("detection_metrics", f"SELECT {_rates} FROM truth_conf")
oracle("detection_metrics_by_language", f"SELECT lang, {_rates} FROM truth_lang")
oracle("false_positive_rate", f"SELECT source, {r(RATES['fpr'], 'fpr')} FROM truth_source")
oracle("truth_pairing", """
SELECT count(*) AS n_keys, count(*) FILTER (t.doc_id IS NULL) AS no_truth, count(*) FILTER (d.doc_id IS NULL) AS no_prediction
FROM truth t FULL JOIN documents d ON d.doc_id = t.doc_id""")
oracle("threshold_comparison", """
SELECT *, round(population_fpr - personal_fpr, 4) AS fpr_reduction,
  CASE WHEN personal_fpr > 0 THEN round(population_fpr / personal_fpr, 2) ELSE 'infinity'::DOUBLE END AS fpr_reduction_ratio
FROM cmp_personal CROSS JOIN cmp_population""")
oracle("early_warning", f"""
SELECT {r('avg(e.d - w.d)', 'mean_lead_days')}, count(*) AS n_events
FROM (SELECT elder_id, max(date) AS d FROM sad_days WHERE actual GROUP BY 1) e
JOIN (SELECT elder_id, min(date) AS d FROM cold WHERE anomaly_score > 1.5 GROUP BY 1) w USING (elder_id)""")
oracle("alert_rate", """
SELECT round(a / t, 4) AS alerts_per_elder_day, a AS total_alerts, t AS total_elder_days
FROM (SELECT (SELECT count(*) FROM c10_judged WHERE risk_level >= 2 AND date BETWEEN DATE '2024-01-08' AND DATE '2024-01-28') AS a,
             (SELECT count(DISTINCT elder_id) FROM utt) * 21 AS t)""")
oracle("stream_sliding_24h", f"SELECT {SLIDE_COLS} FROM sl24 WHERE w_end <= (SELECT max(ts) FROM utt) - INTERVAL 1 HOUR")
def expiries(hours: int) -> str:
    """The first full millisecond after a window of silence: before a later arrival, or behind the last one if the final watermark
    (an hour before the last event of all) has passed it."""
    end = f"(epoch_us(ts) + {hours} * 3600000000) // 1000 + 1"
    return f"""
SELECT elder_id, ({end}) * 1000 AS ts, {hours}.0::DOUBLE AS hours, 0.05::DOUBLE AS sad_ratio, 4.0::DOUBLE AS avg_speed, 25.0::DOUBLE AS pitch_variability,
  0.0::DOUBLE AS distress_events, 0::BIGINT AS n_utterances, 0.0::DOUBLE AS total_duration
FROM (SELECT elder_id, ts, lead(ts) OVER (PARTITION BY elder_id ORDER BY ts) AS next,
        (SELECT epoch_us(max(ts)) // 1000 - 3600000 FROM utt) AS mark FROM (SELECT DISTINCT elder_id, ts FROM utt))
WHERE CASE WHEN next IS NULL THEN {end} <= mark ELSE epoch_us(next) - epoch_us(ts) > {hours} * 3600000000 END"""


_cols = f"{', '.join(r(c) for c in ACOUSTIC)}, n_utterances, {r('total_duration')}"
oracle("stream_trailing_24h", f"SELECT DISTINCT {TRAIL_COLS} FROM tr24 UNION ALL SELECT elder_id, ts, {_cols} FROM ({expiries(24)})")
oracle("stream_trailing_multi", " UNION ALL ".join(
    f"SELECT DISTINCT elder_id, epoch_us(ts) AS ts, {h}.0::DOUBLE AS hours, {_cols} FROM tr{h} "
    f"UNION ALL SELECT elder_id, ts, hours, {_cols} FROM ({expiries(h)})" for h in (24, 4, 1)))
CTES["files"] = "SELECT *, CAST(floor(day(ts) / 8) AS INTEGER) + (event_id % 6 = 0)::INT AS file FROM utt"
CTES["marks"] = "SELECT n.file, (SELECT epoch_us(max(ts)) - 3600000000 FROM files p WHERE p.file < n.file) AS mark FROM (SELECT DISTINCT file FROM files) n"
oracle("stream_late_rows", """
SELECT elder_id, count(*) FILTER (WHERE NOT late) AS on_time, count(*) FILTER (WHERE late) AS late, epoch_us(max(CASE WHEN late THEN ts END)) AS last_late
FROM (SELECT elder_id, ts, coalesce(epoch_us(ts) < mark, false) AS late FROM files JOIN marks USING (file)) GROUP BY 1""")
oracle("stream_ewma", f"""
SELECT elder_id, CAST(s.date AS VARCHAR) AS date, {r('x', 'anomaly_score')}, n_before, {r('mean_before')}, {r('var_before')},
  {r('t', 'dynamic_threshold')}, x > t AS is_deviation, i AS ewma_n, {r('ewma_mean')}, {r('ewma_var')}
FROM (SELECT *, CASE WHEN n_before >= 20 THEN least(1.5, mean_before + 2.5::DOUBLE * {_std('var_before', 'n_before')}) ELSE 1.5 END AS t
      FROM cold_seq_ewma) e JOIN (SELECT elder_id, i, date FROM cold_seq) s USING (elder_id, i)""")
# Version 3 before 2 (the larger wins), 5 states its day completely, 6 withdraws, 4 comes last but is older than 5 and 6.
oracle("upserted_days", f"""
SELECT {KD}, {r("CASE WHEN date = DATE '2024-01-09' THEN sad_ratio WHEN elder_id % 4 = 1 OR elder_id % 7 = 0 THEN 4.0 WHEN elder_id % 2 = 0 THEN 2.0 "
                "WHEN elder_id % 3 = 0 THEN 3.0 ELSE sad_ratio END", "sad_ratio")},
  {r("CASE WHEN date = DATE '2024-01-09' THEN -1.0 ELSE sfi END", "sfi")}
FROM daily WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-15' AND NOT (date = DATE '2024-01-09' AND elder_id % 5 = 0)
  AND NOT (date >= DATE '2024-01-12' AND elder_id % 7 = 0)""")
