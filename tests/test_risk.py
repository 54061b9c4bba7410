"""Streaks, levels, risk types, alerts, reports and metrics."""

import datetime as dt

import numpy as np
import pytest
from helpers import by_day, day

from driftwatch.config import FEATURES, RISK_RULES, RiskRule, Settings
from driftwatch.operators import alerts, metrics, report, risk
from pyspark.sql import functions as F


def results(spark, rows, person="E001"):
    """rows: (score, deviation[, residual overrides])."""
    data = []
    for i, r in enumerate(rows):
        res = r[2] if len(r) > 2 else {}
        vals = [float(res.get(f, 0.0)) for f in FEATURES]
        data.append((person, day(i), float(r[0]), r[1], "success", True, *[abs(v) for v in vals], *vals,
                     [0.0] * 10, [1.0] * 10, [0.0] * 10, [1.0] * 10))
    cols = ", ".join([f"res_{f} double" for f in FEATURES] + [f"signed_{f} double" for f in FEATURES])
    return spark.createDataFrame(data, "elder_id string, date date, anomaly_score double, is_deviation boolean, "
                                       f"status string, saved boolean, {cols}, resid_mean array<double>, "
                                       "resid_std array<double>, signed_mean array<double>, signed_std array<double>")


def levels(spark, rows):
    return [r["risk_level"] for r in by_day(risk.judge(results(spark, rows)))]


def test_levels(spark):
    assert levels(spark, [(1.2, True), (1.3, True), (1.4, True)]) == [1, 1, 2]
    assert levels(spark, [(2.0, True)] * 5)[-1] == 3
    assert levels(spark, [(0.5, True)] * 6)[-1] == 1       # long, but low
    assert levels(spark, [(1.6, False)]) == [1]             # spike alone
    assert levels(spark, [(0.4, False)] * 3) == [0, 0, 0]
    assert levels(spark, [(1.2, True)] * 3 + [(0.2, False)])[-1] == 0


def test_timeline(spark):
    got = levels(spark, [(0.5, False)] * 24 + [(2.4, True)] * 6)
    assert got[:24] == [0] * 24 and (got[24], got[26], got[28]) == (1, 2, 3)


def test_streak_columns(spark):
    got = by_day(risk.streaks(results(spark, [(1, True)] * 10 + [(1, False), (1, True)])))
    assert [r["judged_streak"] for r in got] == [1, 2, 3, 4, 5, 6, 7, 7, 7, 7, 0, 1]
    assert [r["consecutive_deviation_days"] for r in got][-4:] == [8, 8, 0, 1]
    assert [r["reported_streak"] for r in got][-4:] == [8, 8, 7, 1]


DEPRESSED = {"sad_ratio": 3.0, "avg_speed": -3.0, "pitch_variability": -2.5, "distress_events": 2.5}


def test_depression_needs_three_days(spark):
    got = by_day(risk.classify(results(spark, [(2, True, DEPRESSED)] * 4)))
    assert [r["depression_days"] for r in got] == [1, 2, 3, 4]
    assert [r["risk_types"] for r in got] == [[], [], ["抑郁风险"], ["抑郁风险"]]
    assert got[0]["depression_features"] == ["sad_ratio", "avg_speed", "pitch_variability", "distress_events"]
    assert got[0]["depression_score"] == pytest.approx((3 * 2.5 + 3 * 2 + 2.5 * 1.5 + 2.5 * 2) / 8)


def test_direction_matters(spark):
    up = {f: abs(v) for f, v in DEPRESSED.items()}
    got = by_day(risk.classify(results(spark, [(2, True, up)])))[0]
    assert got["depression_features"] == ["sad_ratio", "distress_events"]
    unsigned = by_day(risk.classify(results(spark, [(2, True, DEPRESSED)]), signed=False))[0]
    assert unsigned["depression_features"] == ["sad_ratio", "distress_events"]


def test_own_rules(spark):
    rule = RiskRule("any_sfi", "碎片", ("sfi",), ("any",), (1.0,), 1.0, 1)
    got = by_day(risk.classify(results(spark, [(1, True, {"sfi": -2.0}), (1, True, {"sfi": 0.5})]), Settings(rules=(rule,))))
    assert [r["risk_types"] for r in got] == [["碎片"], []]
    with pytest.raises(ValueError):
        RiskRule("x", "x", ("sfi",), ("up", "down"), (1.0,))
    with pytest.raises(ValueError):
        RiskRule("x", "x", ("sfi",), ("sideways",), (1.0,))


def test_importance():
    got = risk.importance(RISK_RULES, "depression")
    assert sum(got.values()) == pytest.approx(1) and got["sad_ratio"] == 2.5 / 8
    assert risk.importance(RISK_RULES, "nope") == {}


def test_alerts(spark):
    df = spark.createDataFrame([(n, ["抑郁风险", "睡眠问题"] if n == 3 else []) for n in (0, 1, 2, 3, 99)],
                               "risk_level int, risk_types array<string>").withColumn("elder_id", F.lit("E001"))
    got = {r["risk_level"]: r for r in alerts.with_alert(df).collect()}
    assert [got[n]["alerted"] for n in (0, 1, 2, 3, 99)] == [False, False, True, True, False]
    assert [got[n]["alert_level"] for n in (0, 1, 2, 3, 99)] == ["NORMAL", "ATTENTION", "WARNING", "SEVERE", "NORMAL"]
    assert got[99]["alert_label"] == "未知" and got[99]["message"] == "" and got[0]["actions"] == []
    assert got[1]["actions"] == ["log_alert"]
    assert got[2]["actions"] == ["log_alert", "push_to_children"]
    assert got[3]["actions"] == ["log_alert", "push_to_children", "push_to_community_worker", "force_ring"]
    assert got[2]["message"] == "【提醒】E001老人多项指标指标连续偏离常态，建议您主动联系老人了解近况"
    assert "抑郁风险、睡眠问题" in got[3]["message"]


def test_acute_rules(spark):
    rows = [(0.35, 3.0, 0.0), (0.35, 3.6, 0.0), (0.22, 5.0, 0.0), (0.0, 5.0, 4.0), (0.16, 5.0, 3.0), (0.1, 4.0, 0.0),
            (0.26, 3.0, 6.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                               "i int, sad_ratio double, avg_speed double, distress_events double")
    run = lambda form: [r[0] for r in df.orderBy("i").select(risk.acute_level(form)).collect()]
    assert run("demo") == [3, 2, 1, 1, 0, 0, 2]
    assert run("simple") == [3, 3, 2, 0, 1, 0, 3]
    assert run("config") == [0, 0, 0, 0, 1, 0, 3]
    with pytest.raises(ValueError):
        risk.acute_level("other")


def summary(spark, rows):
    df = risk.classify(results(spark, rows))
    return report.weekly_summary(df)


def test_week_trends(spark):
    rows = [(1.0, i >= 4, {"sad_ratio": 0.1 if i < 3 else 1.9, "social_turns": -2.0 if i < 3 else -0.1,
                           "sleep_efficiency": 0.2}) for i in range(7)]
    got = summary(spark, rows).first()
    assert (got["sad_residual_trend"], got["social_residual_trend"], got["sleep_residual_trend"]) == ("上升", "下降", "平稳")
    assert got["sad_week_change"] == "有明显增加" and got["sleep_week_change"] == "无明显变化"
    assert (got["deviation_days"], got["judged_streak"], got["n_results"]) == (3, 3, 7)
    assert got["week_start"] == day(0) and got["week_end"] == day(6)
    one = summary(spark, [(1.0, False)]).first()
    assert one["sad_residual_trend"] == "平稳" and one["sad_week_change"] == "无明显变化"


def test_weeks_are_counted_back_from_the_end(spark):
    got = summary(spark, [(1.0, False)] * 16).orderBy("week_end").collect()
    assert [(r["week_end"], r["n_results"]) for r in got] == [(day(1), 2), (day(8), 7), (day(15), 7)]


def test_report_text_and_label(spark):
    s = summary(spark, [(1.4, True)] * 7)
    text = report.markdown_report(s, "2026-08-01 00:00").withColumn("label", report.risk_label_of("report")).first()
    assert text["label"] == "严重"
    assert "本周异常天数：7/7" in text["report"] and "平均异常分：1.40" in text["report"]
    assert "E001老人本周有7天明显偏离日常状态，建议多加留意。" in text["report"]
    people = spark.createDataFrame([("E001",), ("E777",)], "elder_id string")
    empty = report.markdown_report(report.weeks_of(people, s, day(6)), "x").filter("elder_id = 'E777'").first()
    assert "数据不足" in empty["report"] and "检查设备" in empty["report"]
    assert spark.range(1).select(report.risk_label_of(F.lit("none"))).first()[0] == "未知"


@pytest.mark.parametrize("days,start", [(0, "整体状态平稳"), (2, "偶有轻微波动"), (4, "有4天出现"), (5, "有5天明显")])
def test_openers(spark, days, start):
    text = summary(spark, [(0.5, i < days) for i in range(7)]).select(report.rule_based_text()).first()[0]
    assert start in text


def test_prompt_defaults(spark):
    text = spark.range(1).select(report.prompt_text({"sad_trend": F.lit(None).cast("string"), "deviation_days": F.lit(3)})).first()[0]
    assert "趋势：平稳" in text and "异常天数：3天" in text and "需要关注的方向：无" in text and "{" not in text


# ---- metrics -------------------------------------------------------------

def truth(spark, actual, predicted):
    return spark.createDataFrame([(i, a == "T", p == "T") for i, (a, p) in enumerate(zip(actual, predicted))],
                                 "id int, actual boolean, predicted boolean")


def test_false_positive_rate(spark):
    assert metrics.false_positive_rate(truth(spark, "FFFF", "TFTF")).first()["fpr"] == 0.5
    assert metrics.false_positive_rate(truth(spark, "TTTT", "TFTF")).first()["fpr"] == 0.0


def test_detection_metrics(spark):
    got = metrics.detection_metrics(truth(spark, "TTTFFFFF", "TTFTFFFF")).first()
    assert (got["tp"], got["fp"], got["tn"], got["fn"], got["total"]) == (2, 1, 4, 1, 8)
    assert (got["accuracy"], got["precision"], got["recall"], got["f1_score"], got["fpr"], got["specificity"]) == (
        0.75, 0.6667, 0.6667, 0.6667, 0.2, 0.8)
    none = metrics.detection_metrics(truth(spark, "T", "T").filter("false")).first()
    assert none["accuracy"] == none["f1_score"] == none["fpr"] == 0.0


def test_pairing(spark):
    t = truth(spark, "TF", "TF")
    p = metrics.pair(t.select("id", "actual"), t.filter("id = 1").select("id", "predicted"), ["id"])
    assert tuple(metrics.orphans(p).first()) == (2, 0, 1)


def test_lead_days_and_alert_rate(spark):
    d = lambda s: dt.date.fromisoformat(s)
    df = spark.createDataFrame([(d("2026-08-10"), d("2026-08-07")), (d("2026-08-10"), d("2026-08-11"))],
                               "event_date date, warning_date date")
    assert metrics.early_warning_days(df).first()["mean_lead_days"] == 1.0
    res = spark.createDataFrame([("a", d("2026-08-01"), 2), ("a", d("2026-08-02"), 1), ("a", d("2026-09-02"), 3)],
                                "elder_id string, date date, risk_level int")
    people = spark.createDataFrame([("a",), ("b",)], "elder_id string")
    assert tuple(metrics.alert_rate(res, people, "2026-08-01", "2026-08-05").first()) == (0.2, 2, 10)
    assert metrics.alert_rate(res, people, "2026-08-01", "2026-08-05", 2).first()["total_alerts"] == 1


def test_threshold_comparison(spark):
    df = spark.createDataFrame([(0.5, 2.0, False), (0.5, 2.0, False), (1.5, 0.0, False), (2.0, 2.0, True)],
                               "p double, g double, actual boolean")
    got = metrics.compare_thresholds(df, "p", "g").first()
    assert (got["personal_fpr"], got["population_fpr"]) == (0.3333, 0.6667)
    assert got["fpr_reduction"] == 0.3334 and got["fpr_reduction_ratio"] == 2.0
    zero = metrics.compare_thresholds(df.filter("p <> 1.5"), "p", "g").first()
    assert np.isinf(zero["fpr_reduction_ratio"])


def test_acute_levels_on_a_limit_follow_plain_sums_in_order_of_arrival(spark):
    """Speech rates k / 12.5 whose mean is 3.8 (k: 47.5) up to the last digit, which the order of adding decides."""
    import random

    from driftwatch.plans import handoff

    rnd, rows, want, start = random.Random(1), [], {}, dt.datetime(2026, 3, 1, 6)
    for person in range(300):
        n = rnd.choice((6, 8, 10))
        k = [rnd.randrange(20, 76) for _ in range(n - 1)]
        k += [round(47.5 * n) - sum(k)]
        minutes = sorted(rnd.sample(range(0, 1400), n))
        speed = dur = sad = 0.0
        for i, (m, x) in enumerate(zip(minutes, k)):
            rows.append((person, start + dt.timedelta(minutes=m), 3.0, "sad" if i % 3 == 0 else "neutral", x / 12.5, 200.0))
            speed, dur, sad = speed + x / 12.5, dur + 3.0, sad + (3.0 if i % 3 == 0 else 0.0)
        sad, speed = sad / dur, speed / n
        want[person] = 3 if sad > .30 and speed < 3.5 else 2 if sad > .25 and speed < 3.8 else 1 if sad > .20 else 0
    u = spark.createDataFrame(rows, "elder_id int, ts timestamp, duration_sec double, emotion string, speech_rate double, pitch_mean double")
    arrivals = handoff.trailing_features(u, digits=False)
    last = lambda df: {r[0]: r[1] for r in df.select("elder_id", F.struct("ts", risk.acute_level("demo").alias("level")).alias("s"))
                       .groupBy("elder_id").agg(F.max_by("s.level", "s.ts")).collect()}
    assert len(set(want.values())) > 1
    assert last(handoff.with_ties_in_order(arrivals, u, risk.ACUTE_LIMITS)) == want != last(arrivals)


def test_large_scores_are_rounded_as_in_sql(spark):
    import duckdb

    from driftwatch.catalog.queries import six_digits, tidy

    rng = np.random.default_rng(3)
    x = np.concatenate([rng.uniform(-1, 1, 3000) * 10.0 ** rng.integers(-3, 12, 3000),
                        559887553.1151 + np.arange(3000) * 2.0 ** -23, [0.0, -0.0, 1e300, -4e-7, np.nan, np.inf]])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, x double")
    want = duckdb.sql("SELECT round(unnest($1), 6) + 0.0", params=[x.tolist()]).fetchnumpy()
    got = [r.y for r in df.select("i", six_digits(F.col("x")).alias("y")).orderBy("i").collect()]
    assert np.array_equal(got, list(want.values())[0], equal_nan=True)
    assert tidy(df.filter("x > 1e8 AND x < 1e9").select("x")).count() >= 3000
