"""Outlier days, gate, scaler, EWMA, cold start and the daily job."""

import datetime as dt

import numpy as np
import pytest
from helpers import by_day, day, feature_rows

from driftwatch.config import FEATURES, WEIGHTS, Settings
from driftwatch.operators import baseline, ewma, health, scoring
from driftwatch.operators.asof import as_of_join
from driftwatch.plans import daily
from driftwatch.sources import tables


def wobble(i, scale=1.0):
    """Small fixed variation around the normal values."""
    step = [0.6, -0.8, 0.3, -0.2, 1.0, -0.9, 0.1, -0.5, 0.8, -0.4]
    base = [0.05, 4.5, 32.0, 0.5, 0.87, 0.3, 4.5, 48.0, 5000.0, 30.0]
    return {f: b * (1 + 0.03 * scale * step[(i + j * 3) % 10]) for j, (f, b) in enumerate(zip(FEATURES, base))}


BAD = {"sad_ratio": 0.9, "avg_speed": 1.0, "distress_events": 10.0}


def marked(spark, rows):
    days = daily.labelled_days(feature_rows(spark, rows)).filter("stored")
    return health.flag_outliers(health.mark_enrolment(days))


def test_injected_day_is_found(spark):
    rows = [wobble(i) for i in range(20)]
    rows[5] = {**rows[5], **BAD}
    got = by_day(health.outlier_days(marked(spark, rows)))
    assert len(got) == 14 and [r["date"] for r in got if r["outlier_day"]] == [day(5)]
    assert got[5]["bad_features"] == ["sad_ratio", "avg_speed", "distress_events"]
    text = health.describe_outliers(marked(spark, rows)).first()["description"]
    assert text == "Day#5: 离群特征=[sad_ratio, avg_speed, distress_events]"


def test_single_spike_is_no_bad_day_and_constant_column_is_quiet(spark):
    rows = [wobble(i) for i in range(14)]
    rows[3]["sad_ratio"] = 0.9
    for r in rows:
        r["sfi"] = 4.0
    got = by_day(health.outlier_days(marked(spark, rows)))
    assert got[3]["bad_count"] == 1 and not any(r["outlier_day"] for r in got)
    assert not any(r["bad_sfi"] for r in got)


@pytest.mark.parametrize("n,bad,gate", [(13, 0, "too_few_valid_days"), (14, 0, "ok"), (14, 6, "ok"),
                                        (14, 7, "too_few_after_removal"), (14, 8, "too_many_outliers")])
def test_gate(spark, n, bad, gate):
    rows = [wobble(i) for i in range(n)]
    for i in range(bad):  # each bad day has two features of its own far off
        for f in (FEATURES[(2 * i) % 10], FEATURES[(2 * i + 1) % 10]):
            rows[i][f] *= 5
    got = health.training_gate(marked(spark, rows)).first()
    assert (got["n_outliers"], got["gate"]) == (bad, gate)
    kept = health.training_days(marked(spark, rows)).count()
    assert kept == (n - bad if gate == "ok" else 0)


def test_scaler_round_trip_and_constant(spark):
    rows = [{**wobble(i), "sfi": 4.0} for i in range(10)]
    df = feature_rows(spark, rows)
    sc = baseline.fit_scaler(df)
    assert sc.first()["scale_sfi"] == 1.0
    data = np.array([[r[f] for f in FEATURES] for r in by_day(df)])
    scaled = np.array([[r[f] for f in FEATURES] for r in by_day(baseline.apply_scaler(df, sc))])
    std = data.std(0)
    std[FEATURES.index("sfi")] = 1
    np.testing.assert_allclose(scaled, (data - data.mean(0)) / std, atol=1e-9)
    back = baseline.apply_scaler(baseline.apply_scaler(df, sc), sc, inverse=True)
    np.testing.assert_allclose([[r[f] for f in FEATURES] for r in by_day(back)], data, rtol=1e-12)


class Loop:
    """EWMA by the definition."""

    def __init__(self, alpha):
        self.a, self.mean, self.var, self.n = alpha, None, 0.0, 0

    def update(self, x):
        if self.n == 0:
            self.mean = x
        else:
            self.var = self.a * (x - self.mean) ** 2 + (1 - self.a) * self.var
            self.mean = (1 - self.a) * self.mean + self.a * x
        self.n += 1


def scores(spark, xs, person="E001"):
    return spark.createDataFrame([(person, day(i), float(x)) for i, x in enumerate(xs)],
                                 "elder_id string, date date, anomaly_score double")


def test_ewma_window_and_fold_equal_the_loop(spark):
    xs = [1 + 0.5 * ((i * 7919) % 101) / 101 for i in range(400)]
    loop, want = Loop(0.05), []
    for x in xs:
        want.append((loop.n, loop.mean, loop.var))
        loop.update(x)
    got = by_day(ewma.ewma_states(scores(spark, xs), ["elder_id"], ["date"], "anomaly_score"))
    assert [r["n_before"] for r in got] == [w[0] for w in want]
    np.testing.assert_allclose([r["mean_before"] for r in got[1:]], [w[1] for w in want[1:]], rtol=1e-11)
    np.testing.assert_allclose([r["var_before"] for r in got], [w[2] for w in want], rtol=1e-11)
    end = ewma.ewma_fold(scores(spark, xs), ["elder_id"], "date", "anomaly_score").first()
    np.testing.assert_allclose([end["ewma_mean"], end["ewma_var"], end["ewma_n"]], [loop.mean, loop.var, 400], rtol=1e-11)


def test_ewma_continues_from_a_seed_and_skips_rows(spark):
    from pyspark.sql import functions as F

    first, rest = [1.0, 1.2, 0.9], [1.1, 50.0, 1.5, 0.7]
    loop = Loop(0.05)
    for x in first:
        loop.update(x)
    df = scores(spark, rest).withColumns({"m": F.lit(loop.mean), "v": F.lit(loop.var), "n": F.lit(loop.n),
                                          "ok": F.col("anomaly_score") < 50})
    got = by_day(ewma.ewma_states(df, ["elder_id"], ["date"], "anomaly_score", seed=("m", "v", "n"), only="ok"))
    for r in got:
        if r["ok"]:
            assert r["n_before"] == loop.n and abs(r["mean_before"] - loop.mean) < 1e-12
            loop.update(r["anomaly_score"])
            assert abs(r["ewma_var"] - loop.var) < 1e-12
        else:
            assert r["ewma_mean"] is None and r["ewma_n"] is None


def test_ewma_limits(spark):
    for alpha in (0, 1, -0.1, 1.5):
        with pytest.raises(ValueError):
            ewma.ewma_states(scores(spark, [1]), ["elder_id"], ["date"], "anomaly_score", alpha)
        with pytest.raises(ValueError):
            Settings(ewma_alpha=alpha)
    assert ewma.max_rows(0.05) > 10_000
    df = ewma.ewma_states(scores(spark, [1.0] * 30 + [10.0]), ["elder_id"], ["date"], "anomaly_score")
    got = by_day(df.selectExpr("*", ewma.ewma_threshold("ewma_mean", "ewma_var", "ewma_n", 2.5) + " AS t"))
    assert got[0]["t"] == 1.0 + 2.5 and got[30]["t"] > got[29]["t"]
    assert got[29]["t"] == pytest.approx(1.0, abs=1e-6)  # the floor of the deviation


def test_percentile(spark):
    df = scores(spark, range(1, 101)).unionByName(scores(spark, [1, 2], "few"))
    got = {r["elder_id"]: r for r in ewma.score_percentile(df, ["elder_id"], "anomaly_score", 50, "max(anomaly_score) + 9").collect()}
    assert got["E001"]["score_percentile"] == 50.5 and got["few"]["score_percentile"] == 11


def reference_cold_start(hist, today):
    total = 0.0
    for f, w in WEIGHTS.items():
        xs = np.array([h[f] for h in hist if h[f] is not None])
        if len(xs) >= 2 and today[f] is not None and xs.std() >= 1e-9:
            total += w * abs((today[f] - xs.mean()) / xs.std())
    return total / sum(WEIGHTS.values())


def test_cold_start_score(spark):
    rows = [{**wobble(i, 2), "sfi": 4.0} for i in range(20)]
    rows[19] = {**rows[19], **BAD}
    got = by_day(scoring.cold_start(feature_rows(spark, rows)))
    assert [r["fallback_score"] is None for r in got[:6]] == [True] * 5 + [False]
    full = [{f: r[f] for f in FEATURES} for r in by_day(feature_rows(spark, rows))]
    for i in range(5, 20):
        assert got[i]["fallback_score"] == pytest.approx(reference_cold_start(full[max(0, i - 14):i], full[i]), rel=1e-9)
    assert got[19]["fallback_deviation"] and got[19]["z_sfi"] == 0.0


def test_daily_job_statuses(spark):
    rows = [wobble(i) for i in range(40)]
    rows[35] = {**rows[35], **BAD}
    got = by_day(daily.daily_job(feature_rows(spark, rows)))
    status = [r["status"] for r in got]
    assert status[:5] == ["cold_start"] * 5 and status[5:14] == ["cold_start_fallback"] * 9
    assert status[14:21] == ["observation"] * 7 and status[21:] == ["success"] * 19
    assert got[14]["ewma_n"] == 8  # seven training scores and today's
    assert got[35]["is_deviation"] and got[35]["risk_level"] == 1
    assert all(r["risk_level"] is None for r in got[:21])
    with_gap = by_day(daily.daily_job(feature_rows(spark, rows[:25] + [None] + rows[26:])))
    assert [r["status"] for r in with_gap if r["date"] > day(25)][:7] == ["data_insufficient"] * 7


def test_daily_job_equals_a_loop(spark):
    """Forecast, residual, thresholds and EWMA against plain Python over the rows."""
    rows = [wobble((i * 7) % 23, 1 + i % 3) for i in range(45)]
    full = np.array([[r[f] for f in FEATURES] for r in rows])
    w = np.array(list(WEIGHTS.values()))
    flagged = by_day(health.outlier_days(marked(spark, rows)))
    train = full[[i for i, r in enumerate(flagged) if not r["outlier_day"]]]
    mean, std = train.mean(0), train.std(0)
    norm = (train - mean) / std
    res = np.array([np.abs(norm[i - 7:i].mean(0) - norm[i]) for i in range(7, len(norm))])
    loop = Loop(0.05)
    for r in res:
        loop.update(r @ w / w.sum())
    static = (res.mean(0) + 2.5 * res.std(0)) @ w / w.sum()
    got = by_day(daily.daily_job(feature_rows(spark, rows)))
    for i in range(14, 45):
        score = np.abs((full[i - 7:i].mean(0) - full[i]) / std) @ w / w.sum()
        limit = min(static, loop.mean + 2.5 * max(loop.var ** 0.5, 1e-8)) if loop.n >= 20 else static
        assert got[i]["anomaly_score"] == pytest.approx(score, rel=1e-9)
        assert got[i]["static_threshold"] == pytest.approx(static, rel=1e-9)
        assert got[i]["dynamic_threshold"] == pytest.approx(limit, rel=1e-9)
        assert got[i]["is_deviation"] == (score > limit)
        loop.update(score)


def test_stored_baselines_give_the_same_results(spark, tmp_path):
    rows = [wobble(i) for i in range(30)]
    feats = feature_rows(spark, rows)
    days = daily.labelled_days(feats)
    path = str(tmp_path / "baselines")
    tables.append_baselines(daily.first_baselines(days), path)
    stored = tables.read_baselines(spark, path)
    own = by_day(daily.score_days(days).select("date", "status", "anomaly_score", "dynamic_threshold"))
    for as_of in (False, True):
        other = by_day(daily.score_days(days, stored, as_of=as_of).select("date", "status", "anomaly_score", "dynamic_threshold"))
        assert [r["status"] for r in own] == [r["status"] for r in other]
        np.testing.assert_allclose([r["dynamic_threshold"] for r in own], [r["dynamic_threshold"] for r in other])


def test_as_of_is_strict_by_default(spark):
    left = spark.createDataFrame([("a", i) for i in range(5)], "k string, t int")
    right = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 0, "z")], "k string, at int, v string")
    run = lambda s: [r["v"] for r in as_of_join(left, right, ["k"], "t", "at", strict=s).orderBy("t").collect()]
    assert run(True) == [None, None, "x", "x", "y"] and run(False) == [None, "x", "x", "y", "y"]


def test_versions_and_rollback(spark, tmp_path):
    path = str(tmp_path / "b")
    for v in (1, 2, 3):
        tables.append_baselines(spark.createDataFrame([("a", v, v * 10)], "elder_id string, version int, x int"), path)
    assert tables.read_baselines(spark, path).first()["x"] == 30
    assert tables.read_baselines(spark, path, back=1).first()["x"] == 20
    assert tables.read_baselines(spark, path, version=1).first()["x"] == 10
    assert scoring.latest_baseline(spark.read.parquet(path)).first()["x"] == 30


def test_finetune_set_and_merge(spark):
    rows = [wobble(i) for i in range(40)]
    df = feature_rows(spark, rows)
    bad = spark.createDataFrame([("E001", day(i)) for i in (39, 38, 1)], "elder_id string, date date")
    got = by_day(baseline.finetune_days(df, bad))
    assert len(got) == 28 and got[0]["date"] == day(10) and got[-1]["date"] == day(37)
    assert baseline.finetune_days(df.filter(df.date < dt.date(2026, 7, 14)), bad).count() == 0
    sch = "elder_id string, version int, " + ", ".join(f"{n} array<double>" for n in baseline.RESIDUAL_STATS)
    old = spark.createDataFrame([("a", 1, [1.0, 2.0], [1.0, 1.0], [0.0, 0.0], [1.0, 1.0])], sch)
    new = spark.createDataFrame([("a", 1, [2.0, 4.0], [2.0, 1.0], [1.0, 0.0], [1.0, 2.0])], sch)
    m = baseline.merge_residual_stats(old, new).first()
    np.testing.assert_allclose(m["resid_mean"], [1.3, 2.6])
