"""Forecasters, streaming operators, files and tables."""

import datetime as dt
import json
from types import SimpleNamespace

import numpy as np
import pytest
from helpers import SF, by_day, day, feature_rows
from pyspark.sql import functions as F
from test_baseline import wobble

from driftwatch.config import FEATURES, Settings
from driftwatch.models import gru
from driftwatch.operators import acoustic, baseline, ewma, scoring
from driftwatch.plans import daily, handoff, weekly
from driftwatch.sources import events as ev
from driftwatch.sources import raw, tables
from driftwatch.streaming import live, stateful

QUICK = Settings(epochs=30, patience=10, finetune_epochs=10)


# ---- forecaster ----------------------------------------------------------

def test_gradient_matches_differences():
    rng = np.random.default_rng(0)
    theta = gru.initial(np.array([1, 2, 3]), 4)
    x, y, mask = rng.normal(size=(3, 5, 7, 10)), rng.normal(size=(3, 5, 10)), np.ones((3, 5))
    mask[1, 3:] = 0
    loss, grad = gru.loss_and_gradient(theta, x, y, mask, 4)
    for k in rng.integers(0, theta.shape[1], 25):
        up, down = theta.copy(), theta.copy()
        up[:, k] += 1e-6
        down[:, k] -= 1e-6
        diff = (gru.loss_and_gradient(up, x, y, mask, 4)[0] - gru.loss_and_gradient(down, x, y, mask, 4)[0]) / 2e-6
        np.testing.assert_allclose(diff, grad[:, k], atol=1e-6)


def test_size_and_overfitting():
    assert gru.n_parameters(16) == 1514 < 2000
    rng = np.random.default_rng(1)
    x, y, mask = rng.normal(size=(1, 1, 7, 10)), rng.normal(size=(1, 1, 10)), np.ones((1, 1))
    theta, first, best, _ = gru.fit(gru.initial(np.array([5]), 16), x, y, mask, np.array([5]), 16, 400, 0.02)
    pred, state = gru.forward(theta, x, 16)
    assert pred.shape == (1, 1, 10) and state.shape == (1, 1, 16)
    assert ((pred - y) ** 2).mean() < 0.01 * first[0]


def test_training_is_independent_of_company():
    rng = np.random.default_rng(2)
    rows = [rng.normal(size=(n, 10)) for n in (14, 10, 8)]
    seeds = np.array([11, 22, 33])

    def fit(which):
        x, y, mask = gru.windows([rows[i] for i in which], 7)
        return gru.fit(gru.initial(seeds[which], 8), x, y, mask, seeds[which], 8, 40, 1e-2, 15, 0.2)[0]

    together = fit([0, 1, 2])
    for i in range(3):
        np.testing.assert_allclose(fit([i])[0], together[i], rtol=1e-6, atol=1e-9)


def people(spark, n=3, days=40):
    df = None
    for p in range(n):
        part = feature_rows(spark, [wobble(i + p) for i in range(days)], f"E{p}")
        df = part if df is None else df.unionByName(part)
    return df


def test_train_score_finetune(spark, tmp_path):
    feats = people(spark)
    days = daily.labelled_days(feats)
    base = gru.train(daily.training_windows(days.filter("stored"), QUICK), QUICK)
    path = str(tmp_path / "base")
    tables.append_baselines(base, path)
    base = tables.read_baselines(spark, path)
    rows = base.collect()
    assert len(rows) == 3 and all(r["best_loss"] < r["first_loss"] for r in rows)
    assert all(len(r["weights"]) == 1514 and r["ewma_n_at_train"] == len(r["train_scores"]) for r in rows)
    got = daily.daily_job(feats, QUICK, baselines=base, predictor=gru.predictor(QUICK))
    got.write.parquet(str(tmp_path / "results"))
    got = spark.read.parquet(str(tmp_path / "results"))
    assert {r["status"] for r in got.collect()} == {"cold_start", "cold_start_fallback", "observation", "success"}
    assert got.filter("status = 'success' AND size(hidden_state) <> 16").count() == 0
    assert weekly.retrain(days, got, base, QUICK).count() == 0        # the weekly job carries on moving averages only
    recent = baseline.finetune_days(days.filter("stored AND valid"), got.filter("saved AND is_deviation"), QUICK)
    again = gru.finetune(recent, scoring.latest_baseline(base), QUICK).collect()
    assert [r["version"] for r in again] == [2, 2, 2]
    old = {r["elder_id"]: r for r in rows}
    for r in again:
        assert r["weights"] != old[r["elder_id"]]["weights"] and r["scaler_mean"] == old[r["elder_id"]]["scaler_mean"]
        assert r["ewma_n_at_train"] == old[r["elder_id"]]["ewma_n_at_train"] and r["train_date"] == day(39)


# ---- streams -------------------------------------------------------------

def test_sliding_stream_equals_table(spark):
    table = ev.utterances(ev.events(spark, SF))
    stream = ev.utterances(ev.event_stream(spark, SF))
    got = live.run_available(live.sliding_features(stream, "6 hours", "1 hour"), "t")
    end = table.agg(F.max("ts") - F.expr("INTERVAL 1 HOUR")).first()[0]
    want = live.sliding_features(table, "6 hours", "1 hour").filter(F.col("window_end") <= F.lit(end))
    key = ["elder_id", "window_end", "n_utterances", "distress_events"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, want.select(key).collect()))


def test_exact_stream_equals_table(spark):
    got = live.run_available(stateful.trailing_features(ev.utterances(ev.event_stream(spark, SF))), "t")
    want = handoff.trailing_features(ev.utterances(ev.events(spark, SF)))
    seen = {(r["elder_id"], r["ts"]): r for r in got.filter("n_utterances > 0").collect()}
    rows = want.collect()
    assert len(rows) == len(seen)
    for r in rows:
        s = seen[(r["elder_id"], r["ts"])]
        assert s["n_utterances"] == r["n_utterances"] and abs(s["sad_ratio"] - r["sad_ratio"]) < 2e-4
    silent = got.filter("n_utterances = 0").collect()
    assert silent and all((r["sad_ratio"], r["avg_speed"], r["pitch_variability"]) == (0.05, 4.0, 25.0) for r in silent)


def test_nine_scenes(spark):
    """Nine scenes two hours apart, five utterances each, a third of them sad."""
    rows = [(f"E{0}", dt.datetime(2026, 7, 18) + dt.timedelta(hours=2 * s, seconds=3 * u), 3.0,
             "sad" if s % 3 == 0 else "neutral", 4.0, 200.0) for s in range(9) for u in range(5)]
    df = spark.createDataFrame(rows, "elder_id string, ts timestamp, duration_sec double, emotion string, "
                                     "speech_rate double, pitch_mean double")
    got = handoff.trailing_features(df).orderBy(F.desc("ts")).first()
    assert (got["sad_ratio"], got["avg_speed"], got["n_utterances"], got["total_duration"]) == (0.3333, 4.0, 45, 135.0)


def test_stream_ewma_equals_table(spark, tmp_path):
    xs = [(f"E{p}", day(i), 1 + ((i * 37 + p) % 17) / 17.0, 1.6) for p in range(3) for i in range(40)]
    df = spark.createDataFrame(xs, "elder_id string, date date, anomaly_score double, static_threshold double")
    path = str(tmp_path / "scores")
    for half in ("date < '2026-07-20'", "date >= '2026-07-20'"):  # two batches, state in between
        df.filter(half).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = {(r["elder_id"], r["date"]): r for r in live.run_available(stateful.running_ewma(stream), "t").collect()}
    want = ewma.ewma_states(df, ["elder_id"], ["date"], "anomaly_score").collect()
    assert len(got) == len(want) == 120
    for w in want:
        g = got[(w["elder_id"], w["date"])]
        assert g["ewma_n"] == w["ewma_n"]
        np.testing.assert_allclose([g["ewma_mean"], g["ewma_var"]], [w["ewma_mean"], w["ewma_var"]], rtol=1e-10)


def test_snapshot_sinks_and_handoff(spark, tmp_path):
    table = ev.utterances(ev.events(spark, SF))
    src = str(tmp_path / "src")
    arrivals = handoff.trailing_features(table)
    arrivals.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(arrivals.schema).option("maxFilesPerTrigger", 1).parquet(src)
    live.keep_latest(stream, str(tmp_path / "latest"), str(tmp_path / "c1"), availableNow=True).awaitTermination()
    live.append_history(stream, str(tmp_path / "hist"), str(tmp_path / "c2"), at="ts", availableNow=True).awaitTermination()
    want = {(r["elder_id"], r["date"]): r["ts"] for r in handoff.day_snapshots(arrivals).collect()}
    latest = live.read_latest(spark, str(tmp_path / "latest"))
    assert {(r["elder_id"], r["date"]): r["ts"] for r in latest.collect()} == want
    assert spark.read.parquet(str(tmp_path / "hist")).count() == arrivals.count()
    asked = spark.createDataFrame([(0, dt.date(2024, 1, 3)), (-1, dt.date(2024, 1, 3))], "elder_id bigint, date date")
    hist = handoff.acoustic_history(asked, latest).collect()
    assert len(hist) == 14 and {r["source"] for r in hist if r["elder_id"] == -1} == {"default"}
    now = asked.withColumns({n: F.lit(9.0) for n in ("sad_ratio", "avg_speed", "pitch_variability", "distress_events")})
    pack = handoff.daily_package(asked, latest, now, "2024-01-03").collect()
    assert all(r["sad_ratio"] == 9.0 and r["sfi"] is None for r in pack)


def test_work_folder_uses_the_cluster_setting():
    def session(setting, master):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: setting), sparkContext=SimpleNamespace(master=master))

    assert live.work_folder(session("/shared/x/", "yarn"), "q").startswith("/shared/x/q-")
    assert live.work_folder(session(None, "local[8]"), "q") != live.work_folder(session(None, "local[8]"), "q")
    with pytest.raises(RuntimeError):
        live.work_folder(session(None, "yarn"), "q")


def test_counters(spark):
    df = spark.createDataFrame([("a", [(1.0,), (2.5,)]), ("a", [(None,)])], "elder_id string, utterances array<struct<duration_sec:double>>")
    assert tuple(live.counters(df).first()) == ("a", 2, 3, 3.5)


# ---- files and tables ----------------------------------------------------

def test_raw_files(spark, tmp_path):
    docs = {"sleep": {"sleep_efficiency": 0.85, "deep_sleep_ratio": None, "sfi": "5.2", "hrv_rmssd": "bad", "timestamp": "x"},
            "activity": {"daily_activity": 5000, "space_entropy": 1.0}, "acoustic": {
                "sad_ratio": 0.05, "avg_speed": 4.2, "pitch_variability": 30, "distress_events": 0}}
    for m, d in docs.items():
        f = tmp_path / m / "E001" / "2026-07-01.json"
        f.parent.mkdir(parents=True)
        f.write_text(json.dumps(d, indent=1))
    (tmp_path / "social" / "E002").mkdir(parents=True)
    (tmp_path / "social" / "E002" / "2026-07-02.json").write_text('{"social_turns": 30}')
    got = {r["elder_id"]: r for r in raw.raw_days(spark, str(tmp_path)).collect()}
    a = got["E001"]
    assert a["date"] == dt.date(2026, 7, 1) and a["sfi"] == 5.2 and a["daily_activity"] == 5000
    assert a["missing_names"] == ["deep_sleep_ratio", "hrv_rmssd", "social_turns"]
    assert got["E002"]["social_turns"] == 30 and got["E002"]["missing_raw"] == 9


def test_features_csv_and_duplicates(spark, tmp_path):
    f = tmp_path / "E009" / "features.csv"
    f.parent.mkdir()
    head = "date," + ",".join(FEATURES) + ",missing_count,data_quality\n"
    row = lambda d, sad, miss: f"{d},{sad}," + ",".join(["1.0"] * 9) + f",{miss},valid\n"
    f.write_text(head + row("2026-07-01", "0.1", 0) + row("2026-07-02", "", 1) + row("2026-07-02", "0.3", 0))
    df = tables.one_row_per_day(tables.read_features_csv(spark, str(f)))
    got = by_day(df)
    assert [r["elder_id"] for r in got] == ["E009"] * 2 and [r["sad_ratio"] for r in got] == [0.1, 0.3]


def test_writing_a_day_again_replaces_it(spark, tmp_path):
    path = str(tmp_path / "t")
    first = feature_rows(spark, [wobble(i) for i in range(5)]).withColumns({"missing_count": F.lit(0), "data_quality": F.lit("valid")})
    tables.save_daily_features(first, path)
    tables.save_daily_features(first.filter("date = '2026-07-02'").withColumn("sad_ratio", F.lit(7.0)), path)
    got = by_day(tables.read_daily(spark, path))
    assert len(got) == 5 and got[1]["sad_ratio"] == 7.0
    assert tables.between(tables.read_daily(spark, path), day(1), day(3)).count() == 3
    assert tables.on_day(tables.read_daily(spark, path), day(1), "E001").count() == 1
    with pytest.raises(ValueError):
        tables.between(first, "2030-01-01", "2030-01-02", must_exist=True)
    assert [r["date"] for r in tables.last_days(first, 2, until=day(3)).collect()] == [day(2), day(3)]


def test_result_export(spark, tmp_path):
    res = daily.export_results(daily.daily_job(people(spark, 1, 25)))
    tables.save_daily_results(res, str(tmp_path / "r"))
    back = tables.read_daily(spark, str(tmp_path / "r"))
    assert back.count() == res.count() and set(back.first()["feature_residuals"]) == set(FEATURES)
    doc = json.loads(tables.result_documents(res).first()["document"])
    assert doc["status"] and len(doc["feature_residuals"]) == 10


def test_weights_file(spark, tmp_path):
    f = tmp_path / "w.json"
    f.write_text('{"_comment": "x", "sad_ratio": 2.5}')
    got = tables.feature_weights(spark, str(f))
    assert list(got) == FEATURES and got["sad_ratio"] == 2.5 and got["sfi"] == 1.0
    assert Settings(weights={"sad_ratio": 2.5}).weight_sum == 11.5


def test_snapshot_documents(spark, tmp_path):
    new = {"date": "2026-07-18", "elder_id": "E001", "timestamp": "2026-07-18T10:00:00", "acoustic_data": {
        "sad_ratio": 0.1, "avg_speed": 4.0, "pitch_variability": 20.0, "distress_events": 1}, "statistics": {"n_utterances": 3, "total_duration": 9.0}}
    old = {**new, "elder_id": "E002", "acoustic_data": {"sad_ratio": 0.2, "avg_speed": 4.0, "avg_pitch": 200.0, "distress_events": 0}}
    for n, d in (("a", new), ("b", old)):
        (tmp_path / f"snapshot_{n}.json").write_text(json.dumps(d))
    got = {r["elder_id"]: r for r in tables.read_snapshot_json(spark, str(tmp_path)).collect()}
    assert got["E001"]["pitch_variability"] == 20.0 and got["E002"]["pitch_variability"] is None


def test_reports_table(spark, tmp_path):
    res = daily.daily_job(people(spark, 2, 30))
    rep = weekly.weekly_reports(res, "2026-08-01 00:00")
    tables.save_reports(rep, str(tmp_path / "rep"))
    tables.save_reports(rep, str(tmp_path / "rep"))
    assert spark.read.parquet(str(tmp_path / "rep")).count() == rep.count() > 4
