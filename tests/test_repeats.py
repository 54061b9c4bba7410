"""Repeated, partial and multi-version runs; long histories; streams of many files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from driftwatch.catalog import queries
from driftwatch.config import DAY, RiskRule, Settings
from driftwatch.operators import ewma, report, risk
from driftwatch.plans import daily, weekly
from driftwatch.session import work_folder
from driftwatch.sources import events as ev
from driftwatch.sources import tables
from driftwatch.streaming import live, stateful

from helpers import by_day, day, feature_rows

SF = "/root/testdata/sf0.001"


def wobble(i):
    return {"sad_ratio": 0.05 + 0.01 * (i * 7 % 5), "sfi": 4.5 + 0.3 * (i * 3 % 4), "social_turns": 30.0 + i * 5 % 7,
            "hrv_rmssd": 48.0 + i * 11 % 6}


def test_part_of_a_day_leaves_the_others(spark, tmp_path):
    path, row = str(tmp_path / "t"), lambda p, d, x: (p, day(d), x)
    make = lambda rows: spark.createDataFrame(rows, "elder_id string, date date, x int")
    tables.save_daily(make([row("a", 0, 1), row("b", 0, 2), row("a", 1, 3), row("b", 1, 4)]), path)
    tables.save_daily(make([row("a", 0, 9)]), path)
    got = lambda: sorted((r["elder_id"], r["date"], r["x"]) for r in tables.read_daily(spark, path).collect())
    assert got() == [("a", day(0), 9), ("a", day(1), 3), ("b", day(0), 2), ("b", day(1), 4)]
    tables.save_daily(make([row("b", 1, 7)]), path, days=[day(0), day(1)])
    assert got() == [("b", day(1), 7)]
    tables.save_daily(make([]), path, days=[day(1)])
    assert not list((tmp_path / "t").glob("date=*"))


def test_baselines_appended_twice_are_there_once(spark, tmp_path):
    path = str(tmp_path / "b")
    for v in (1, 2, 2):
        tables.append_baselines(spark.createDataFrame([("a", v, v * 10), ("b", v, v)], "elder_id string, version int, x int"), path)
    assert spark.read.parquet(path).count() == 4
    back = {r["elder_id"]: r["x"] for r in tables.read_baselines(spark, path, back=1).collect()}
    assert back == {"a": 10, "b": 1}


def test_judgement_goes_on_after_a_retrain(spark, tmp_path):
    days = daily.labelled_days(feature_rows(spark, [wobble(i) for i in range(50)]))
    first = daily.first_baselines(days)
    path = str(tmp_path / "b")
    tables.append_baselines(first, path)
    until = days.filter(F.col(DAY) <= F.lit(day(35)))
    results = daily.judge_days(daily.score_days(until, first))
    second = weekly.retrain(until, results, first)
    row = second.first()
    assert row["version"] == 2 and row["train_date"] > row["first_train_date"] == first.first()["train_date"]
    assert row["scaler_mean"] == first.first()["scaler_mean"] and row["static_threshold"] != first.first()["static_threshold"]
    tables.append_baselines(second, path)
    for as_of, base in ((True, spark.read.parquet(path)), (False, tables.read_baselines(spark, path))):
        got = by_day(daily.score_days(days, base, as_of=as_of))
        late = [r for r in got if r["date"] > row["train_date"]]
        assert len(late) >= 10 and all(r["status"] == "success" for r in late)
        assert [r["ewma_n"] for r in late] == list(range(late[0]["ewma_n"], late[0]["ewma_n"] + len(late)))


def test_ewma_of_any_length_and_decay(spark):
    for alpha, n in ((0.5, 5000), (0.05, 20000), (0.9, 400)):
        df = spark.range(n).selectExpr("'p' AS k", "id AS d", "abs(sin(id)) * 3 + 0.1 AS x")
        rows = ewma.ewma_states(df, ["k"], ["d"], "x", alpha).orderBy("d").collect()
        mean, var = rows[0]["x"], 0.0
        for r in rows[1:]:
            var = alpha * (r["x"] - mean) ** 2 + (1 - alpha) * var
            mean = (1 - alpha) * mean + alpha * r["x"]
            assert abs(r["ewma_mean"] - mean) < 1e-9 and abs(r["ewma_var"] - var) < 1e-9


def test_a_rule_of_ten_days_fires_on_day_ten(spark):
    rule = RiskRule("x", "x", ("sad_ratio",), ("up",), (1.0,), 2.0, 10)
    s = Settings(rules=(rule,))
    f = feature_rows(spark, [{} for _ in range(12)]).selectExpr(
        "elder_id", "date", *[f"5D AS signed_{c}" for c in tables.FEATURES],
        "array_repeat(0D, 10) AS signed_mean", "array_repeat(1D, 10) AS signed_std")
    got = by_day(risk.classify(f, s))
    assert [r["x_active"] for r in got] == [False] * 9 + [True] * 3


def test_everyone_gets_a_weekly_report(spark):
    rows = [wobble(i) for i in range(30)]
    quiet = feature_rows(spark, rows[:20], "E002")
    res = daily.daily_job(feature_rows(spark, rows).unionByName(quiet), end=day(29))
    people = spark.createDataFrame([("E001",), ("E002",), ("E003",)], "elder_id string")
    got = {r["elder_id"]: r for r in weekly.weekly_reports(res, "x", week_end=day(29), people=people).collect()}
    assert set(got) == {"E001", "E002", "E003"}
    assert "统计指标" in got["E001"]["report"] and "统计指标" in got["E002"]["report"] and "数据不足" in got["E003"]["report"]
    assert report.latest_summary(res, day(29)).filter("elder_id = 'E002'").first()["n_results"] == 7


def test_event_stream_of_a_folder_with_many_files(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").repartition(4).write.parquet(str(tmp_path / "events.parquet"))
    spark.range(3).write.parquet(str(tmp_path / "events_old.parquet"))
    got = live.run_available(ev.event_stream(spark, str(tmp_path)), "events")
    assert got.count() == ev.events(spark, SF).count() > 0


def test_stream_ewma_ignores_replays_and_takes_days_in_order(spark, tmp_path):
    schema, folder = "elder_id string, date date, anomaly_score double, static_threshold double", work_folder(spark, "scores")
    for batch in ([2, 1], [2, 3], [1, 5, 4]):
        spark.createDataFrame([("a", dt.date(2026, 7, d), d / 10, 1.5) for d in batch], schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = by_day(live.run_available(stateful.running_ewma(stream), "ewma"))
    assert [(r["date"].day, r["ewma_n"]) for r in got] == [(d, d) for d in range(1, 6)]


def test_latest_snapshots_are_read_by_day(spark, tmp_path):
    src = str(tmp_path / "src")
    rows = [("a", dt.datetime(2026, 7, d, h), float(h)) for d in (1, 2) for h in (9, 12)]
    spark.createDataFrame(rows, "elder_id string, ts timestamp, x double").repartition(2).write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", 1).parquet(src)
    path = str(tmp_path / "latest")
    live.keep_latest(stream, path, str(tmp_path / "c"), availableNow=True).awaitTermination()
    one = live.read_latest(spark, path, first=day(1), last=day(1))
    assert [(r["date"], r["x"]) for r in one.collect()] == [(day(1), 12.0)]
    assert "PartitionFilters: [isnotnull(date" in one._jdf.queryExecution().toString().replace("\n", " ")
    assert live.read_latest(spark, path).count() == 2


@pytest.mark.parametrize("name", ["daily_results_stored", "daily_results_two_versions"])
def test_jobs_with_stored_baselines_work_out_their_days_once(spark, monkeypatch, name):
    daily, seen = queries._daily, spark.sparkContext.accumulator(0)

    def counted(spark, d):
        def run(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        rows = daily(spark, d)
        return rows.mapInArrow(run, rows.schema)

    monkeypatch.setattr(queries, "_daily", counted)
    # The features are read for the days themselves and for their last date.
    assert queries.CATALOG[name](spark, SF).collect() and seen.value == 2 * daily(spark, SF).count()
