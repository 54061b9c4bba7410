"""Day-by-day runs and tables that several jobs write."""

import datetime as dt

import pytest
from helpers import by_day, day, feature_rows
from pyspark.sql import functions as F

from driftwatch.config import DAY, FEATURES, KEY, Settings
from driftwatch.plans import daily, steps
from driftwatch.sources import changes, tables

LOW = Settings(sigma=0.25, fallback_sigma=1.0, observation_days=1, ewma_min_samples=8)


def history(spark, folder):
    """Three people: one with gaps and offline days, one who starts late, one with an odd value and missing cells."""
    shape = lambda i, k: {"sad_ratio": 0.05 + 0.01 * ((i * 7 + k) % 5) + 0.2 * (i > 20 + k), "sfi": 4.5 + 0.3 * (i * 3 % 4),
                          "social_turns": 30.0 + i * 5 % 7, "hrv_rmssd": 48.0 + i * 11 % 6 - 6 * (i > 22)}
    gaps = {4: None, 5: None, 6: None, 7: None, 8: {f: None for f in FEATURES}, 17: {"sfi": None}}
    a = feature_rows(spark, [gaps.get(i, shape(i, 0)) if i in gaps else shape(i, 0) for i in range(30)], "a")
    b = feature_rows(spark, [None] * 9 + [shape(i, 3) for i in range(9, 27)], "b")
    odd = {2: {"avg_speed": -500.0}, 3: {"sfi": None, "hrv_rmssd": None, "avg_speed": None}, 19: {"avg_speed": None}}
    c = feature_rows(spark, [{**shape(i, 5), **odd.get(i, {})} for i in range(30)], "c")
    a.unionByName(b).unionByName(c).write.partitionBy(DAY).parquet(folder)
    return spark.read.parquet(folder)


def cells(df):
    return sorted((r[KEY], r[DAY], r["status"], r["is_deviation"], r["risk_level"], r["judged_streak"], r["reported_streak"],
                   tuple(r["risk_types"] or ()), r["recommendation"], r["ewma_n"],
                   *[None if r[c] is None else round(r[c], 9) for c in ("anomaly_score", "dynamic_threshold", "ewma_mean", "avg_anomaly_7d")])
                  for r in df.collect())


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    return history(spark, str(tmp_path_factory.mktemp("f") / "features"))


def test_days_in_groups_and_one_by_one_equal_the_whole_run(spark, table, tmp_path):
    want = cells(daily.daily_job(table, LOW))
    assert {"success", "observation", "cold_start_fallback", "cold_start"} <= {r[2] for r in want}
    once = steps.run_days(table, str(tmp_path / "once"), [day(29)], LOW)
    assert cells(once) == want
    cuts = [0, 2, 9, 13, 14, 21, 22, 29]
    assert cells(steps.run_days(table, str(tmp_path / "cut"), [day(i) for i in cuts], LOW)) == want


def test_counts_of_a_run_are_written_with_it(spark, table, tmp_path):
    folder = str(tmp_path / "s")
    out = steps.run_days(table, folder, [day(14), day(29)], LOW)
    got = [r.asDict() for r in spark.read.parquet(f"{folder}/metrics").orderBy(steps.THROUGH).drop(steps.THROUGH).collect()]
    days = daily.labelled_days(table)
    count = lambda df, where: df.filter(where).count()
    want = []
    for span in (f"date <= '{day(14)}'", f"date > '{day(14)}'"):
        d, r = days.filter(span), out.filter(span)
        want.append({"days": d.count(), "stored_days": count(d, "stored"), "valid_days": count(d, "valid"),
                     "offline_days": count(d, "data_quality = 'offline'"), "results": r.count(), "saved": count(r, "saved"),
                     "deviations": count(r, "saved AND is_deviation"), "raised": count(r, "risk_level > 0")})
    assert got == want and want[0]["offline_days"] and want[1]["raised"]


def test_a_day_run_again_gives_the_same(spark, table, tmp_path):
    folder = str(tmp_path / "s")
    steps.run_days(table, folder, [day(18), day(19)], LOW)
    before = cells(spark.read.parquet(f"{folder}/results/through={day(19)}"))
    state = sorted(map(str, spark.read.parquet(f"{folder}/state/through={day(19)}").collect()))
    steps.run_day(table, folder, day(19), LOW)
    assert cells(spark.read.parquet(f"{folder}/results/through={day(19)}")) == before
    assert sorted(map(str, spark.read.parquet(f"{folder}/state/through={day(19)}").collect())) == state
    (tmp_path / "s" / "state" / f"through={day(19)}" / "_SUCCESS").unlink()
    assert steps.read_state(spark, f"{folder}/state", day(20)).first()[steps.THROUGH] == day(18)


def test_state_is_bounded_and_a_step_reads_one_day(spark, table, tmp_path):
    folder = str(tmp_path / "s")
    steps.run_days(table, folder, [day(27)], LOW)
    state = steps.read_state(spark, f"{folder}/state", day(28))
    most = LOW.enrol_days + LOW.fallback_lookback + max(LOW.window, LOW.offline_days)
    assert all(len(r["history"]) <= most and len(r["results"]) <= 7 for r in state.collect()) and state.count() == 3
    fresh = table.filter((F.col(DAY) <= F.lit(day(28))) & (F.col(DAY) > F.lit(day(27))))
    plan = steps.step_results(steps.continued(fresh, state, day(28), LOW), LOW)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2 and f"{DAY}#" in plan.split("PartitionFilters: [")[1]
    hashed = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]
    assert len(hashed) <= 3 and all(f"({KEY}#" in x for x in hashed)


def test_no_features_give_no_results(spark, table, tmp_path):
    out = steps.run_day(table.filter("false"), str(tmp_path / "s"), day(3), LOW)
    assert out.count() == 0 and steps.read_state(spark, f"{tmp_path}/s/state", day(4)).count() == 0


# ---- tables --------------------------------------------------------------

def rows(spark, *data):
    return spark.createDataFrame([(p, day(d), x) for p, d, x in data], "elder_id string, date date, x int")


def read(spark, path, **more):
    return sorted((r[KEY], (r[DAY] - day(0)).days, r["x"]) for r in changes.current(spark, path, **more).collect())


def test_two_writers_of_one_day_keep_both_peoples_rows(spark, tmp_path):
    path, one, two = str(tmp_path / "t"), changes.new_version(), changes.new_version()
    # Both are written before either commits: the earlier version commits last.
    changes.upsert(rows(spark, ("b", 0, 2), ("c", 0, 22)), path, version=max(one, two))
    changes.upsert(rows(spark, ("a", 0, 1), ("c", 0, 11)), path, version=min(one, two))
    assert read(spark, path) == [("a", 0, 1), ("b", 0, 2), ("c", 0, 22)]


def test_uncommitted_writes_do_not_count(spark, tmp_path):
    path = str(tmp_path / "t")
    changes.upsert(rows(spark, ("a", 0, 1)), path)
    rows(spark, ("a", 0, 9)).withColumns({"_version": F.lit("z"), "_gone": F.lit(False)}).write.partitionBy(DAY).parquet(f"{path}/w=z")
    assert read(spark, path) == [("a", 0, 1)]
    assert changes.vacuum(spark, path, 0) == 1 and not (tmp_path / "t" / "w=z").exists()
    with pytest.raises(ValueError):
        changes.current(spark, str(tmp_path / "none"))


def test_whole_days_withdrawals_and_compaction(spark, tmp_path):
    path, at = str(tmp_path / "t"), lambda n: f"{n:020d}-x"
    changes.upsert(rows(spark, ("a", 0, 1), ("b", 0, 2), ("a", 1, 3), ("b", 1, 4)), path, version=at(1))
    changes.upsert(rows(spark, ("a", 0, 9)), path, whole=[day(0), day(5)], version=at(4))
    changes.withdraw(rows(spark, ("a", 1, 0)), path, version=at(5))
    assert read(spark, path) == [("a", 0, 9), ("b", 1, 4)]
    version = changes.compact(spark, path)
    assert read(spark, path) == [("a", 0, 9), ("b", 1, 4)] and [e["version"] for e in changes.log(spark, path)] == [version]
    # A write that began before them and commits after the compaction still loses to what was stated and withdrawn.
    changes.upsert(rows(spark, ("b", 0, 7), ("a", 1, 7), ("c", 1, 7)), path, version=at(3))
    want = [("a", 0, 9), ("b", 1, 4), ("c", 1, 7)]
    assert read(spark, path) == want
    assert changes.compact(spark, path) and read(spark, path) == want and changes.compact(spark, path) is None
    assert changes.vacuum(spark, path) == 0 and changes.vacuum(spark, path, 0) == 5 and read(spark, path) == want
    assert read(spark, path, where="date = '2026-07-02'") == want[1:]


def test_only_asked_partitions_are_read(spark, tmp_path):
    path = str(tmp_path / "t")
    for d in range(6):
        changes.upsert(rows(spark, ("a", d, d), ("b", d, d)), path)
    df = changes.current(spark, path, f"date = '{day(3)}'")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and read(spark, path, where=f"date = '{day(3)}'") == [("a", 3, 3), ("b", 3, 3)]
    with pytest.raises(Exception, match="there already"):
        changes._commit(spark, path, changes.log(spark, path)[0]["version"])


def test_saving_a_day_reads_that_day_only_and_leaves_nothing_behind(spark, tmp_path, monkeypatch):
    path, work = str(tmp_path / "t"), tmp_path / "work"
    monkeypatch.setattr(tables, "work_folder", lambda spark, name: f"{work}/{name}-{dt.datetime.now().timestamp()}")
    tables.save_daily(rows(spark, *[(p, d, d) for p in "ab" for d in range(8)]), path)
    (tmp_path / "t" / f"date={day(5)}").rename(tmp_path / "gone")
    (tmp_path / "t" / f"date={day(5)}").mkdir()
    (tmp_path / "t" / f"date={day(5)}" / "x.parquet").write_text("not a table: reading this partition fails")
    tables.save_daily(rows(spark, ("a", 3, 9)), path)
    got = by_day(spark.read.schema("elder_id string, x int, date date").parquet(path).filter(f"date = '{day(3)}'"))
    assert sorted((r[KEY], r["x"]) for r in got) == [("a", 9), ("b", 3)]
    assert not list(work.glob("rows-*"))
