"""Skew, partition invariance and brute-force checks of the ordered operators."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from helpers import SF

from driftwatch.operators.ordered import adjacent_sums, merge_runs, salted_join, trailing_sums
from driftwatch.streaming import live

EPOCH = dt.datetime(2026, 1, 1)


def skewed(n=600, seed=3):
    """A third of the rows belong to key 0, with many equal instants."""
    rnd = random.Random(seed)
    return [(0 if i % 3 == 0 else rnd.randrange(1, 9), i, EPOCH + dt.timedelta(minutes=rnd.randrange(0, 4000, 7)),
             rnd.choice("xyz"), float(rnd.randrange(100))) for i in range(n)]


def frame(spark, rows, parts):
    rows = list(rows)
    random.Random(parts).shuffle(rows)
    return spark.createDataFrame(rows, "k int, id int, ts timestamp, room string, v double").repartition(parts)


@pytest.fixture(params=[1, 3, 16])
def width(request, spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", old)


def in_order(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        groups.setdefault(r[0], []).append(r)
    return groups


def test_adjacent_sums(spark, width):
    rows = skewed()
    want = {k: (sum(a[3] != b[3] for a, b in zip(g, g[1:])), sum(abs(a[4] - b[4]) for a, b in zip(g, g[1:])), len(g))
            for k, g in in_order(rows).items()}
    got = adjacent_sums(frame(spark, rows, width), ["k"], ["ts", "id"], ["room", "v"],
                        {"moves": lambda a, b: (a["room"] != b["room"]).cast("int"), "path": lambda a, b: F.abs(b["v"] - a["v"])},
                        sums={"n": F.lit(1)})
    assert {r["k"]: (r["moves"], r["path"], r["n"]) for r in got.collect()} == want


def test_merge_runs(spark, width):
    rows = [(k, i, t, "x" if k == 0 and i % 50 else r, v) for k, i, t, r, v in skewed()]  # long runs in the hot key
    want = []
    for k, g in in_order(rows).items():
        run = [g[0]]
        for r in g[1:]:
            if r[3] == run[-1][3]:
                run.append(r)
            else:
                want.append(run)
                run = [r]
        want.append(run)
    want = sorted((r[0][0], r[0][1], r[0][3], "".join(str(x[1]) + "," for x in r), r[-1][1], len(r)) for r in want)
    df = frame(spark, rows, width).withColumn("text", F.concat(F.col("id").cast("string"), F.lit(",")))
    got = merge_runs(df, ["k"], ["ts", "id"], "room", "text", {"a": "id"}, {"b": "id"})
    assert sorted((r["k"], r["a"], r["room"], r["text"], r["b"], r["n_merged"]) for r in got.collect()) == want


def test_trailing_sums(spark, width):
    rows = skewed()
    got = trailing_sums(frame(spark, rows, width), ["k"], "ts", {"n": F.lit(1), "s": F.col("v")}, 3600, 900)
    got = {(r["k"], r["ts"]): (r["n"], r["s"]) for r in got.collect()}
    want = {}
    for k, i, t, r, v in rows:
        near = [x for x in rows if x[0] == k and t - dt.timedelta(hours=1) <= x[2] <= t]
        want[(k, t)] = (len(near), sum(x[4] for x in near))
    assert got == want
    with pytest.raises(ValueError):
        trailing_sums(frame(spark, rows, 1), ["k"], "ts", {"n": F.lit(1)}, 1000, 900)


def test_salted_join_keeps_every_row(spark):
    rows = skewed()
    left = frame(spark, rows, 4)
    right = left.groupBy("k").agg(F.sum("v").alias("total"))
    assert sorted(map(tuple, salted_join(left, right, ["k"], ["id"]).collect())) == sorted(
        map(tuple, left.join(right, "k").collect()))


def plan_of(df):
    """The plan that ran, without what it reuses."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_no_operator_puts_a_hot_key_into_one_window(spark):
    """Rows are put in order inside a bucket, never inside a bare key."""
    df = frame(spark, skewed(), 4)
    plan = adjacent_sums(df, ["k"], ["ts", "id"], ["room"], {"m": lambda a, b: (a["room"] != b["room"]).cast("int")})
    local = [x for x in plan._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window [lag(_here" in x]
    assert local and all("_bucket" in x for x in local)


@pytest.mark.parametrize("width", [None, 1, 60, 86400])
def test_any_bucket_width_gives_the_same(spark, width):
    df = frame(spark, skewed(), 4).withColumn("text", F.lit("t"))
    terms = {"moves": lambda a, b: (a["room"] != b["room"]).cast("int")}
    one = lambda w: sorted(map(tuple, adjacent_sums(df, ["k"], ["ts", "id"], ["room"], terms, width=w).collect()))
    two = lambda w: sorted(map(str, merge_runs(df, ["k"], ["ts", "id"], "room", "text", {"a": "id"}, {"b": "id"}, width=w).collect()))
    assert one(width) == one(10 ** 6) and two(width) == two(10 ** 6)


@pytest.mark.parametrize("name", ["room_entropy", "speaker_turns", "sleep_features", "social_features_strict_gap", "joint_displacement"])
def test_rows_are_read_once_and_dealt_once(spark, name):
    from driftwatch.catalog.queries import CATALOG

    plan = plan_of(CATALOG[name](spark, SF))
    scans = 2 if name == "sleep_features" else 1        # the nights are a second look at two columns of the events
    assert plan.count("FileScan parquet") == scans
    dealt = [x for x in plan.split("\n") if "REPARTITION_BY_COL" in x and "ReusedExchange" not in x]
    assert len(dealt) == 1 and "rangepartitioning" not in plan


def test_sliding_windows_of_a_table_deal_out_panes_only(spark):
    """Nothing is dealt out once panes are copied into windows; the windows equal those that F.window makes of rows."""
    rows = [(p, dt.datetime(2026, 3, 1) + dt.timedelta(minutes=m), 1.0 + m % 7, "sad" if m % 3 == 0 else "neutral", 3.0, 180.0 + m % 5)
            for p, ms in (("a", (0, 10, 29, 30, 1439, 1440, 1470, 3000, 9000)), ("b", (700,)), ("c", range(0, 4000, 7))) for m in ms]
    df = spark.createDataFrame(rows, "elder_id string, ts timestamp, duration_sec double, emotion string, speech_rate double, pitch_mean double")
    for window in ("24 hours", "90 minutes", "30 minutes"):
        got = live.sliding_features(df, window, digits=False)
        plan = got._jdf.queryExecution().executedPlan().toString()
        above = plan[:plan.index("Exchange")]
        assert "Generate" in above and plan.count("Exchange hashpartitioning") == 2
        want = df.groupBy(F.window("ts", window, "30 minutes").alias("w"), "elder_id").agg(
            F.count(F.lit(1)).alias("n"), F.sum("duration_sec").alias("s"))
        assert (sorted((r[0], r[1], r[2], round(r[3], 6)) for r in got.select("elder_id", "window_start", "n_utterances", "total_duration").collect())
                == sorted((r[0], r[1], r[2], round(r[3], 6)) for r in want.select("elder_id", "w.start", "n", "s").collect()))


def test_a_person_is_trained_once_and_then_carries_the_baseline(spark, tmp_path):
    from helpers import day, feature_rows
    from driftwatch.plans import daily, steps
    from driftwatch.config import DEFAULTS as s

    path, folder = str(tmp_path / "f"), str(tmp_path / "s")
    feature_rows(spark, [{"social_turns": 20.0 + i * 5 % 7} for i in range(24)], "a").unionByName(
        feature_rows(spark, [None] * 16 + [{}] * 8, "b")).write.partitionBy("date").parquet(path)
    table = spark.read.parquet(path)
    steps.run_days(table, folder, [day(12), day(15), day(22), day(23)])
    trained = [spark.read.parquet(f"{folder}/trained/through={day(i)}").count() for i in (12, 15, 22, 23)]
    assert trained == [0, 1, 0, 0]
    state = {r["elder_id"]: r for r in steps.read_state(spark, f"{folder}/state", day(24)).collect()}
    assert len(state["a"]["history"]) == max(s.window, s.offline_days) and state["b"]["baseline"] is None
    want = daily.first_baselines(daily.labelled_days(table)).first()
    assert {c: state["a"]["baseline"][c] for c in steps.USED} == {c: want[c] for c in steps.USED}
