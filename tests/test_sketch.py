"""Percentile sketches: merged equals one pass within the bound, exact for few values."""

import random


from driftwatch.operators import sketch


def test_merged_days_keep_the_bound(spark):
    rnd = random.Random(2)
    rows = [("a", i % 40, rnd.expovariate(1.0)) for i in range(20_000)] + [("b", i, float(i)) for i in range(9)] + [("c", 0, None)]
    df = spark.createDataFrame(rows, "elder_id string, day int, anomaly_score double").repartition(7)
    merged = sketch.merged_sketches(sketch.score_sketches(df, ["elder_id", "day"]), ["elder_id"])
    once = sketch.score_sketches(df, ["elder_id"])
    xs = sorted(r[2] for r in rows if r[0] == "a")
    for percent in (1, 25, 50, 90, 99):
        for sketches in (merged, once):
            got = {r["elder_id"]: r["score_percentile"] for r in sketch.sketch_percentile(sketches, percent).collect()}
            rank = sum(x <= got["a"] for x in xs) / len(xs)
            assert abs(rank - percent / 100) <= sketch.rank_error() and got["c"] is None
            assert got["b"] == next(float(i) for i in range(9) if (i + 1) / 9 >= percent / 100 - 1e-12)
    assert {r["elder_id"]: r["n_scores"] for r in merged.drop("sketch").collect()} == {"a": 20_000, "b": 9, "c": 0}


def test_sketches_are_combined_before_the_shuffle(spark):
    df = spark.createDataFrame([("a", 1.0)], "elder_id string, anomaly_score double")
    plan = sketch.score_sketches(df, ["elder_id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_kll") > plan.index("Exchange hashpartitioning")
