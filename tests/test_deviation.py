"""Deviations to the last bit: a value exactly at a limit must fall on the side on which the SQL puts it."""

import random
import statistics

import duckdb
from helpers import by_day, feature_rows

from driftwatch.config import FEATURES
from driftwatch.functions.text import deviation
from driftwatch.operators import scoring
from driftwatch.plans import daily
from driftwatch.sources import events

AT = FEATURES.index("social_turns")


def recurrence(xs):
    """Deviation as the SQL engine adds it up, row by row."""
    mean, squares = 0.0, 0.0
    for n, x in enumerate(xs, 1):
        new = mean + (x - mean) / n
        squares += (x - new) * (x - mean)
        mean = new
    return (squares / len(xs)) ** 0.5


def hours(n, seed):
    draw = random.Random(seed)
    return [float(draw.randint(1, 24)) for _ in range(n)]


def test_cold_start_has_the_bits_of_the_sql(spark):
    xs = hours(400, 1)
    days = feature_rows(spark, [{"social_turns": x} for x in xs])
    got = [r["z_social_turns"] for r in by_day(scoring.cold_start(days))]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INT, x DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(xs)))
    want = con.execute("SELECT CASE WHEN n >= 2 AND s >= 1e-9 THEN (x - m) / s ELSE 0 END FROM (SELECT i, x, count(x) OVER w AS n, avg(x) OVER w AS m, "
                       "stddev_pop(x) OVER w AS s FROM t WINDOW w AS (ORDER BY i ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)) ORDER BY i").fetchall()
    assert got == [r[0] for r in want]


def test_baselines_have_the_bits_of_the_recurrence(spark):
    for seed in range(4):
        xs = hours(14, seed)
        days = daily.labelled_days(feature_rows(spark, [{"social_turns": x} for x in xs]))
        base = daily.first_baselines(days).first()
        assert base["n_train_days"] == 14
        assert base["scaler_scale"][AT] == recurrence(xs)
        gaps = [(x - sum(xs[i:i + 7]) / 7) / recurrence(xs) for i, x in enumerate(xs[7:])]
        assert base["signed_std"][AT] == recurrence(gaps) and base["resid_std"][AT] == recurrence([abs(g) for g in gaps])


def test_deviation_is_the_population_deviation(spark):
    xs = hours(50, 9)
    df = spark.createDataFrame([(i, x, None if i % 3 else x) for i, x in enumerate(xs)], "i int, x double, y double")
    got = df.selectExpr(f"{deviation('x')} AS x", f"{deviation('y')} AS y", f"{deviation('CASE WHEN i < 0 THEN x END')} AS none").first()
    assert abs(got["x"] - statistics.pstdev(xs)) < 1e-12 and abs(got["y"] - statistics.pstdev(xs[::3])) < 1e-12
    assert got["none"] is None and df.filter("i = 0").selectExpr(f"{deviation('x')} AS x").first()[0] == 0.0


def test_training_windows_are_added_nearest_day_first(spark):
    told_apart = 0
    for seed in range(4):
        draw = random.Random(seed)
        xs = [draw.randint(1, 999) / 12.5 for _ in range(14)]
        base = daily.first_baselines(daily.labelled_days(feature_rows(spark, [{"social_turns": x} for x in xs]))).first()
        scale = recurrence(xs)
        gaps, forward = ([(x - plain(xs[i:i + 7][::step]) / 7) / scale for i, x in enumerate(xs[7:])] for step in (-1, 1))
        told_apart += plain(gaps) != plain(forward)
        assert base["n_train_days"] == 14 and base["scaler_scale"][AT] == scale
        assert base["signed_mean"][AT] == plain(gaps) / 7 and base["resid_mean"][AT] == plain(map(abs, gaps)) / 7
        assert base["signed_std"][AT] == recurrence(gaps)
    assert told_apart


def plain(xs):
    """Sum one by one (``sum`` of Python 3.12 and later compensates for rounding)."""
    out = 0.0
    for x in xs:
        out += x
    return out


def test_pitch_of_a_day_has_the_bits_of_the_recurrence(spark):
    draw = random.Random(3)
    pitch = {day: [120.0 + draw.randint(0, 99) for _ in range(3 + day % 5)] for day in range(200)}
    rows = [(day, i, x) for day, xs in pitch.items() for i, x in enumerate(xs)]
    utt = spark.createDataFrame(rows, "elder_id long, event_id long, pitch_mean double").coalesce(1).selectExpr(
        "*", "DATE'2024-01-01' AS date", "TIMESTAMP'2024-01-01 10:00:00' AS ts", "1D AS duration_sec", "'sad' AS emotion", "4D AS speech_rate")
    got = {r["elder_id"]: r["pitch_variability"] for r in events.daily_vectors(utt).collect()}
    assert got == {day: recurrence(xs) for day, xs in pitch.items()}
