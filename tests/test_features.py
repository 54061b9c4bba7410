"""Feature extraction from utterances, waveforms, motion and voice segments."""

import datetime as dt
import math

import pytest

from driftwatch.functions import scalars
from driftwatch.operators import acoustic, activity, dialogue, sleep, social
from pyspark.sql import functions as F

K = ["p"]


def test_stream_acoustics(spark):
    df = spark.createDataFrame(
        [("a", 3.0, "sad", 3.5, 190.0), ("a", 6.0, "happy", 4.5, 210.0), ("a", None, "fearful", None, None),
         ("b", 0.0, "sad", 4.0, 100.0)],
        "p string, duration_sec double, emotion string, speech_rate double, pitch_mean double")
    got = {r["p"]: r for r in acoustic.stream_features(df, K).collect()}
    a = got["a"]
    assert (a["sad_ratio"], a["avg_speed"], a["pitch_variability"]) == (0.3, 4.0, 8.2)
    assert (a["distress_events"], a["n_utterances"], a["total_duration"]) == (2.0, 3, 10.0)
    assert got["b"]["sad_ratio"] == 0.0 and got["b"]["pitch_variability"] == 25.0


def batch(spark, rows):
    return spark.createDataFrame(rows, "p string, duration_sec double, emotion string, emotion_probs map<string,double>, "
                                       "non_verbal string, speech_rate double, pitch_mean double")


def test_batch_acoustics(spark):
    u = batch(spark, [("a", 2.0, "sad", {"sad": 0.5}, "sigh", 9.0, 100.0), ("a", 2.0, "sad", None, "laugh", None, None),
                      ("b", 1.0, "sad", None, None, None, 100.0), ("b", 1.0, "happy", {"happy": 1.0}, None, 0.2, 500.0)])
    ev = spark.createDataFrame([("a",), ("c",)], "p string")
    got = {r["p"]: r for r in acoustic.batch_features(u, K, ev).collect()}
    assert (got["a"]["sad_ratio"], got["a"]["avg_speed"], got["a"]["pitch_variability"]) == (0.25, 8.0, 25.0)
    assert got["a"]["distress_events"] == 2.0
    # no probability mass: labels without probabilities count
    assert (got["b"]["sad_ratio"], got["b"]["avg_speed"], got["b"]["pitch_variability"]) == (0.5, 1.0, 150.0)
    # events only
    assert (got["c"]["sad_ratio"], got["c"]["avg_speed"], got["c"]["distress_events"]) == (0.05, 4.0, 1.0)


def reference_sleep(hr, m, bed):
    std = lambda x: math.sqrt(sum((v - sum(x) / len(x)) ** 2 for v in x) / len(x))
    size = [abs(v) for v in m]
    eff = 1 - sum(s > 1.5 * std(m) for s in size) / len(m)
    high = [s > sum(size) / len(size) + std(m) for s in size]
    sfi = sum(a != b for a, b in zip(high, high[1:])) / (bed / 60)
    rr = [60000 / h for h in hr]
    d = [(b - a) ** 2 for a, b in zip(rr, rr[1:])]
    deep = 0.30 if sum(size) / len(size) < std(m) and std(hr) < 5 else 0.20
    return [round(eff, 4), deep, round(max(1, min(15, sfi)), 2), round(max(10, min(100, math.sqrt(sum(d) / len(d)))), 1)]


@pytest.mark.parametrize("hr_step", [1, 9])
def test_sleep_from_waveform(spark, hr_step):
    hr = [60.0 + hr_step * ((i * 7) % 5) for i in range(60)]
    m = [((i * 37) % 23 - 11) / 3.0 * (4 if i % 9 == 0 else 0.2) for i in range(60)]
    nights = spark.createDataFrame([("a", hr, m, "23:15", "06:45")],
                                   "p string, heart_rate array<double>, movement array<double>, in_bed string, out_bed string")
    got = sleep.sleep_features(sleep.waveform_long(nights, K), nights, K).first()
    assert list(got)[1:] == reference_sleep(hr, m, 450)


def test_sleep_defaults(spark):
    nights = spark.createDataFrame([("a", "bad", "07:00"), ("b", "23:00", "23:00")], "p string, in_bed string, out_bed string")
    none = spark.createDataFrame([], "p string, seq int, heart_rate double, movement double")
    got = {r["p"]: list(r)[1:] for r in sleep.sleep_features(none, nights, K).collect()}
    assert got["a"] == [0.88, 0.28, 4.5, 48.0]
    assert got["b"][0] == 0.0  # no time in bed


def test_activity_precedence(spark):
    rep = spark.createDataFrame([("a", 36000.0)], "p string, activity_seconds double")
    pir = spark.createDataFrame([("a", 1.0), ("b", 3600.0), ("b", 3600.0)], "p string, duration_sec double")
    frames = spark.createDataFrame(
        [("c", f, j, 100.0 * f * (j + 1), 0.0, 0.0) for f in range(300) for j in range(2)] + [("d", 0, 0, 1.0, 1.0, 1.0)],
        "p string, frame int, joint int, x double, y double, z double")
    days = spark.createDataFrame([("e",), ("a",)], "p string")
    got = {r["p"]: r["daily_activity"] for r in activity.daily_activity(K, rep, pir, frames, days).collect()}
    assert got == {"a": 1000.0, "b": 200.0, "c": 897.0, "d": 3000.0, "e": 5000.0}


def test_room_entropy(spark):
    rooms = {"a": ["bed", "hall", "bed", "bed"], "b": ["bed"], "c": ["bed", "bed", "bed"]}
    df = spark.createDataFrame([(p, i, r) for p, rs in rooms.items() for i, r in enumerate(rs)], "p string, seq int, room string")
    got = {r["p"]: (r["moves"], r["space_entropy"]) for r in activity.room_entropy(df, K, ["seq"]).collect()}
    h = -(0.75 * math.log2(0.75) + 0.25 * math.log2(0.25)) * 1.5
    assert got == {"a": (2, round(h, 2)), "b": (0, 2.0), "c": (0, 0.1)}


def test_social_turns(spark):
    seg = spark.createDataFrame(
        [("a", 0, 10.0, 5.0), ("a", 1, 12.0, 5.0), ("a", 2, 15.5, 5.0), ("a", 3, None, 5.0), ("a", 4, 16.0, 5.0)],
        "p string, seq int, start_sec double, duration_sec double")
    log = spark.createDataFrame([("a", 4), ("a", None), ("b", 7), ("b", None)], "p string, utterances int")
    days = spark.createDataFrame([("c",)], "p string")
    got = {r["p"]: tuple(r)[1:] for r in social.social_features(K, seg, speaker_log=log, days=days).collect()}
    assert got["a"] == (8.0, round(25 / 57600, 4))  # one start, one gap, two unreadable pairs, four said
    assert got["b"] == (8.0, 0.12) and got["c"] == (25.0, 0.12)
    from_end = social.social_features(K, seg.filter("seq < 3"), gap_from="end").first()
    assert from_end["social_turns"] == 1.0


def test_recognizer_output(spark):
    df = spark.createDataFrame(
        [(1, "ignored", [(0, 2000, 5, "<|SAD|>你好"), (2000, 2050, 3, "<|HAPPY|><|SAD|>啊"), (2100, 2200, 9, "<|SAD|> "),
                         (3000, 4000, 5, "再见")]), (2, "<|SAD|> whole text ", None), (3, " <x> ", None)],
        "id int, text string, sentence_info array<struct<start:bigint,end:bigint,spk:int,sentence:string>>")
    got = dialogue.utterances_of(dialogue.segments_of(df, ["id"]), ["id"]).orderBy("id", "pos").collect()
    assert [(r["id"], r["speaker"], r["emotion"], r["text"], r["speech_rate"], r["duration_sec"]) for r in got] == [
        (1, "speaker_1", "sad", "你好", 1.0, 2.0), (1, "speaker_2", "happy", "啊", 10.0, 0.1),
        (1, "speaker_1", "neutral", "再见", 2.0, 1.0), (2, "speaker_1", "neutral", "whole text", 4.0, 0.0)]


def test_turn_merging(spark):
    rows = [("s1", "a"), ("s1", "b"), ("s2", "c"), ("s1", "d"), ("s1", "e"), ("s1", "f")]
    df = spark.createDataFrame([(1, i, r, t, i * 61000, i * 61000 + 500) for i, (r, t) in enumerate(rows)],
                               "id int, pos int, speaker string, text string, start_ms bigint, end_ms bigint")
    got = dialogue.turns(df, ["id"], ["pos"]).orderBy("first_pos").collect()
    assert [(r["speaker"], r["text"], r["start_time"], r["end_time"]) for r in got] == [
        ("s1", "ab", "00:00.000", "01:01.500"), ("s2", "c", "02:02.000", "02:02.500"), ("s1", "def", "03:03.000", "05:05.500")]


def test_clock_never_carries(spark):
    got = spark.range(1).select(scalars.clock(F.lit(59999)).alias("a"), scalars.clock(F.lit(61234)).alias("b")).first()
    assert tuple(got) == ("00:59.999", "01:01.234")


def test_event_time(spark):
    from driftwatch.streaming.live import with_event_time

    df = spark.createDataFrame([(dt.datetime(2026, 1, 1), 1.25), (dt.datetime(2026, 1, 1), None)],
                               "chunk_ts timestamp, start_sec double")
    got = [r["ts"] for r in with_event_time(df).collect()]
    assert (got[0] - got[1]).total_seconds() == 1.25
