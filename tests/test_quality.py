"""Assembly, imputation and quality labels."""

import pytest
from helpers import NORMAL, by_day, day, feature_rows

from driftwatch.config import FEATURES
from driftwatch.operators import assemble, quality


def raw(spark, **cols):
    names = list(cols)
    return spark.createDataFrame([("E001", day(0), *cols.values())],
                                 "elder_id string, date date, " + ", ".join(f"{n} string" for n in names))


def test_assembly_in_feature_order(spark):
    got = assemble.assemble({
        "sleep": raw(spark, sleep_efficiency="0.85", deep_sleep_ratio="0.3", sfi="5.2", hrv_rmssd="45"),
        "activity": raw(spark, daily_activity="5000", timestamp="x"), "social": raw(spark, social_turns="30"),
        "acoustic": raw(spark, sad_ratio="0.05", avg_speed="4.2", pitch_variability="30", distress_events="0")}).first()
    assert [got[f] for f in FEATURES] == [0.05, 4.2, 30, 0, 0.85, 0.3, 5.2, 45, 5000, 30]
    assert got["missing_raw"] == 0 and got["missing_names"] == []


def test_missing_modalities_and_bad_text(spark):
    got = assemble.assemble({
        "sleep": raw(spark, sleep_efficiency="0.85", deep_sleep_ratio="oops", sfi="NaN", hrv_rmssd="45"),
        "acoustic": raw(spark, sad_ratio="0.05", avg_speed="4.2", pitch_variability="30")}).first()
    assert got["missing_names"] == ["distress_events", "deep_sleep_ratio", "sfi", "daily_activity", "social_turns"]
    assert got["missing_raw"] == 5


def test_width_is_checked(spark):
    with pytest.raises(ValueError):
        assemble.check_features(raw(spark, sad_ratio="1"))
    with pytest.raises(ValueError):
        assemble.feature_value(feature_rows(spark, [{}]), "nope")


def labels(spark, rows):
    return by_day(quality.label_quality(quality.calendar_spine(feature_rows(spark, rows))))


def test_forward_fill_takes_observed_donor(spark):
    rows = labels(spark, [{"sad_ratio": 0.2, "sfi": None}, {"sad_ratio": None, "sfi": None}])
    assert rows[1]["sad_ratio"] == 0.2 and rows[1]["sfi"] == 0.0
    # the zero of the day before is no donor: the feature stays counted
    assert [r["missing_count"] for r in rows] == [1, 1]
    assert [r["data_quality"] for r in rows] == ["valid", "valid"]


def test_three_missing_is_insufficient_and_two_is_not(spark):
    three = {f: None for f in FEATURES[:3]}
    two = {f: None for f in FEATURES[:2]}
    assert [r["data_quality"] for r in labels(spark, [{}, three, two])] == ["valid", "insufficient", "valid"]


def test_implausible_value(spark):
    rows = labels(spark, [{}, {"sfi": -999.0}, {"sfi": None}, {"sfi": -100.0}])
    assert [r["data_quality"] for r in rows] == ["valid", "insufficient", "valid", "valid"]
    assert rows[2]["sfi"] == NORMAL["sfi"]  # the broken day gave nothing


def test_offline_after_three_bad_days_and_recovery(spark):
    rows = labels(spark, [{}, None, None, None, None, {}, None, {}])
    assert [r["data_quality"] for r in rows] == [
        "valid", "insufficient", "insufficient", "insufficient", "offline", "valid", "insufficient", "valid"]
    assert [r["offline_alarm"] for r in rows] == [False, False, False, True, True, False, False, False]
    assert [r["stored"] for r in rows] == [True, False, False, False, False, True, False, True]


def test_offline_alarm_window(spark):
    df = spark.createDataFrame([("a", day(i), q) for i, q in enumerate(["valid", "insufficient", "offline", "offline"])],
                               "elder_id string, date date, data_quality string")
    assert [r["offline_alarm"] for r in by_day(quality.offline_alarm(df))] == [False, False, False, True]
    assert [r["offline_alarm"] for r in by_day(quality.offline_alarm(df, k=2))] == [False, False, True, True]
    assert not any(r["offline_alarm"] for r in by_day(quality.offline_alarm(df, k=5)))


def test_sequence_gaps(spark):
    v = [None, 1.0, None, None, None, 5.0, None, None, None, None, 10.0, None, None, None, None]
    got = by_day(quality.impute_sequence(quality.calendar_spine(feature_rows(spark, [{"sfi": x} for x in v]))))
    assert [r["sfi"] for r in got] == [0, 1, 1, 1, 1, 5, 6, 7, 8, 9, 10, 10, 10, 10, 10]
    assert [r["degraded_sfi"] for r in got] == [1, 0, 0, 0, 0, 0, 1, 1, 1, 1, 0, 1, 1, 1, 1]
    total = quality.degraded_days(quality.impute_sequence(feature_rows(spark, [{"sfi": x} for x in v]))).first()
    assert total["degraded_sfi"] == 9 and total["degraded_sad_ratio"] == 0


def test_summary(spark):
    df = quality.label_quality(quality.calendar_spine(feature_rows(spark, [{}, None, {}, None, {}])))
    got = quality.quality_summary(df).first()
    assert (got["valid_days"], got["insufficient_days"], got["offline_days"], got["total_days"]) == (3, 2, 0, 5)
    assert got["valid_ratio"] == 0.6
    empty = quality.quality_summary(df.filter("false"), keys=()).first()
    assert empty["total_days"] == 0 and empty["valid_ratio"] == 0.0
