"""Enrolment set, outlier days by median absolute deviation, and the training gate.

Every step adds columns to a person's own days. Medians and counts are whole-partition
windows over the ``enrol`` rows only, so the steps follow each other without a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.config import DAY, DEFAULTS, FEATURES, KEY, Settings
from driftwatch.functions.text import BY_DAY, BY_PERSON, UPTO, add, each, names_where, num, plus

# Fixed values of the modified z-score.
MAD_SCALE, MEAN_DEV_SCALE, FLAT = 0.6745, 0.7979, 1e-9


def mark_enrolment(days: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """``enrol`` marks the first ``enrol_days`` valid days of each person, ``enrol_no`` counts them."""
    df = add(days, f"sum(int(valid)) OVER ({BY_DAY} {UPTO}) AS enrol_no")
    return add(df, f"valid AND enrol_no <= {s.enrol_days} AS enrol")


def flag_outliers(marked: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Outlier cells (``bad_<feature>``) and days among the ``enrol`` rows of each person.

    Cells without value are never outliers; a feature with fewer than 3 values is skipped.
    """
    own = f" OVER ({BY_PERSON})"
    df = add(marked, each("median(CASE WHEN enrol THEN {f} END)" + own + " AS _med_{f}"))
    df = add(df, each("CASE WHEN enrol THEN abs({f} - _med_{f}) END AS _dev_{f}"))
    df = add(df, each("median(_dev_{f})" + own + " AS _mad_{f}"), each("avg(_dev_{f})" + own + " AS _mean_{f}"),
             each("count(_dev_{f})" + own + " AS _cnt_{f}"))
    flat, limit = num(FLAT), num(s.z_threshold)
    df = add(df, each(
        "coalesce(_cnt_{f} >= 3 AND CASE WHEN _mad_{f} >= " + flat + f" THEN {num(MAD_SCALE)}" + " * _dev_{f} / _mad_{f} "
        "WHEN _mean_{f} >= " + flat + f" THEN {num(MEAN_DEV_SCALE)}" + " * _dev_{f} / _mean_{f} END > " + limit
        + ", false) AS bad_{f}"))
    df = add(df, plus(each("int(bad_{f})")) + " AS bad_count")
    df = add(df, f"bad_count >= {s.min_bad_features} AS outlier_day")
    df = add(df, "sum(int(enrol))" + own + " AS n_enrol", "sum(int(outlier_day))" + own + " AS n_outliers",
             f"max(CASE WHEN enrol THEN {DAY} END)" + own + " AS train_date")
    gate = (f"CASE WHEN n_enrol < {s.enrol_days} THEN 'too_few_valid_days' "
            f"WHEN n_outliers / n_enrol > {num(s.max_outlier_ratio)} THEN 'too_many_outliers' "
            f"WHEN n_enrol - n_outliers < {s.window + 1} THEN 'too_few_after_removal' ELSE 'ok' END AS gate")
    return df.selectExpr(*marked.columns, *each("bad_{f}"), "bad_count", "outlier_day", "n_enrol", "n_outliers",
                         "train_date", gate)


def outlier_days(flagged: DataFrame) -> DataFrame:
    """The enrolment rows with their flags, ratio and names of outlying features."""
    return flagged.filter("enrol").selectExpr(
        KEY, DAY, "enrol_no", "bad_count", "outlier_day", "n_outliers / n_enrol AS outlier_ratio",
        names_where("bad_{f}") + " AS bad_features", *each("bad_{f}"))


def describe_outliers(flagged: DataFrame) -> DataFrame:
    """One line of text per outlier day, with features in their fixed order."""
    return outlier_days(flagged).filter("outlier_day").select(
        KEY, DAY, F.format_string("Day#%d: 离群特征=[%s]", F.col("enrol_no") - 1,
                                  F.array_join("bad_features", ", ")).alias("description"))


def training_gate(flagged: DataFrame) -> DataFrame:
    """Why each person may or may not be trained; a row per person, never an exception."""
    return flagged.groupBy(KEY).agg(F.max("n_enrol").alias("n_enrol"), F.max("n_outliers").alias("n_outliers"),
                                    F.max("gate").alias("gate"))


def training_days(flagged: DataFrame) -> DataFrame:
    """Clean enrolment days of the people who pass the gate."""
    return flagged.filter("enrol AND NOT outlier_day AND gate = 'ok'").select(KEY, DAY, *FEATURES, "train_date")
