"""Literal-row helpers shared by the tests."""

import datetime as dt

from driftwatch.config import FEATURES

SF = "/root/testdata/sf0.001"
NORMAL = dict(zip(FEATURES, [0.05, 4.5, 32.0, 0.1, 0.87, 0.3, 4.5, 48.0, 5000.0, 30.0]))
DAY0 = dt.date(2026, 7, 1)
SCHEMA = "elder_id string, date date, " + ", ".join(f"{f} double" for f in FEATURES)


def day(i):
    return DAY0 + dt.timedelta(days=i)


def feature_rows(spark, rows, person="E001"):
    """Rows are dicts of feature overrides (None for a missing value), one per day; None skips the day."""
    data = [(person, day(i), *[{**NORMAL, **r}[f] for f in FEATURES]) for i, r in enumerate(rows) if r is not None]
    return spark.createDataFrame(data, SCHEMA)


def by_day(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: r["date"])
