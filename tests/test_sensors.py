"""One sensor plug-in read as a table, as a stream, and again from an offset."""

import datetime as dt
import math

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from driftwatch.config import DAY, KEY, MODALITIES
from driftwatch.operators.assemble import assemble
from driftwatch.session import work_folder
from driftwatch.sources import sensors

import sys

cloudpickle.register_pickle_by_value(sys.modules[__name__])
FIRST = dt.date(2026, 7, 1)
SLEEP = MODALITIES["sleep"]


class BedMat(sensors.Sensor):
    """Seven people; readings follow from person and day, some are missing or no numbers."""

    modality = "sleep"

    def people(self):
        return [f"E{i}" for i in range(7)]

    def readings(self, person, day):
        if "only" in self.options and day.isoformat() not in self.options["only"].split(","):
            raise AssertionError(f"{day} was not asked for")
        n = (day - FIRST).days * 10 + int(person[1:])
        if n % 6 == 5:
            return None
        return {SLEEP[0]: n / 7, SLEEP[1]: str(n) if n % 4 else "off", SLEEP[2]: math.nan if n % 3 == 0 else n, "other": 1}

    def complete_until(self):
        return FIRST + dt.timedelta(days=int(self.options.get("complete", "9")))


def expected(days):
    mat, out = BedMat("x", {}), []
    for p in mat.people():
        for d in days:
            found = mat.readings(p, FIRST + dt.timedelta(days=d))
            if found is not None:
                out.append((p, FIRST + dt.timedelta(days=d), *(sensors.value(found.get(f)) for f in SLEEP)))
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def reader(spark):
    spark.dataSource.register(sensors.source("bed_mat", BedMat))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield lambda **o: spark.read.format("bed_mat").options(first=FIRST.isoformat(), people_per_slice="3", days_per_slice="4", **o).load("mat://1")
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_values():
    assert [sensors.value(x) for x in (1, "2.5", None, "off", math.nan, math.inf, True, [])] == [1.0, 2.5] + [None] * 6


def test_batch_reads_all_days_in_slices(reader):
    df = reader()
    assert rows(df) == expected(range(10)) and df.rdd.getNumPartitions() == 3 * 3
    assert rows(reader(last="2026-07-03")) == expected(range(3))


def test_a_condition_on_the_day_reaches_the_device(reader):
    day = FIRST + dt.timedelta(days=4)
    one = reader(only=day.isoformat())
    assert rows(one.filter(F.col(DAY) == F.lit(day))) == expected([4])
    two = reader(only="2026-07-03,2026-07-04")
    assert rows(two.filter("date > '2026-07-02' AND date < '2026-07-05'")) == expected([2, 3])
    some = reader().filter((F.col(KEY).isin("E1", "E5")) & (F.col(DAY) <= "2026-07-02") & (F.col(SLEEP[0]) > 0.5))
    assert rows(some) == [r for r in expected(range(2)) if r[0] in ("E1", "E5") and r[2] > 0.5]


def test_the_first_day_must_be_known(spark, reader):
    with pytest.raises(Exception, match="first day"):
        spark.read.format("bed_mat").load("mat://1").count()
    assert rows(spark.read.format("bed_mat").load("mat://1").filter("date >= '2026-07-09'")) == expected([8, 9])


def run(stream, out, checkpoint):
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def test_a_stream_takes_up_where_it_stopped(spark, reader):
    folder = work_folder(spark, "mat")
    stream = lambda complete: spark.readStream.format("bed_mat").options(first=FIRST.isoformat(), complete=complete).load("mat://1")
    run(stream("3"), f"{folder}/out", f"{folder}/c")
    assert rows(spark.read.parquet(f"{folder}/out")) == expected(range(4))
    run(stream("3"), f"{folder}/out", f"{folder}/c")         # nothing new
    run(stream("9"), f"{folder}/out", f"{folder}/c")
    assert rows(spark.read.parquet(f"{folder}/out")) == expected(range(10)) == rows(reader())


def test_a_replay_gives_the_same_rows(spark, reader):
    """The same offsets again, as after a lost driver: equal rows; and from a later first day the rest."""
    mat = sensors.SensorStreamReader(BedMat, "mat://1", {"first": "2026-07-03"})
    start, end = mat.initialOffset(), mat.latestOffset()
    once, again = ([r for s in mat.partitions(start, end) for r in mat.read(s)] for _ in range(2))
    assert sorted(once, key=str) == sorted(again, key=str) == expected(range(2, 10))
    assert mat.partitions(end, end) == []


def test_a_sensor_feeds_the_daily_rows(reader, spark):
    days = assemble({"sleep": reader()})
    assert days.count() == len(expected(range(10))) and set(SLEEP) <= set(days.columns)
