"""Sensors as a Spark data source: one plug-in class serves batch reads, streams and replays.

A plug-in is a ``Sensor``: it lists its people and gives the readings of one person and day. Spark does the rest::

    spark.dataSource.register(sensors.source("bed_mat", BedMat))
    spark.read.format("bed_mat").option("first", "2026-07-01").option("last", "2026-07-31").load("mqtt://ward-3")
    spark.readStream.format("bed_mat").option("first", "2026-07-01").load("mqtt://ward-3")

Work is cut into slices of people and days, which executors read side by side. Conditions on the day or the person are
taken over by the source, so a day's job asks the device for that day only. A stream's offset is a day: every batch has the
days from the last offset on, up to what the sensor says is complete; a batch that is run again asks for the same days.
"""

from __future__ import annotations

import datetime as dt
from abc import ABC, abstractmethod
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual,
                                    In, InputPartition, LessThan, LessThanOrEqual)
from pyspark.sql import types as T

from driftwatch.config import DAY, FEATURES, KEY, MODALITIES

ONE_DAY = dt.timedelta(days=1)


class Sensor(ABC):
    """What a device or service must give. One object is made per read on the driver, and one per slice on an executor."""

    modality: str | None = None   # its features are the columns; None: all ten

    def __init__(self, address: str, options: Mapping[str, str]) -> None:
        self.address, self.options = address, options

    @abstractmethod
    def people(self) -> list[str]:
        """Everyone who has this sensor; their number sets the number of slices."""

    @abstractmethod
    def readings(self, person: str, day: dt.date) -> Mapping[str, object] | None:
        """Values by feature of a person's day; None where there is no record. Other names are left out."""

    @abstractmethod
    def complete_until(self) -> dt.date:
        """The last day whose readings no longer change."""


def value(x: object) -> float | None:
    """A reading as a number; text that is none, NaN and truth values are missing."""
    if x is None or isinstance(x, bool):
        return None
    try:
        number = float(x)
    except (TypeError, ValueError):
        return None
    return number if abs(number) < float("inf") else None


@dataclass
class Slice(InputPartition):
    people: list[str]
    first: dt.date
    last: dt.date

    def __post_init__(self) -> None:
        super().__init__(None)


class _Reading:
    """What batch and stream readers share."""

    def __init__(self, sensor: type[Sensor], path: str, options: Mapping[str, str]) -> None:
        self.sensor, self.path, self.options = sensor, path, dict(options)
        self.size = int(options.get("people_per_slice", "1000"))
        self.days = int(options.get("days_per_slice", "7"))

    def make(self) -> Sensor:
        return self.sensor(self.path, self.options)

    def day(self, option: str) -> dt.date | None:
        text = self.options.get(option)
        return dt.date.fromisoformat(text) if text else None

    def slices(self, people: list[str], first: dt.date, last: dt.date) -> list[Slice]:
        out = []
        for start in range(0, len(people), self.size):
            day = first
            while day <= last:
                end = min(day + (self.days - 1) * ONE_DAY, last)
                out.append(Slice(people[start:start + self.size], day, end))
                day = end + ONE_DAY
        return out

    def read(self, part: Slice) -> Iterator[tuple]:
        sensor, names = self.make(), columns(self.sensor)
        for person in part.people:
            day = part.first
            while day <= part.last:
                found = sensor.readings(person, day)
                if found is not None:
                    yield (person, day, *(value(found.get(f)) for f in names))
                day += ONE_DAY


class SensorReader(_Reading, DataSourceReader):
    """All days from ``first`` to ``last`` (default: as far as they are complete) that the conditions leave."""

    def __init__(self, sensor: type[Sensor], path: str, options: Mapping[str, str]) -> None:
        super().__init__(sensor, path, options)
        self.low, self.high, self.who = self.day("first"), self.day("last"), None

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) else None
            if name == DAY and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                low = f.value + ONE_DAY if isinstance(f, GreaterThan) else f.value
                high = f.value - ONE_DAY if isinstance(f, LessThan) else f.value
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(x for x in (self.low, low) if x is not None)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = min(x for x in (self.high, high) if x is not None)
            elif name == KEY and isinstance(f, (EqualTo, In)):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.who = asked if self.who is None else self.who & asked
            else:
                yield f

    def partitions(self) -> list[Slice]:
        sensor = self.make()
        people = [p for p in sensor.people() if self.who is None or p in self.who]
        last = sensor.complete_until() if self.high is None else self.high
        if self.low is None:
            raise ValueError("a batch read needs a first day: option 'first' or a condition on the day")
        return self.slices(people, self.low, last)


class SensorStreamReader(_Reading, DataSourceStreamReader):
    """Days as they become complete, from ``first`` on (to ``last``, if given)."""

    def initialOffset(self) -> dict:
        first = self.day("first")
        if first is None:
            raise ValueError("a stream needs its first day: option 'first'")
        return {"next": first.isoformat()}

    def latestOffset(self) -> dict:
        end = self.make().complete_until()
        if self.day("last") is not None:
            end = min(end, self.day("last"))
        return {"next": (end + ONE_DAY).isoformat()}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        low, high = (dt.date.fromisoformat(x["next"]) for x in (start, end))
        return self.slices(self.make().people(), low, high - ONE_DAY)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


def columns(sensor: type[Sensor]) -> list[str]:
    return MODALITIES[sensor.modality] if sensor.modality else list(FEATURES)


def schema(sensor: type[Sensor]) -> T.StructType:
    return T.StructType([T.StructField(KEY, T.StringType()), T.StructField(DAY, T.DateType())]
                        + [T.StructField(f, T.DoubleType()) for f in columns(sensor)])


def source(name: str, sensor: type[Sensor]) -> type[DataSource]:
    """A data source to register under ``name``. Conditions are handed to it if
    ``spark.sql.python.filterPushdown.enabled`` is true; otherwise Spark applies them behind it."""

    class SensorSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> T.StructType:
            return schema(sensor)

        def reader(self, schema: T.StructType) -> SensorReader:
            return SensorReader(sensor, self.options.get("path", ""), self.options)

        def streamReader(self, schema: T.StructType) -> SensorStreamReader:
            return SensorStreamReader(sensor, self.options.get("path", ""), self.options)

    return SensorSource
