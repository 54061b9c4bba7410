"""Tables that several jobs may write at once: every write is added, none is overwritten, the last one wins.

A table is a folder:

    w=<version>/<part>=<value>/...   the rows of one write, with ``_version`` and ``_gone``
    _log/<version>.json              the write's commit: its folder, and what it makes void

A write counts from the moment its log entry is there, whole or not at all. Each writer has a folder of its own, so two
writers of one day disturb each other neither while they write nor when they commit, and rows of both stay; only where both
have a row of the same person and part, the later version is the one that is read. Nothing that is stored is read on
writing. ``compact`` puts the rows in force into one write that voids those it was made from; a write that it did not see
stays in force beside it, since rows keep their versions. ``vacuum`` deletes what has been void long enough for
readers to be done.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwatch.config import DAY, KEY

VERSION, GONE = "_version", "_gone"
_HIDDEN = (VERSION, GONE, "w")


def _path(spark: SparkSession, name: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(name)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _commit(spark: SparkSession, path: str, version: str, **entry) -> None:
    """Create the log entry under another name and move it into place, which is one step."""
    aside, fs = _path(spark, f"{path}/_log/.{version}.tmp")
    out = fs.create(aside, True)
    out.write(bytearray(json.dumps({"version": version, **entry}).encode()))
    out.close()
    if not fs.rename(aside, _path(spark, f"{path}/_log/{version}.json")[0]):
        raise RuntimeError(f"version {version} of {path} is there already")


def log(spark: SparkSession, path: str) -> list[dict]:
    """Commits in force, oldest first; their number is bounded by how often the table is compacted."""
    place, fs = _path(spark, f"{path}/_log")
    names = [x.getPath().toString() for x in fs.listStatus(place)] if fs.exists(place) else []
    names = [n for n in names if n.endswith(".json")]
    entries = [json.loads(r[0]) for r in spark.read.text(names, wholetext=True).collect()] if names else []
    void = {v for e in entries for v in e.get("voids", ())}
    return sorted((e for e in entries if e["version"] not in void), key=lambda e: e["version"])


def new_version() -> str:
    return f"{time.time_ns() // 1000:020d}-{uuid.uuid4().hex[:8]}"


def upsert(df: DataFrame, path: str, part: str = DAY, whole: Sequence | None = None, keys: Sequence[str] = (KEY,),
           version: str | None = None) -> str:
    """Add the rows of ``df`` as a new version of their keys and parts; returns the version.

    ``whole``: parts that this write states completely. Rows of earlier versions there are no longer in force, also
    where this write has none for them. Without ``version`` it is the time at which the write began. ``df`` has one
    row per key and part.
    """
    version = version or new_version()
    rows = df.withColumns({VERSION: F.lit(version), GONE: F.lit(False)})
    rows.hint("rebalance", part).write.partitionBy(part).parquet(f"{path}/w={version}")
    _commit(df.sparkSession, path, version, part=part, keys=list(keys), whole=[str(x) for x in whole or ()], rows=True)
    return version


def withdraw(keys: DataFrame, path: str, part: str = DAY, key_columns: Sequence[str] = (KEY,), version: str | None = None) -> str:
    """Take the rows of the given keys and parts out of force."""
    version = version or new_version()
    rows = keys.select(*key_columns, part).distinct().withColumns({VERSION: F.lit(version), GONE: F.lit(True)})
    rows.write.partitionBy(part).parquet(f"{path}/w={version}")
    _commit(keys.sparkSession, path, version, part=part, keys=list(key_columns), whole=[], rows=True)
    return version


def _stated(entries: list[dict]) -> dict[str, str]:
    """Parts that were stated completely, and the last version that did so."""
    since: dict[str, str] = {}
    for e in entries:
        for p, version in {**e.get("kept", {}), **dict.fromkeys(e["whole"], e["version"])}.items():
            since[p] = max(since.get(p, ""), version)
    return since


def _raw(spark: SparkSession, path: str, entries: list[dict], where: Column | str | None) -> DataFrame | None:
    """Rows of the given commits whose part has not been stated completely by a later one; parts are pruned first."""
    if not entries:
        return None
    frames = spark.read.option("basePath", path).option("mergeSchema", True).parquet(*[f"{path}/w={e['version']}" for e in entries])
    if where is not None:
        frames = frames.filter(where)
    part = entries[-1]["part"]
    for p, version in _stated(entries).items():
        frames = frames.filter((F.col(part).cast("string") != p) | (F.col(VERSION) >= version))
    return frames


def _latest(rows: DataFrame, entries: list[dict]) -> DataFrame:
    keys = [*entries[-1]["keys"], entries[-1]["part"]]
    values = [c for c in rows.columns if c not in (*keys, "w")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), VERSION).alias("_r")).select(*keys, "_r.*")


def current(spark: SparkSession, path: str, where: Column | str | None = None) -> DataFrame:
    """The rows in force. ``where`` is a condition on the part column; only those partitions are read.

    One version per key and part is chosen by a combined aggregate. A table with one write needs none.
    """
    entries = log(spark, path)
    rows = _raw(spark, path, entries, where)
    if rows is None:
        raise ValueError(f"nothing has been written to {path}")
    rows = _latest(rows, entries) if len(entries) > 1 else rows
    return rows.filter(~F.col(GONE)).drop(*_HIDDEN)


def compact(spark: SparkSession, path: str) -> str | None:
    """One write in place of all that are in force now; None if there is no more than one."""
    entries = log(spark, path)
    if len(entries) < 2:
        return None
    version, part = new_version(), entries[-1]["part"]
    rows = _latest(_raw(spark, path, entries, None), entries)
    rows.hint("rebalance", part).write.partitionBy(part).parquet(f"{path}/w={version}")
    # What was stated completely must still hold against writes that began earlier and commit later; so do the
    # marks of rows that are gone.
    whole = _stated(entries)
    _commit(spark, path, version, part=part, keys=entries[-1]["keys"], whole=[], rows=True, kept=whole,
            voids=[v for e in entries for v in (e["version"], *e.get("voids", ()))])
    return version


def vacuum(spark: SparkSession, path: str, older_than_seconds: float = 7 * 86400) -> int:
    """Delete folders of writes that are void, or were never committed, and are as old as that; returns how many."""
    keep, gone = {e["version"] for e in log(spark, path)}, 0
    place, fs = _path(spark, path)
    limit = time.time() - older_than_seconds
    for status in fs.listStatus(place):
        name = status.getPath().getName()
        version = name.removeprefix("w=")
        if name.startswith("w=") and version not in keep and status.getModificationTime() / 1000 <= limit:
            fs.delete(status.getPath(), True)
            fs.delete(_path(spark, f"{path}/_log/{version}.json")[0], False)
            gone += 1
    return gone
