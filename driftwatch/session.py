"""Session settings that every job of this package expects."""

from __future__ import annotations

import functools
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

# Semantics, not tuning: results are compared in UTC, and partitions written
# twice replace themselves instead of piling up.
_REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "driftwatch", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the package defaults; ``conf`` wins (dots as ``__``)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    merged = {**_DEFAULTS, **_REQUIRED, **{k.replace("__", "."): v for k, v in conf.items()}}
    for key, value in merged.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


def ensure_session(spark: SparkSession) -> SparkSession:
    """Apply the settings results depend on to a session made elsewhere."""
    for key, value in _REQUIRED.items():
        spark.conf.set(key, value)
    return ship_package(spark)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers, once per application.

    Only grouped training and keyed state run Python on executors. A package that is
    imported from an archive (``--py-files``) is there already.
    """
    app, package = spark.sparkContext.applicationId, Path(__file__).resolve().parent
    if app not in _shipped and package.is_dir():
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-')}/{package.name}", "zip",
                                      package.parent, package.name)
        spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
    return spark


def shuffle_width(spark: SparkSession) -> int:
    """How many partitions an explicit range shuffle should use."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's shared checkpoint folder.

    Where none is set (tests on one machine) a temporary one is made; on a cluster that is an
    error, because executors could not see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = _one_machine_root()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@functools.cache
def _one_machine_root() -> str:
    return tempfile.mkdtemp(prefix="spark-")
