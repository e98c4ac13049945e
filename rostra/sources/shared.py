"""Folders that the driver and all executors share, for tables that a query writes and reads again."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

_made: dict[str, SparkSession] = {}


def folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. A local session (tests) may do without one; a cluster may not."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    have = spark.sparkContext._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="rostra-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def fresh(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver ends."""
    path = f"{folder(spark)}/rostra-{label}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def _at(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def names(spark: SparkSession, path: str) -> list[str]:
    """The names of what lies in a folder."""
    files, at = _at(spark, path)
    return [f.getPath().getName() for f in files.listStatus(at)]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder with all that it holds; nothing if there is none."""
    files, at = _at(spark, path)
    files.delete(at, True)


@atexit.register
def _remove_all() -> None:
    for path, spark in _made.items():
        if spark.sparkContext._jvm is not None and spark.sparkContext._jsc is not None:
            remove(spark, path)
