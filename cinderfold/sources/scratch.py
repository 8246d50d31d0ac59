"""A folder for files that a plan writes and reads again."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import SparkSession

_LEFT: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Only where that is unset and all runs on one machine, as in tests, a folder of our own is set.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir: name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("/tmp/cinderfold-checkpoints")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. What is there goes when the driver's process ends in good order."""
    path = f"{shared_dir(spark)}/cinderfold-{name}-{uuid.uuid4().hex}"
    if not _LEFT:
        atexit.register(_remove)
    _LEFT[path] = spark
    return path


def _remove() -> None:
    for path, spark in _LEFT.items():
        if spark.sparkContext._jsc is not None:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete what is at a path through the file system that Spark uses."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def drop(spark: SparkSession, path: str) -> None:
    """Free a path of scratch() that nothing reads any more."""
    remove(spark, path)
    _LEFT.pop(path, None)


def left() -> set[str]:
    """The paths of scratch() that are still there."""
    return set(_LEFT)
