"""What the operators of this subpackage share: the shared folder, written tables, row keys."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable, Iterator
from functools import partial
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cinderfold.sources.scratch import drop, left, scratch

#: A batch that goes to a Python worker has at most so many bytes, or one row.
BATCH_BYTES = "4m"
#: Rows of a few numbers that may be sent to every task: some 10 MB.
BROADCAST_ROWS = 1 << 17
_BATCH_SETTING, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def in_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str, keeps: Hashable = None) -> DataFrame:
    """df.mapInArrow(run, schema) with bounded memory: batches of BATCH_BYTES unless the session names another size, and
    workers that keep nothing from task to task but what `held` under the name `keeps`."""
    spark = df.sparkSession
    if spark.conf.get(_BATCH_SETTING) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_SETTING, BATCH_BYTES)
    return df.mapInArrow(partial(_task, run, keeps), schema)


def _task(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: Hashable, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for other in [k for k in _HELD if k != keeps]:
        del _HELD[other]
    try:
        yield from run(batches)
    finally:
        _give_back()


_HELD: dict[Hashable, Any] = {}


def held(name: Hashable, make: Callable[[], Any]) -> Any:
    """What a worker process makes once and keeps for the tasks of one operator; tasks of any other drop it."""
    if name not in _HELD:
        _HELD[name] = make()
    return _HELD[name]


def _give_back() -> None:
    """Return freed memory to the system, so that an idle worker is small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only glibc has it
        pass


def written(df: DataFrame, name: str, compression: str = "zstd", narrow: bool = False) -> DataFrame:
    """Cut lineage: write to the shared folder, read back. Survives the loss of any executor.

    narrow: for tables of a few numbers or words a row, which two files a core (or, where few cores have joined yet, an
    eighth of the shuffle's partitions) hold with ease: partitions follow one another in a task, and many small files help
    nobody.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    if narrow:
        df = df.coalesce(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    df.write.option("compression", compression).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.scratch = path
    return back


def written_alone(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """written() of what make() returns; the tables that it wrote on its way are freed."""
    before = left()
    out = written(make(), name)
    for path in left() - before - {out.scratch}:
        drop(out.sparkSession, path)
    return out


def drop_written(df: DataFrame) -> None:
    """Free the disk of a table from written() that no later step reads."""
    drop(df.sparkSession, df.scratch)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, marked for broadcast if its number of rows, which the caller has counted, is at most BROADCAST_ROWS."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Two longs that rows share only if doc_id and text are equal (null: as -1 and the empty text)."""
    return [F.coalesce(F.col(doc_id), F.lit(-1)).cast("long").alias("k1"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("k2")]
