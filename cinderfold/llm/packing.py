"""Sum-of-squares packing of documents into training sequences.

An item goes where the sum, over all gaps, of the squared number of open sequences with that gap becomes least; a new
sequence is opened if no open one holds the item. Shards of bounded size are packed side by side, each from its longest
item to its shortest, ties in random order. A sequence is closed when it is full. Items of sequences left open are packed
anew by the same rule with those of 64 shards at a time, until one shard is left, so that what shards leave open doesn't
grow with their number.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderfold.llm.common import in_batches, load, written
from cinderfold.llm.encoding import encoder

CAPACITY = 2048
SHARD_ITEMS = 1 << 16
FAN_IN = 64


def sum_of_squares(sizes: list[int], capacity: int) -> tuple[list[list[int]], list[list[int]]]:
    """Indices of sizes by sequence, in order of placement: exactly full ones, then open ones. Ties: least gap."""
    n = np.zeros(capacity + 1, np.int64)  # open sequences by gap; those of gap 0 are closed, so n[0] stays 0
    held: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
    full: list[list[int]] = []
    for item, size in enumerate(sizes):
        before, after = n[size:capacity], n[: capacity - size]
        gap, sequence = capacity, [item]
        if len(some := np.flatnonzero(before)):
            change = 2 * (after[some] - before[some] + 1)
            if some[0] == 0:  # a sequence that becomes full leaves the sum
                change[0] = 1 - 2 * before[0]
            gap = int(some[change.argmin()]) + size
            n[gap] -= 1
            sequence = held[gap].pop()
            sequence.append(item)
        if gap == size:
            full.append(sequence)
        else:
            n[gap - size] += 1
            held[gap - size].append(sequence)
    return full, [s for of_gap in held for s in of_gap]


def pack_shard(sizes: np.ndarray, order: np.ndarray, capacity: int) -> tuple[list[list[int]], list[list[int]]]:
    """Full and open sequences of one shard by the sum of squares, from the longest item on, ties in the given order."""
    order = order[np.argsort(-sizes[order], kind="stable")]
    full, left = sum_of_squares(sizes[order].tolist(), capacity)
    return [[order[i] for i in s] for s in full], [[order[i] for i in s] for s in left]


def _mixed(numbers: np.ndarray) -> np.ndarray:
    x = numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def pack(items: DataFrame, capacity: int = CAPACITY, length: str = "length", shard_items: int = SHARD_ITEMS) -> DataFrame:
    """items with sequence_id and offset: rows with one sequence_id stand gapless from offset 0 and total capacity at most.

    Lengths are 1 to capacity; a row with another or none has null sequence_id and offset. Each task holds the numbers of
    shard_items rows, however many rows there are or repeat one another. Columns of items named sequence_id or offset are replaced.
    """
    columns = [c for c in items.columns if c not in ("sequence_id", "offset")]
    keyed = written(items.select(*columns, F.monotonically_increasing_id().alias("_item"), F.col(length).cast("int").alias("_size")), "items")
    whole = keyed.where(F.col("_size") == capacity).select(*columns, F.col("_item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    none = F.lit(None).cast("long")
    odd = keyed.where(F.col("_size").isNull() | ~F.col("_size").between(1, capacity)).select(*columns, none.alias("sequence_id"), none.alias("offset"))
    parts = [whole, odd]
    todo = keyed.where(F.col("_size").between(1, capacity - 1))
    shards = max(1, -(-todo.count() // shard_items))
    level = 1
    while True:
        placed = _placed(todo.repartition(shards, "_item"), capacity, level)
        if shards == 1:
            parts.append(placed.select(*columns, "sequence_id", "offset"))
            break
        placed = written(placed, "placed")
        parts.append(placed.where(~F.col("_open")).select(*columns, "sequence_id", "offset"))
        todo = placed.where("_open").select(*todo.columns)
        shards, level = max(1, -(-shards // FAN_IN)), level + 1
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _placed(shards: DataFrame, capacity: int, level: int) -> DataFrame:
    """Each partition packed on its own: rows with sequence_id, offset and whether their sequence is open (_open)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        table = pa.Table.from_batches(held)
        sizes = table.column("_size").to_numpy()
        order = np.argsort(_mixed(table.column("_item").to_numpy()), kind="stable")
        full, left = pack_shard(sizes, order, capacity)
        rows = np.array([i for s in full + left for i in s])
        number = np.repeat(np.arange(len(full) + len(left)), [len(s) for s in full + left])
        ahead = np.cumsum(sizes[rows]) - sizes[rows]
        first = np.append(True, number[1:] != number[:-1])
        offsets = ahead - ahead[np.flatnonzero(first)][number]
        base = (level << 56) + (TaskContext.get().partitionId() << 32)
        out = table.take(pa.array(rows))
        out = out.append_column("sequence_id", pa.array(number + base, pa.int64())).append_column("offset", pa.array(offsets, pa.int64())).append_column("_open", pa.array(number >= len(full)))
        yield from out.combine_chunks().to_batches()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shards.schema.fields)
    return shards.transform(in_batches, run, f"{fields}, sequence_id long, offset long, _open boolean")


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def cut(n: int, capacity: int) -> list[int]:
    """Bounds of the pieces of n tokens: whole below capacity, else the rest first and then full pieces."""
    return [0, *range(n % capacity or capacity, n + 1, capacity)]


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the token pieces of each whole text, end_id after each document.

    Null and empty texts hold end_id alone. Repeated rows give repeated pieces; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer_file), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                raw = memoryview(enc.raw(text.as_py()) + end)
                bounds = cut(len(raw) // 4, capacity)
                rows += [(doc_id, i, a, b - a, zlib.crc32(raw[4 * a : 4 * b])) for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PIECES.types, strict=True)], schema=_PIECES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).transform(in_batches, run, "doc_id long, piece int, start long, length long, ids_crc32 long", ("encoder", tokenizer_file))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    import public_tokenizers

    return pack(pieces(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
