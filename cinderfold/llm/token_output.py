"""Token ids in fixed-width bit packing.

A segment is a self-contained binary image: header, table of its documents, offsets of its blocks, packed ids. Each id
takes the least bits that hold the vocabulary. A block holds BLOCK ids; 64 ids fill exactly `bits` 64-bit words, so
both ways are 64 vectorised shifts whatever the width, and any id is found by its block's offset. Segments travel as
rows of a Parquet table: Spark's commit protocol then covers lost executors and any file system Spark can write.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinderfold.llm.common import in_batches, load, small
from cinderfold.llm.encoding import encoder
from cinderfold.sources.scratch import scratch

MAGIC = b"CFTB"
BLOCK = 4096
SEGMENT_IDS = 1 << 20
_HEAD = struct.Struct("<4sHHIQQQ")  # magic, version, bits, ids a block, ids, documents, blocks


def bits_for(n_vocab: int) -> int:
    """Least width that holds ids 0 to n_vocab - 1."""
    return max(1, int(n_vocab - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> np.ndarray:
    """Words of 64 bits; 64 ids take `bits` words, the last group is filled up with 0."""
    groups = -(-len(ids) // 64)
    full = np.zeros(groups * 64, np.uint64)
    full[: len(ids)] = ids
    lanes = np.ascontiguousarray(full.reshape(groups, 64).T)
    out = np.zeros((bits, groups), np.uint64)
    for lane in range(64):
        word, shift = divmod(lane * bits, 64)
        out[word] |= lanes[lane] << np.uint64(shift)
        if shift + bits > 64:
            out[word + 1] |= lanes[lane] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).reshape(-1)


def unpack(words: np.ndarray, bits: int, n: int) -> np.ndarray:
    """The first n ids of pack()'s words."""
    columns = np.ascontiguousarray(words.reshape(-1, bits).T)
    out = np.empty((64, columns.shape[1]), np.uint64)
    mask = np.uint64((1 << bits) - 1)
    for lane in range(64):
        word, shift = divmod(lane * bits, 64)
        value = columns[word] >> np.uint64(shift)
        if shift + bits > 64:
            value = value | (columns[word + 1] << np.uint64(64 - shift))
        out[lane] = value & mask
    return out.T.reshape(-1)[:n].astype("<u4")


def to_segment(doc_ids: list[int | None], ids: list[bytes] | list[memoryview], bits: int) -> bytes:
    """Image of one segment; ids: little-endian unsigned 32-bit integers of each document."""
    flat = np.frombuffer(b"".join(ids), "<u4")
    starts = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype("<u8")
    n_blocks = -(-len(flat) // BLOCK)
    words = pack(flat, bits)  # a block is a whole number of pack()'s groups, but for the last one
    offsets = np.minimum(np.arange(n_blocks + 1) * (BLOCK // 64 * bits * 8), words.nbytes).astype("<u8")
    known = np.array([d is not None for d in doc_ids], np.uint8)
    numbers = np.array([d or 0 for d in doc_ids], "<i8")
    head = _HEAD.pack(MAGIC, 1, bits, BLOCK, len(flat), len(doc_ids), n_blocks)
    return b"".join([head, numbers.tobytes(), known.tobytes(), starts.tobytes(), offsets.tobytes(), words.astype("<u8", copy=False).tobytes()])


class Segment:
    """Reader of to_segment()'s image; touches only the blocks it is asked for."""

    def __init__(self, image: bytes):
        magic, version, self.bits, self.block, self.n_ids, n_docs, n_blocks = _HEAD.unpack_from(image)
        if magic != MAGIC or version != 1:
            raise ValueError("not a token segment")
        at = _HEAD.size
        numbers = np.frombuffer(image, "<i8", n_docs, at)
        known = np.frombuffer(image, np.uint8, n_docs, at := at + 8 * n_docs)
        self.starts = np.frombuffer(image, "<u8", n_docs + 1, at := at + n_docs).astype(np.int64)
        self.offsets = np.frombuffer(image, "<u8", n_blocks + 1, at := at + 8 * (n_docs + 1)).astype(np.int64)
        self.doc_ids = [int(d) if k else None for d, k in zip(numbers, known, strict=True)]
        self.image, self.data = image, at + 8 * (n_blocks + 1)

    def ids(self, start: int = 0, n: int | None = None) -> np.ndarray:
        """n ids from position start."""
        stop = self.n_ids if n is None else min(self.n_ids, start + n)
        if stop <= start:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block
        words = np.frombuffer(self.image, "<u8", (self.offsets[last + 1] - self.offsets[first]) // 8, self.data + self.offsets[first])
        return unpack(words, self.bits, stop - first * self.block)[start - first * self.block :]


def write_tokens(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = 0) -> None:
    """Write the ids of whole texts, end_id after each document, in ascending doc_id order (null first).

    One range shuffle of (doc_id, text) by doc_id; each task encodes, packs and writes what it was dealt. Null and empty
    texts hold end_id alone; repeated rows stand in a row; equal doc_ids are ordered by text. Other columns are not read.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, before, seg = encoder(tokenizer_file), TaskContext.get().partitionId(), 0, 0
        bits = bits_for(max(enc.n_vocab, end_id + 1))
        numbers: list[int | None] = []
        held: list[memoryview] = []
        n = 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"part": [part], "segment": [seg], "part_start": [before], "n_ids": [n], "image": [to_segment(numbers, held, bits)]}, schema=_SEGMENTS)

        for batch in batches:
            ids, stops = enc.batch(batch.column("text"), end_id)
            flat, at = memoryview(ids.tobytes()), 0
            for doc_id, stop in zip(batch.column("doc_id").to_pylist(), stops.tolist(), strict=True):
                numbers.append(doc_id)
                held.append(flat[4 * at : 4 * stop])
                n, at = n + stop - at, stop
                if n >= SEGMENT_IDS:
                    yield row()
                    before, seg, numbers, held, n = before + n, seg + 1, [], [], 0
        if numbers:
            yield row()

    (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .repartitionByRange(F.asc_nulls_first("doc_id"))
        .sortWithinPartitions(F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))
        .transform(in_batches, encode, "part int, segment int, part_start long, n_ids long, image binary", ("encoder", tokenizer_file))
        .write.parquet(path)
    )


_SEGMENTS = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("part_start", pa.int64()), ("n_ids", pa.int64()), ("image", pa.binary())])
_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """part, segment, start (ids before it in the whole output), n_ids, image.

    Starts are a running sum over one row a part: as many as the writing job had tasks, never as many as documents.
    """
    rows = spark.read.schema("part int, segment int, part_start long, n_ids long, image binary").parquet(path)
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("part").agg(F.sum("n_ids").alias("n")).select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    return rows.join(small(parts, parts.count()), F.col("part") == F.col("p")).select("part", "segment", (F.col("base") + F.col("part_start")).alias("start"), "n_ids", "image")


def read_documents(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the packed bytes alone."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, image in zip(batch.column("start").to_pylist(), batch.column("image"), strict=True):
                seg = Segment(image.as_py())
                flat, at = memoryview(seg.ids().tobytes()), seg.starts
                crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": seg.doc_ids, "start": at[:-1] + start, "n_tokens": np.diff(at), "ids_crc32": crc}, schema=_READ)

    return segments.select("start", "image").transform(in_batches, decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of all documents, read back from the bit-packed table."""
    import public_tokenizers

    path = scratch(spark, "tokens")
    write_tokens(load(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_documents(read_segments(spark, path))
