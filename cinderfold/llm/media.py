"""ISO media containers (MP4, MOV): facts from boxes and sample tables, without decoding payloads.

`read_media` walks nested boxes and decodes stsd, mdhd, stts, stsc, stsz, stco or co64 and stss. `mux` writes a small
container with one track of 8-bit samples, for payloads that are to be kept as media.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderfold.llm.common import in_batches, load, written

#: Boxes that hold boxes. Fixed names of ISO/IEC 14496-12.
CONTAINERS = frozenset((b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"mvex", b"moof", b"traf", b"udta"))

UNIT = 64  # bytes of one sample (access unit) that mux() writes
RATE = 8000
UNITS_A_CHUNK = 32
UNITS_A_KEYFRAME = 16
_OUT_BYTES = 16 << 20


class BrokenMedia(ValueError):
    """The bytes aren't a whole ISO media container."""


@dataclass
class Track:
    handler: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    tables: dict[str, np.ndarray] = field(default_factory=dict)
    fixed_size: int = 0
    n_samples: int = 0

    def samples(self) -> np.ndarray:
        """Offset and size of each sample, from the chunk and size tables alone."""
        sizes = np.full(self.n_samples, self.fixed_size, np.int64) if self.fixed_size else self.tables.get("stsz", np.zeros(0, np.int64))
        chunks = self.tables.get("chunks", np.zeros(0, np.int64))
        runs = self.tables.get("stsc", np.zeros((0, 2), np.int64))
        if len(sizes) and (not len(chunks) or not len(runs)):
            raise BrokenMedia("samples without chunks")
        if not len(sizes):
            return np.zeros((0, 2), np.int64)
        first = np.append(runs[:, 0] - 1, len(chunks))
        in_chunk = np.repeat(runs[:, 1], np.diff(first))
        starts = np.concatenate([[0], np.cumsum(in_chunk)])
        if starts[-1] < len(sizes):
            raise BrokenMedia("chunks hold too few samples")
        chunk = np.searchsorted(starts, np.arange(len(sizes)), side="right") - 1
        ahead = np.concatenate([[0], np.cumsum(sizes)])
        offsets = chunks[chunk] + ahead[:-1] - ahead[np.minimum(starts[chunk], len(sizes))]
        return np.stack([offsets, sizes], 1)

    def keyframes(self) -> np.ndarray:
        """Offset and size of each sync sample; without stss all samples are."""
        samples = self.samples()
        return samples[self.tables["stss"] - 1] if "stss" in self.tables else samples


def boxes(data: bytes, start: int, stop: int) -> Iterator[tuple[bytes, int, int]]:
    """Kind, start of the body and end of each box from start to stop."""
    while start < stop:
        if start + 8 > stop:
            raise BrokenMedia("cut off in a box header")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if start + 16 > stop:
                raise BrokenMedia("cut off in a box header")
            size, body = struct.unpack_from(">Q", data, body)[0], start + 16
        elif size == 0:
            size = stop - start
        if size < body - start or start + size > stop:
            raise BrokenMedia(f"box {kind!r} runs past its parent")
        yield kind, body, start + size
        start += size


def _table(data: bytes, at: int, stop: int, kind: str, columns: int) -> np.ndarray:
    n = struct.unpack_from(">I", data, at + 4)[0]
    if at + 8 + n * columns * np.dtype(kind).itemsize > stop:
        raise BrokenMedia("a sample table is cut off")
    return np.frombuffer(data, kind, n * columns, at + 8).astype(np.int64).reshape(n, columns)


def read_media(data: bytes) -> list[Track]:
    """All tracks of a container."""
    tracks: list[Track] = []

    def walk(start: int, stop: int, track: Track | None, depth: int) -> None:
        for kind, at, end in boxes(data, start, stop):
            if kind in CONTAINERS:
                if depth > 16:
                    raise BrokenMedia("boxes nested too deep")
                if kind == b"trak":
                    tracks.append(Track())
                    walk(at, end, tracks[-1], depth + 1)
                else:
                    walk(at, end, track, depth + 1)
            elif track is None:
                continue
            elif kind == b"mdhd":
                track.timescale, track.duration = struct.unpack_from(">IQ", data, at + 20) if data[at] else struct.unpack_from(">II", data, at + 12)
            elif kind == b"hdlr":
                track.handler = data[at + 8 : at + 12].decode("latin-1")
            elif kind == b"stsd":
                track.codec = data[at + 12 : at + 16].decode("latin-1")
            elif kind == b"stts":
                track.tables["stts"] = _table(data, at, end, ">u4", 2)
            elif kind == b"stsc":
                track.tables["stsc"] = _table(data, at, end, ">u4", 3)[:, :2]
            elif kind == b"stss":
                track.tables["stss"] = _table(data, at, end, ">u4", 1)[:, 0]
            elif kind in (b"stco", b"co64"):
                track.tables["chunks"] = _table(data, at, end, ">u4" if kind == b"stco" else ">u8", 1)[:, 0]
            elif kind == b"stsz":
                track.fixed_size, track.n_samples = struct.unpack_from(">II", data, at + 4)
                if not track.fixed_size:
                    track.tables["stsz"] = _table(data, at + 4, end, ">u4", 1)[:, 0]

    try:
        walk(0, len(data), None, 0)
    except (struct.error, IndexError) as error:
        raise BrokenMedia("a box is cut off") from error
    if not tracks:
        raise BrokenMedia("no track")
    return tracks


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def mux(payload: bytes) -> bytes:
    """A container of one sound track: unsigned 8-bit samples in units of 64 bytes, the index ahead of the payload.

    payload: a positive multiple of 64 bytes, below 4 GB. Equal payloads give equal bytes (all times are 0).
    """
    n = len(payload) // UNIT
    chunk_bytes = UNIT * UNITS_A_CHUNK
    n_chunks = -(-n // UNITS_A_CHUNK)
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    sync = np.arange(1, n + 1, UNITS_A_KEYFRAME, dtype=">u4")
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    runs = [(1, UNITS_A_CHUNK, 1)] if n >= UNITS_A_CHUNK else []
    if n % UNITS_A_CHUNK:
        runs.append((n_chunks, n % UNITS_A_CHUNK, 1))
    head = _box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isomqt  ")

    def moov(first: int) -> bytes:
        chunks = (first + chunk_bytes * np.arange(n_chunks, dtype=np.int64)).astype(">u4")
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, UNIT)),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            _full(b"stsz", struct.pack(">II", UNIT, n)),
            _full(b"stco", struct.pack(">I", n_chunks), chunks.tobytes()),
            _full(b"stss", struct.pack(">I", len(sync)), sync.tobytes()),
        )
        minf = _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), stbl)
        mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, len(payload), 0x55C4, 0)), _full(b"hdlr", bytes(4), b"soun", bytes(13)), minf)
        trak = _box(b"trak", _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, len(payload)), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), matrix, bytes(8), flags=7), mdia)
        return _box(b"moov", _full(b"mvhd", struct.pack(">IIII", 0, 0, RATE, len(payload)), struct.pack(">IH", 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2)), trak)

    first = len(head) + len(moov(0)) + 8
    return head + moov(first) + _box(b"mdat", payload)


def demux(data: bytes, track: Track) -> bytes:
    """The track's samples in order."""
    samples = track.samples()
    joins = np.flatnonzero(np.append(True, samples[1:, 0] != samples[:-1].sum(1))) if len(samples) else []
    ends = np.append(joins[1:], len(samples)) if len(samples) else []
    return b"".join(data[samples[a, 0] : samples[b - 1].sum()] for a, b in zip(joins, ends, strict=True))


def feature(track: Track) -> str:
    """codec/timescale/duration/samples/keyframes as offset+size."""
    keys = ",".join(f"{a}+{b}" for a, b in track.keyframes().tolist())
    return f"{track.codec.strip()}/{track.timescale}/{track.duration}/{len(track.samples())}/{keys}"


def media_columns(df: DataFrame, content: str = "content") -> DataFrame:
    """df's columns with a struct `media`: codec, handler, timescale, duration, seconds, n_samples, keyframes, error, tracks.

    tracks has the same facts (codec to keyframes) of every track, the other fields those of the first; df's other columns
    pass untouched (a column of df named media is replaced). Null content: null media. Bytes that aren't a container: error
    says why, the rest is null. Of a container with fragments, which are not decoded, error says so, and what depends on
    samples is null. Payload bytes are never decoded.
    """
    facts_of = [("codec", pa.string()), ("handler", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("seconds", pa.float64()), ("n_samples", pa.int64()), ("keyframes", pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64())])))]
    kind = pa.struct([*facts_of, ("error", pa.string()), ("tracks", pa.list_(pa.struct(facts_of)))])
    of_track = "codec:string,handler:string,timescale:bigint,duration:bigint,seconds:double,n_samples:bigint,keyframes:array<struct<offset:bigint,size:bigint>>"
    said = f"struct<{of_track},error:string,tracks:array<struct<{of_track}>>>"

    def of(t: Track, fragments: bool) -> dict:
        out = {"codec": t.codec, "handler": t.handler, "timescale": t.timescale}
        if not fragments:
            keys = [{"offset": a, "size": b} for a, b in t.keyframes().tolist()]
            out |= {"duration": t.duration, "seconds": t.duration / t.timescale if t.timescale else None, "n_samples": len(t.samples()), "keyframes": keys}
        return out

    @F.arrow_udf(said)
    def facts(column: pa.Array) -> pa.Array:
        out = []
        for x in column:
            data = x.as_py()
            if data is None:
                out.append(None)
                continue
            try:
                fragments = any(box == b"moof" for box, _, _ in boxes(data, 0, len(data)))
                tracks = [of(t, fragments) for t in read_media(data)]
                out.append({**tracks[0], "error": "fragments (moof) are not decoded" if fragments else None, "tracks": tracks})
            except (BrokenMedia, IndexError) as error:
                out.append({"error": str(error)})
        return pa.array(out, kind)

    return df.withColumn("media", facts(F.col(content)))


_STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
_READ = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text's bytes, filled with 0 to a positive multiple of 64, as a container.

    Null text: empty. Rows pass one to one; other columns are not read.
    """

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                rows.append((doc_id, len(raw), mux(raw + bytes(-len(raw) % UNIT or UNIT * (not raw)))))
                held += len(rows[-1][2])
                if held > _OUT_BYTES:
                    yield pa.RecordBatch.from_pylist([dict(zip(_STORED.names, r, strict=True)) for r in rows], _STORED)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(_STORED.names, r, strict=True)) for r in rows], _STORED)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).transform(in_batches, store, "doc_id long, n_bytes long, media binary")


def read_stored(stored: DataFrame) -> DataFrame:
    """Digests of payload and container, and the container's facts, from the stored bytes alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, n, media in zip(batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist(), batch.column("media"), strict=True):
                data = media.as_buffer().to_pybytes()
                track = read_media(data)[0]
                payload = demux(data, track)
                rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature(track)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _READ.types, strict=True)] if rows else [pa.array([], t) for t in _READ.types], schema=_READ)

    return stored.transform(in_batches, read, ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in _READ))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as stored media: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    return read_stored(written(store_texts(load(spark, sf_dir, "documents")), "media"))
