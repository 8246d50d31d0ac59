"""Repeated passages, byte by byte, by longest previous factors.

A byte goes if a string of `length` bytes around it also starts elsewhere: earlier (keep="first", the longest previous
factor is long enough) or anywhere (keep="none", the longest previous or next factor is). A suffix array of a whole corpus
can't be dealt out to tasks, so suffixes are ordered where they can have a twin:

1. Every window of `length` bytes has an anchor, its least run of GRAM bytes by hash (the leftmost, if tied). Equal
   windows have equal anchors at equal places, so a window's suffix need only be ordered among those at the same distance
   ahead of the same gram.
2. Anchors with equal surroundings on both sides (all windows around them equal) are one class, found by a count.
3. Only classes that share an anchor's gram but not its surroundings are laid out: each sends its surroundings once. The
   suffixes that start 0, 1, 2, ... bytes ahead of the gram are put in order, each from the one before by a stable sort of
   one more byte, and classes of equal prefixes are carried along, so that runs of suffixes with `length` common bytes are
   known from the bytes themselves. A suffix has an earlier factor of that length if the nearest smaller position before
   or behind it in suffix order lies in its run, which is to say if it isn't the run's least.
4. Covered stretches go back to the documents by row key.

Whatever the number of copies, a class is counted before the shuffle and sent once. A gram with more than GROUP_ROWS
classes is split by window. Grams, equal surroundings and the windows of such grams are told apart by 64-bit hashes: always
two together, of the gram and of what is around it.
"""

from __future__ import annotations


from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderfold.llm.common import drop_written, in_batches, load, row_key, written

LENGTH = 400
GRAM = 128  # a power of two
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PLACE_BITS = 24
_SEGMENT = 1 << 23
_FLUSH = 8 << 20
_ROWS = 4096
_HASHED = 512
#: Grams with more kinds of surroundings than one task holds (about 3 KB each) are split by window.
GROUP_ROWS = 1 << 15


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of every run of `gram` bytes, put together from halves."""
    h, factor, size = data.astype(np.uint64) + np.uint64(1), _BASE, 1
    with np.errstate(over="ignore"):
        while size < gram:
            h, factor, size = h[:-size] * factor + h[size:], factor * factor, 2 * size
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Places and gram hashes of the anchors of all windows of a text; a long text is taken in overlapping segments."""
    width = length - gram + 1
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    places, hashes = [], []
    low = np.uint64((1 << _PLACE_BITS) - 1)
    for at in range(0, len(data) - length + 1, _SEGMENT):
        h = gram_hashes(data[at : at + _SEGMENT + length - 1], gram)
        n = len(h)
        grid = np.full(-(-n // width) * width, np.uint64(2**64 - 1))
        grid[:n] = (h & ~low) | np.arange(n, dtype=np.uint64)
        grid = grid.reshape(-1, width)
        ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        least = (np.minimum(behind[: n - width + 1], ahead[width - 1 : n]) & low).astype(np.int64)
        least = least[np.append(True, least[1:] != least[:-1])]
        places.append(least + at)
        hashes.append(h[least])
    at, g = np.concatenate(places), np.concatenate(hashes)
    new = np.append(True, at[1:] != at[:-1])  # windows on both sides of a border mostly share an anchor
    return at[new], g[new]


_ANCHORS = pa.schema([("g", pa.int64()), ("c", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("at", pa.int64())])


def _anchor_rows(length: int):
    import xxhash

    side = length - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k1, k2, text in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), batch.column("text"), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                if len(raw) < length:
                    continue
                at, g = anchors(np.frombuffer(raw, np.uint8), length)
                c = np.fromiter((xxhash.xxh3_64_intdigest(raw[max(0, a - side) : a + length], min(a, side)) for a in at.tolist()), np.uint64, len(at))
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(c.view(np.int64)), pa.array(np.full(len(at), k1)), pa.array(np.full(len(at), k2)), pa.array(at)], schema=_ANCHORS)

    return _in_large_batches(run)


def _in_large_batches(run):
    """Put small batches together before they go to the JVM."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in run(batches):
            held.append(b)
            size += b.nbytes
            if size > _FLUSH:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return joined


def _surroundings(length: int):
    """g, c, left and bytes around the anchors that a document (packed, with its list of anchors) has to lay out."""
    side = length - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for k1, k2, packed, todo in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), batch.column("packed"), batch.column("todo").to_pylist(), strict=True):
                raw = unpack.decompress(packed.as_buffer().to_pybytes())
                yield pa.RecordBatch.from_pydict({"g": [t["g"] for t in todo], "c": [t["c"] for t in todo], "k1": [k1] * len(todo), "k2": [k2] * len(todo), "at": [t["at"] for t in todo], "around": [raw[max(0, t["at"] - side) : t["at"] + length] for t in todo], "kinds": [t["kinds"] for t in todo]}, schema=_AROUND)

    return _in_large_batches(run)


_AROUND = pa.schema([*_ANCHORS, ("around", pa.binary()), ("kinds", pa.int64())])


def window_hashes(around: list[bytes], left: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the window at each start (column) of each surroundings (row), and whether there is one.

    Hashes of one column compare with each other only.

    The anchor is at place left of its surroundings; columns count from as far left as a window can start.
    """
    side = length - GRAM
    width = side + length
    windows, real = np.zeros((len(around), side + 1), np.uint64), np.zeros((len(around), side + 1), bool)
    starts = np.arange(side + 1)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(width, _BASE | np.uint64(1)))
        for a in range(0, len(around), _HASHED):
            own, at = around[a : a + _HASHED], left[a : a + _HASHED]
            sizes = np.array([len(x) for x in own])
            text = np.zeros((len(own), width), np.uint64)
            flat = np.frombuffer(b"".join(own), np.uint8)
            column = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(side - at, sizes)
            text[np.repeat(np.arange(len(own)), sizes), column] = (flat.astype(np.uint64) + np.uint64(1)) * powers[column]
            sums = np.concatenate([np.zeros((len(own), 1), np.uint64), np.cumsum(text, axis=1, dtype=np.uint64)], axis=1)
            windows[a : a + _HASHED] = sums[:, length:] - sums[:, : side + 1]
            real[a : a + _HASHED] = (starts >= (side - at)[:, None]) & (starts + length <= (side - at + sizes)[:, None])
    return windows, real


def covered(around: list[bytes], left: np.ndarray, group: np.ndarray, length: int, keep: str) -> tuple[np.ndarray, np.ndarray]:
    """Bounds, from the anchor on, of what each of the groups' surroundings has covered; bounds are equal if nothing is.

    around: by group, and in order of position within it, with the anchor at place left. All windows hold the anchor, so
    what they cover is one stretch.
    """
    side, m = length - GRAM, len(around)
    sizes = np.array([len(x) for x in around])
    right = sizes - left - GRAM
    data = np.zeros((m, 2 * side), np.uint16)  # bytes from 1, the gram left out; 0: outside of the text
    flat = np.frombuffer(b"".join(around), np.uint8)
    column = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes + left, sizes)  # from the anchor
    outside = (column < 0) | (column >= GRAM)
    column = np.where(column < 0, column + side, column + side - GRAM)[outside]
    data[np.repeat(np.arange(m), sizes)[outside], column] = flat[outside] + np.uint16(1)

    # Suffixes from the gram on: in order of what is behind it, with the bytes that neighbours have in common there.
    behind = np.ascontiguousarray(data[:, side:].astype(">u2")).view(f"S{2 * side}").reshape(-1)
    order = np.lexsort((behind, group))
    differs = np.concatenate([data[order[1:], side:] != data[order[:-1], side:], np.ones((m - 1, 1), bool)], axis=1)
    common = np.where(group[order[1:]] == group[order[:-1]], differs.argmax(1), -1)
    place = np.empty(m, np.int64)
    ahead = group.astype(np.int64)  # class of the bytes ahead of the gram
    first, last = np.full(m, -1), np.full(m, -1)  # most and fewest bytes ahead of the gram at which a window is covered
    for at, byte in enumerate(np.concatenate([np.zeros((1, m), np.uint16), data[:, :side].T[::-1]])):  # at: bytes ahead of the gram
        if at == 0:
            by_place = np.append(-1, common)
            place[order] = np.arange(m)
        else:
            order = order[np.lexsort((byte[order], group[order]))]
            new = np.append(True, (byte[order[1:]] != byte[order[:-1]]) | (ahead[order[1:]] != ahead[order[:-1]]))
            ahead = ahead.copy()
            ahead[order] = np.cumsum(new)
        same = np.cumsum(by_place < side - at)[place]  # class of the bytes behind the gram that the window still holds
        starts = np.append(True, (ahead[order[1:]] != ahead[order[:-1]]) | (same[order[1:]] != same[order[:-1]]))
        run = np.cumsum(starts) - 1
        many = np.bincount(run) > 1
        hit = many[run] & (left[order] >= at) & (right[order] >= side - at)
        if keep == "first":
            hit &= order > np.minimum.reduceat(order, np.flatnonzero(starts))[run]
        some = order[hit]
        first[some] = at
        last[some] = np.where(last[some] < 0, at, last[some])
    return np.where(first >= 0, -first, 0), np.where(first >= 0, length - last, 0)


_COVER = pa.schema([("g", pa.int64()), ("c", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])


def _groups(length: int, keep: str):
    """covered() of groups of rows sorted by gram and position, many groups at a time; groups may run over batches."""
    side = length - GRAM

    def of_groups(rows: list[tuple]) -> pa.RecordBatch | None:
        g = np.array([r[0] for r in rows])
        lo, hi = covered([r[3] for r in rows], np.array([min(r[2], side) for r in rows]), np.cumsum(np.append(True, g[1:] != g[:-1])), length, keep)
        some = np.flatnonzero(hi > lo)
        return pa.RecordBatch.from_pydict({"g": g[some], "c": [rows[i][1] for i in some], "lo": lo[some], "hi": hi[some]}, schema=_COVER) if len(some) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        seen: set[int] = set()
        for batch in batches:
            for row in zip(batch.column("g").to_pylist(), batch.column("c").to_pylist(), batch.column("at").to_pylist(), batch.column("around").to_pylist(), strict=True):
                if held and held[-1][0] != row[0]:
                    seen = set()
                    if len(held) >= _ROWS:
                        if (out := of_groups(held)) is not None:
                            yield out
                        held = []
                if row[1] not in seen:  # repeated documents bring a class more than once
                    seen.add(row[1])
                    held.append(row)
        if held and (out := of_groups(held)) is not None:
            yield out

    return _in_large_batches(run)


def _windows(length: int):
    """One row a window of surroundings: g, c, start (column), w (hash), with the position that orders copies."""
    schema = pa.schema([("g", pa.int64()), ("c", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("at", pa.int64()), ("start", pa.int64()), ("w", pa.int64())])
    side = length - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, _HASHED):
                part = batch.slice(a, _HASHED)
                windows, real = window_hashes(part.column("around").to_pylist(), np.minimum(part.column("at").to_numpy(), side), length)
                row, start = np.nonzero(real)
                own = part.select(["g", "c", "k1", "k2", "at"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(start), pa.array(windows[row, start].view(np.int64))], schema=schema)

    return run


def _crowded(around: DataFrame, length: int, keep: str) -> DataFrame:
    """As _groups(), for grams with more surroundings than one task should hold: each window is a key of its own.

    Copies of a window are counted before the shuffle, so a passage in a third of all documents is as light as any.
    """
    side = length - GRAM
    windows = around.transform(in_batches, _windows(length), "g long, c long, k1 long, k2 long, at long, start long, w long")
    place = F.struct("k1", "k2", "at")
    twins = windows.groupBy("g", "start", "w").agg(F.min(F.struct(place, "c")).alias("first"), F.max(F.struct(place, "c")).alias("last")).where(F.col("first.c") != F.col("last.c"))
    hit = windows.join(twins, ["g", "start", "w"])
    if keep == "first":
        hit = hit.where(F.col("first.c") != F.col("c"))
    return hit.groupBy("g", "c").agg((F.min("start") - side).alias("lo"), (F.max("start") + length - side).alias("hi"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        texts = pa.array([pack.compress(t.as_buffer().to_pybytes()) if t.is_valid else pack.compress(b"") for t in batch.column("text")], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("k1"), batch.column("k2"), texts], ["doc_id", "k1", "k2", "packed"])


def repeated_spans(docs: DataFrame, length: int = LENGTH, keep: str = "none", group_rows: int = GROUP_ROWS) -> DataFrame:
    """k1, k2 (row key), lo, hi: stretches of bytes to remove, which may overlap; hi may be past the text's end.

    keep: "none" for every copy, "first" to leave the copy with the least row key and place. Rows equal in doc_id and
    text fare alike. Null texts are empty; texts below `length` bytes have no stretch. Other columns are not read.
    """
    if length <= GRAM:
        raise ValueError(f"length: above {GRAM}")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key(), F.col("text").cast("string").alias("text"))
    side = length - GRAM
    found = texts.select("k1", "k2", "text").transform(in_batches, _anchor_rows(length), "g long, c long, k1 long, k2 long, at long")
    every = written(found.groupBy("g", "c").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "at")).alias("m")).select("g", "c", "n", "m.*"), "every-class")
    kinds = every.groupBy("g").agg(F.count("*").alias("kinds"), F.max("n").alias("most")).where("kinds > 1 or most > 1").select("g", "kinds")
    classes = every.join(written(kinds, "kinds"), "g").where((F.col("kinds") > 1) | (F.col("n") > 1))  # both sides as they are read: skew is split
    classes = written(classes, "classes")
    drop_written(every)
    todo = classes.where("kinds > 1").groupBy("k1", "k2").agg(F.collect_list(F.struct("g", "c", "at", "kinds")).alias("todo"))
    packed = texts.where(F.octet_length("text") >= length).transform(in_batches, _packed, "doc_id long, k1 long, k2 long, packed binary").drop("doc_id")
    around = packed.join(todo, ["k1", "k2"]).transform(in_batches, _surroundings(length), "g long, c long, k1 long, k2 long, at long, around binary, kinds long")
    mixed = around.where(F.col("kinds") <= group_rows).drop("kinds").repartition("g").sortWithinPartitions("g", "k1", "k2", "at").transform(in_batches, _groups(length, keep), "g long, c long, lo long, hi long")
    if classes.where(F.col("kinds") > group_rows).limit(1).count():
        mixed = mixed.unionByName(_crowded(around.where(F.col("kinds") > group_rows), length, keep))
    whole = classes.where("n > 1").select("g", "c", F.lit(-side).cast("long").alias("lo"), F.lit(length).cast("long").alias("hi"), F.col("k1").alias("m1"), F.col("k2").alias("m2"), F.col("at").alias("m3"))
    none = F.lit(None).cast("long")
    cover = written(whole.unionByName(mixed.select("g", "c", "lo", "hi", none.alias("m1"), none.alias("m2"), none.alias("m3"))), "cover")
    again = texts.select("k1", "k2", "text").transform(in_batches, _anchor_rows(length), "g long, c long, k1 long, k2 long, at long")
    spans = again.join(cover, ["g", "c"])
    if keep == "first":  # a class's first member is only covered by what its own surroundings show, the others throughout
        is_first = (F.col("k1") == F.col("m1")) & (F.col("k2") == F.col("m2")) & (F.col("at") == F.col("m3"))
        spans = spans.where(F.col("m1").isNull() | ~is_first)
    return spans.select("k1", "k2", F.greatest(F.col("at") + F.col("lo"), F.lit(0)).alias("lo"), (F.col("at") + F.col("hi")).alias("hi")).distinct()


def merged(spans: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """Maximal runs of the union, within n bytes."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        hi = min(hi, n)
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


def without_repeats(docs: DataFrame, length: int = LENGTH, keep: str = "none", group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, n_bytes, spans (removed runs, array of lo and hi), kept (the remaining bytes) of every row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key(), F.col("text").cast("string").alias("text"))
    spans = repeated_spans(docs, length, keep, group_rows).groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    rows = texts.transform(in_batches, _packed, "doc_id long, k1 long, k2 long, packed binary").join(spans, ["k1", "k2"], "left")
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))), ("kept", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            held, size = [], 0
            for doc_id, packed, own in zip(batch.column("doc_id").to_pylist(), batch.column("packed"), batch.column("spans").to_pylist(), strict=True):
                raw = unpack.decompress(packed.as_buffer().to_pybytes())
                runs = merged([(s["lo"], s["hi"]) for s in own or []], len(raw))
                ends = [0, *(x for r in runs for x in r), len(raw)]
                held.append((doc_id, len(raw), [{"lo": a, "hi": b} for a, b in runs], b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))))
                size += len(raw)
                if size > _FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    return rows.select("doc_id", "packed", "spans").transform(in_batches, cut, "doc_id long, n_bytes long, spans array<struct<lo:bigint,hi:bigint>>, kept binary")


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, text of all documents, every copy of 400 repeated bytes removed.

    text: the remaining bytes; where a cut left a part of a character, U+FFFD stands for it (the digest is of the bytes).
    """
    out = without_repeats(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))
