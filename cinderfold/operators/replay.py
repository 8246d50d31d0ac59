"""A strict replay in parallel: which texts are accepted, each held against all that were accepted before it.

A text is accepted if at most half its shingles stand in accepted texts before it. Only shingles of several texts matter:

1. Shingles are dealt over buckets as 80-bit hashes, many to a row. Each bucket finds those of several texts.
2. A text of which at most half the shingles stand in any text before it is accepted, whatever becomes of those.
3. Of each shingle, the first accepted text covers all texts behind it for certain. What is open are the texts up to that
   one, if there is an undecided text ahead of them. Rounds of bounds from below and above decide texts and close shingles.
4. What few are left open are replayed in order in one task. If rounds decide little (long chains), the first texts that
   one task holds are replayed, so that no table needs as many rounds as it has texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderfold.sources.scratch import drop, scratch

GRAM = 4
#: The place of all texts accepted earlier than the table: one text ahead of all others, as large as they are together.
PRIOR = -(2**63)
#: Bytes of text whose shingles are one bucket, and the most buckets.
_BUCKET_BYTES, _MOST_BUCKETS = 8 << 20, 2048
#: One task replays so many open shingles of texts.
OPEN_ROWS = 1 << 17
_FLUSH, _VOCABULARY, _CHUNK, _SUMS = 1 << 19, 1 << 18, 4 << 20, 1 << 20
_WORD, _NO_LETTER = re.compile(rb"[a-z]+"), re.compile(rb"[^a-z]")
_ODD = np.random.default_rng(7).integers(0, 2**64, (2, GRAM), np.uint64) | np.uint64(1)
_DEALT = "bucket int, places binary, sizes binary, h binary, low binary"
_FOUND = "kind int, bucket int, at long, n long, places binary, sizes binary"
_TOTAL, _EARLIER, _SHARED = range(3)


class _Vocabulary(dict):
    """Words to rows of a table of their 128-bit hashes."""

    def __init__(self) -> None:
        super().__init__()
        self.table, self.fresh = np.zeros((1 << 12, 2), np.uint64), []

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = at = len(self)
        self.fresh.append(xxhash.xxh3_128_digest(word))
        return at

    def hashes(self, words: list[bytes]) -> np.ndarray:
        if len(self) > _VOCABULARY:
            self.clear()
        own = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.fresh:
            if len(self) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros((len(self), 2), np.uint64)])
            self.table[len(self) - len(self.fresh) : len(self)] = np.frombuffer(b"".join(self.fresh), np.uint64).reshape(-1, 2)
            self.fresh = []
        return self.table[own]


def _hashes(text: bytes, known: _Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """64 and 16 bits of the hash of each of the text's shingles, each once: runs of GRAM runs of letters, A-Z lower-cased."""
    text, at, parts = text.lower(), 0, []
    while at < len(text):
        end = min(at + _CHUNK, len(text))
        if end < len(text):
            end = m.start() if (m := _NO_LETTER.search(text, end)) else len(text)
        words = _WORD.findall(text, at, end)
        parts.append(known.hashes(words))
        at = end
    word = np.concatenate(parts) if parts else np.zeros((0, 2), np.uint64)
    n = max(0, len(word) - GRAM + 1)
    out = []
    with np.errstate(over="ignore"):
        for lane in range(2):
            h = np.zeros(n, np.uint64)
            for k in range(GRAM):
                h += word[k : k + n, lane] * _ODD[lane, k]
            h ^= h >> np.uint64(31)
            h *= np.uint64(0x9E3779B97F4A7C15)
            out.append(h ^ (h >> np.uint64(29)))
    h, first = np.unique(out[0], return_index=True)
    return h, (out[1][first] >> np.uint64(48)).astype(np.uint16)


def _planes(values: np.ndarray) -> bytes:
    """The bytes of numbers, first bytes first, so that what they have in common is packed well."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def _numbers(planes: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _deal(buckets: int):
    """Shingles of texts by bucket, as packed rows; the texts' numbers of shingles go in rows of buckets below 0."""
    schema = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("places", "sizes", "h", "low"))])

    def packed(at: list[int], hs: list[np.ndarray], lows: list[np.ndarray]) -> pa.RecordBatch:
        places, sizes = np.array(at, np.int64), np.array([len(x) for x in hs], np.int64)
        h, low, doc = np.concatenate(hs), np.concatenate(lows), np.repeat(np.arange(len(at)), sizes)
        bucket = ((h >> np.uint64(20)) % np.uint64(buckets)).astype(np.uint16)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
        rows = [(-1 - int(places[0]) % 64, _planes(places), _planes(sizes), b"", b"")]
        for b, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            if lo < hi:
                own = order[lo:hi]
                docs, n = np.unique(doc[own], return_counts=True)
                rows.append((b, _planes(places[docs]), _planes(n.astype(np.uint32)), h[own].tobytes(), low[own].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Vocabulary()
        at, hs, lows, held = [], [], [], 0
        for batch in batches:
            for place, text in zip(batch.column("at").to_pylist(), batch.column("text"), strict=True):
                h, low = _hashes(text.as_buffer().to_pybytes() if text.is_valid else b"", known)
                at.append(place)
                hs.append(h)
                lows.append(low)
                held += len(h) + 16
                if held > _FLUSH:
                    yield packed(at, hs, lows)
                    at, hs, lows, held = [], [], [], 0
        if at:
            yield packed(at, hs, lows)

    return run


class _Sums:
    """Counts by place, put together as they come."""

    def __init__(self, schema: pa.Schema, kind: int):
        self.schema, self.kind, self.at, self.n, self.held = schema, kind, [], [], 0

    def add(self, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        at, n = np.unique(at, return_counts=True)
        self.at.append(at)
        self.n.append(n)
        self.held += len(at)
        if self.held > _SUMS:
            yield from self.out()

    def out(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            at, back = np.unique(np.concatenate(self.at), return_inverse=True)
            n = np.bincount(back, np.concatenate(self.n)).astype(np.int64)
            yield _batch(self.schema, kind=np.full(len(at), self.kind), at=at, n=n)
            self.at, self.n, self.held = [], [], 0


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """The rows of each bucket; rows are sorted by bucket, which may run over batches."""
    bucket, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != bucket and held:
                yield bucket, held
                held = []
            bucket = row["bucket"]
            held.append(row)
    if held:
        yield bucket, held


_FOUND_SCHEMA = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("at", pa.int64()), ("n", pa.int64()), ("places", pa.binary()), ("sizes", pa.binary())])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts' numbers of shingles, and of those that stand in any text before; each bucket's shingles of several texts, with these."""
    earlier = _Sums(_FOUND_SCHEMA, _EARLIER)
    for bucket, rows in _by_bucket(batches):
        if bucket < 0:
            for r in rows:
                at = _numbers(r["places"], np.int64)
                yield _batch(_FOUND_SCHEMA, kind=np.full(len(at), _TOTAL), at=at, n=_numbers(r["sizes"], np.int64))
            continue
        h = np.concatenate([np.frombuffer(r["h"], np.uint64) for r in rows])
        low = np.concatenate([np.frombuffer(r["low"], np.uint16) for r in rows])
        at = np.concatenate([np.repeat(_numbers(r["places"], np.int64), _numbers(r["sizes"], np.uint32)) for r in rows])
        rows.clear()
        order = np.argsort(h)
        again = h[order[1:]] == h[order[:-1]]
        order = order[np.append(again, False) | np.append(False, again)]  # the others stand in one text only
        if not len(order):
            continue
        h, low, at = h[order], low[order], at[order]
        order = np.lexsort((at, low, h))
        h, low, at = h[order], low[order], at[order]
        first = np.append(True, (h[1:] != h[:-1]) | (low[1:] != low[:-1]))
        once = first | np.append(True, at[1:] != at[:-1])  # texts accepted earlier are one text
        at, first = at[once], first[once]
        sizes = np.diff(np.append(np.flatnonzero(first), len(at)))
        several = np.repeat(sizes > 1, sizes)
        at, first, sizes = at[several], first[several], sizes[sizes > 1]
        if len(at):
            yield _batch(_FOUND_SCHEMA, kind=[_SHARED], bucket=[bucket], places=[_planes(at)], sizes=[_planes(sizes.astype(np.uint32))])
            yield from earlier.add(at[~first])
    yield from earlier.out()


_OPEN_SCHEMA = pa.schema([("kind", pa.int32()), ("g", pa.int64()), ("at", pa.int64()), ("n", pa.int64())])
_COVERED, _OPEN = range(2)


def _first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of covered shingles by text, and open shingles, of each bucket, whose undecided texts (rows without sizes) come first."""
    covered = _Sums(_OPEN_SCHEMA, _COVERED)
    for bucket, rows in _by_bucket(batches):
        undecided = np.sort(np.concatenate([np.zeros(0, np.int64), *(_numbers(r["places"], np.int64) for r in rows if r["sizes"] is None)]))
        for r in rows:
            if r["sizes"] is None:
                continue
            at, sizes = _numbers(r["places"], np.int64), _numbers(r["sizes"], np.uint32).astype(np.int64)
            starts, g = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
            is_open = np.zeros(len(at), bool)
            if len(undecided):
                is_open = undecided[np.minimum(np.searchsorted(undecided, at), len(undecided) - 1)] == at
            place = np.arange(len(at))  # in order of place within each shingle
            accepted = np.minimum.reduceat(np.where(is_open, len(at), place), starts)[g]
            doubtful = np.minimum.reduceat(np.where(is_open, place, len(at)), starts)[g]
            yield from covered.add(at[place > accepted])
            left = (place >= doubtful) & (place <= accepted)
            if left.any():
                yield _batch(_OPEN_SCHEMA, kind=np.full(left.sum(), _OPEN), g=(np.int64(bucket) << 40) + g[left], at=at[left])
    yield from covered.out()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array([_planes(batch.column("at").to_numpy())], pa.binary())], ["places"])


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """at, n: open shingles of each text that turn out to be covered; rows (at, total, covered, g) are sorted by place."""
    prior: set[int] = set()
    place, limit, own = None, 0, []

    def decide() -> tuple[int, int]:
        n = sum(map(prior.__contains__, own))
        if 2 * n <= limit:
            prior.update(own)
        return place, n

    for batch in batches:
        out = []
        for at, total, covered, g in zip(*(batch.column(c).to_pylist() for c in ("at", "total", "covered", "g")), strict=True):
            if at != place:
                if place is not None:
                    out.append(decide())
                place, limit, own = at, total - 2 * covered, []
            own.append(g)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ([], []))], ["at", "n"])
    if place is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in decide()], ["at", "n"])


def table(df: DataFrame, name: str, files: int = 0) -> DataFrame:
    """df, written to the shared folder (in so many files at most) and read again."""
    path = scratch(df.sparkSession, name)
    (df.coalesce(files) if files else df).write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def _free(spark: SparkSession, *tables: DataFrame) -> None:
    for t in tables:
        drop(spark, t.scratch)


def placed(rows: DataFrame, order: str, text: str) -> tuple[DataFrame, int]:
    """at (long, unique, in order), ord (the order) and text of all rows, and the bytes of all texts.

    Null orders come first; ties go by text. Where the order is unique, at is the order itself.
    """
    rows = rows.select(F.col(order).cast("long").alias("ord"), F.col(text).cast("string").alias("text"))
    by = rows.groupBy("ord").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("bytes"))
    seen = by.agg(F.max("n").alias("most"), F.min(F.coalesce("ord", F.lit(PRIOR))).alias("least"), F.sum("bytes").alias("bytes")).first()
    if (seen.most or 1) == 1 and (seen.least is None or seen.least > PRIOR):
        return rows.select(F.col("ord").alias("at"), "ord", "text"), seen.bytes or 0
    in_order = rows.repartitionByRange("ord", F.xxhash64("text")).sortWithinPartitions("ord", "text")
    return table(in_order.select(F.monotonically_increasing_id().alias("at"), "ord", "text"), "placed"), seen.bytes


def replayed(texts: DataFrame, n_bytes: int, open_rows: int = OPEN_ROWS) -> DataFrame:
    """at, total, covered of texts (at, text; at is unique but for PRIOR): shingles, and those in accepted texts before.

    Accepted are texts with 2 * covered <= total. Texts at PRIOR count as accepted and are not returned. open_rows bounds
    what one task replays and changes no result.
    """
    spark = texts.sparkSession
    files = 2 * max(2, spark.sparkContext.defaultParallelism)
    buckets = min(_MOST_BUCKETS, max(1, -(-n_bytes // _BUCKET_BYTES)))
    dealt = texts.select("at", "text").mapInArrow(_deal(buckets), _DEALT).repartition("bucket").sortWithinPartitions("bucket")
    found = table(dealt.mapInArrow(_find, _FOUND), "found")
    sums = lambda kind, name: found.where(F.col("kind") == kind).groupBy("at").agg(F.sum("n").alias(name))
    docs = sums(_TOTAL, "total").join(sums(_EARLIER, "maybe"), "at", "left").select("at", "total", F.lit(0).cast("long").alias("covered"), F.coalesce("maybe", F.lit(0)).alias("maybe"))
    docs = table(docs.where(F.col("at") > PRIOR), "docs", files)
    every = F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket")
    undecided = docs.where(2 * F.col("maybe") > F.col("total")).select("at").mapInArrow(_chunks, "places binary").select(every, "places", F.lit(None).cast("binary").alias("sizes"))
    shared = found.where(F.col("kind") == _SHARED).select("bucket", "places", "sizes")
    ruled = undecided.unionByName(shared).repartition("bucket").sortWithinPartitions("bucket")
    first = table(ruled.mapInArrow(_first_round, "kind int, g long, at long, n long"), "first-round")
    covered = first.where(F.col("kind") == _COVERED).groupBy("at").agg(F.sum("n").alias("n"))
    left = first.where(F.col("kind") == _OPEN).select("g", "at")
    docs, left = _decided(docs, covered, left, files)
    _free(spark, found, first)
    n = left.count()
    while n > open_rows:
        was, accepted, rejected = n, 2 * (F.col("covered") + F.col("maybe")) <= F.col("total"), 2 * F.col("covered") > F.col("total")
        docs, left, n = _round(docs, left, docs.select("at", accepted.alias("yes"), (accepted | rejected).alias("known")), files)
        if open_rows < n and 2 * n > was:
            cut = left.approxQuantile("at", [open_rows / n], 0.001)[0]
            extra = _replay(docs, left.where(F.col("at") <= cut))
            known = docs.join(extra, "at", "left").select("at", (2 * (F.col("covered") + F.coalesce("n", "maybe")) <= F.col("total")).alias("yes"), (F.col("n").isNotNull() | accepted | rejected).alias("known"))
            docs, left, n = _round(docs, left, known, files)
    if not n:
        return docs.select("at", "total", "covered")
    extra = _replay(docs, left)
    return docs.join(extra, "at", "left").select("at", "total", (F.col("covered") + F.coalesce("n", F.lit(0))).alias("covered"))


def _replay(docs: DataFrame, left: DataFrame) -> DataFrame:
    """at, n of the texts of open shingles: how many of these are covered, in one task."""
    rows = left.join(docs, "at").select("at", "total", "covered", "g")
    return table(rows.repartition(1).sortWithinPartitions("at").mapInArrow(_in_order, "at long, n long"), "in-order")


def _decided(docs: DataFrame, covered: DataFrame, left: DataFrame, files: int) -> tuple[DataFrame, DataFrame]:
    """docs with what is covered by now, and maybe: open shingles that may be covered still, so all but their first text's."""
    left = table(left, "open", files)
    first = left.groupBy("g").agg(F.min("at").alias("at"))
    maybe = left.join(first, ["g", "at"], "left_anti").groupBy("at").agg(F.count("*").alias("maybe"))
    own = docs.drop("maybe").join(covered, "at", "left").join(maybe, "at", "left")
    return table(own.select("at", "total", (F.col("covered") + F.coalesce("n", F.lit(0))).alias("covered"), F.coalesce("maybe", F.lit(0)).cast("long").alias("maybe")), "docs", files), left


def _round(docs: DataFrame, left: DataFrame, known: DataFrame, files: int) -> tuple[DataFrame, DataFrame, int]:
    """docs, open shingles and their number under the decisions known (at, yes, known)."""
    rows = left.join(known.select("at", (F.col("known") & F.col("yes")).alias("yes"), "known"), "at")
    firsts = rows.groupBy("g").agg(F.min(F.when(F.col("yes"), F.col("at"))).alias("a"), F.min(F.when(~F.col("known"), F.col("at"))).alias("d"))
    rows = table(rows.select("g", "at").join(firsts, "g"), "round", files)
    covered = rows.where(F.col("at") > F.col("a")).groupBy("at").agg(F.count("*").alias("n"))
    still = rows.where((F.col("at") >= F.col("d")) & (F.col("a").isNull() | (F.col("at") <= F.col("a")))).select("g", "at")
    new, still = _decided(docs, covered, still, files)
    _free(docs.sparkSession, rows, docs, left)
    return new, still, still.count()


def accepted() -> Column:
    return 2 * F.col("covered") <= F.col("total")


def overlap() -> Column:
    return F.col("covered") / F.greatest(F.col("total"), F.lit(1))
