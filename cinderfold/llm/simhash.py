"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints within radius r link. Each distinct fingerprint emits all its variants within half the radius; two balls of
that size meet in some variant exactly if their centres are within twice the half. An odd radius leaves one bit over: it
is met by leaving out one of BLOCKS blocks of bits, as some block holds one of the differing bits, and the rest differs
in one bit less. Fingerprints that share a variant are verified by their differing bits. Each bucket of a variant sends
on a star of its linked members, never their pairs, and components are found by contracting the links round by round.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderfold.llm.common import drop_written, in_batches, load, row_key, written

RADIUS = 3
WORDS = 3
SEED = 42
BLOCKS = 3
_SMALL = 24  # buckets of at most so many fingerprints are compared side by side
_ROWS = 1 << 14


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of every run of `words` words (A-Z lower-cased, space-joined), repeats included; of all words if fewer."""
    import xxhash

    parts = text.lower().split()  # bytes: A-Z only, split at 0x20 and 0x09 to 0x0D
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    n = max(1, len(parts) - words + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[min(words, len(parts)) - 1 :].tolist()
    return np.fromiter(map(xxhash.xxh64_intdigest, [joined[a:b] for a, b in zip(starts, stops, strict=True)], repeat(SEED)), np.uint64, n)


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """64 bits, each 1 if set in over half the shingles' hashes; 0 for a text without words."""
    h = shingle_hashes(text, words)
    counts = np.zeros(64, np.int64)
    for a in range(0, len(h), _ROWS):
        counts += np.unpackbits(h[a : a + _ROWS].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, k1, k2 (the row's key), fp (the fingerprint as a signed long) of every row's whole text; null is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", words) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("k1"), batch.column("k2"), pa.array(fps.view(np.int64))], ["doc_id", "k1", "k2", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key(), F.col("text").cast("string").alias("text"))
    return rows.transform(in_batches, run, "doc_id long, k1 long, k2 long, fp long")


def variant_masks(radius: int) -> list[tuple[int, list[int]]]:
    """(bits kept, flips) for each block left out (none if the radius is even); flips of at most half the radius."""
    out = []
    bounds = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    blocks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(bounds, bounds[1:], strict=False)] if radius % 2 else [0]
    for block in blocks:
        free = [1 << b for b in range(64) if not block >> b & 1]
        out.append((~block & (1 << 64) - 1, [sum(c) for k in range(radius // 2 + 1) for c in combinations(free, k)]))
    return out


def _emit(radius: int):
    masks = [(np.uint64(keep), np.array(flips, np.uint64), np.uint64((i + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) for i, (keep, flips) in enumerate(variant_masks(radius))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column("fp").to_numpy().view(np.uint64)
            for a in range(0, len(every), 1024):
                fps = every[a : a + 1024]
                for keep, flips, salt in masks:  # the salt keeps the variants of different blocks apart
                    keys = ((fps & keep)[:, None] ^ flips ^ salt).reshape(-1)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.repeat(fps, len(flips)).view(np.int64))], ["key", "fp"])

    return run


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each of 0 to n - 1's component under the links a-b."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        while (jump := label[label]).tobytes() != label.tobytes():
            label = jump
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def _within(x: np.ndarray, y: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= radius


def bucket_roots(fps: np.ndarray, radius: int) -> np.ndarray:
    """Least index of each fingerprint's component in one bucket; only members of different components are compared."""
    n = len(fps)
    near = [np.flatnonzero(_within(fps[k:], fps[:-k], radius)) for k in range(1, min(n, _SMALL))]
    label = roots(n, np.concatenate(near), np.concatenate([x + k for k, x in enumerate(near, 1)]))
    order = np.argsort(label, kind="stable")
    sizes = np.bincount(label, minlength=n)
    largest = sizes.argmax()
    links: list[tuple[int, int]] = []
    for i in order[label[order] != largest].tolist():  # members of the largest component need no look of their own
        hit = np.flatnonzero(_within(fps, fps[i], radius) & (label != label[i]))
        links += [(i, j) for j in np.unique(label[hit], return_index=True)[0].tolist()] if len(hit) else []
    if links:
        a, b = np.array(links).T
        label = roots(n, np.concatenate([np.arange(n), a]), np.concatenate([label, b]))
    return label


def _links(radius: int):
    """Stars of linked members from rows sorted by key; a bucket may run over any number of batches."""

    def of_whole(keys: np.ndarray, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        sizes = np.diff(np.append(starts, len(keys)))
        small = np.repeat((sizes > 1) & (sizes <= _SMALL), sizes)
        f, g = fps[small], np.repeat(np.arange(len(sizes)), sizes)[small]
        a, b = [], []
        for k in range(1, min(_SMALL, int(sizes.max(initial=0)))):
            hit = np.flatnonzero((g[k:] == g[:-k]) & _within(f[k:], f[:-k], radius))
            a.append(hit)
            b.append(hit + k)
        if a:
            label = roots(len(f), np.concatenate(a), np.concatenate(b))
            linked = label != np.arange(len(f))
            yield f[linked], f[label[linked]]
        for s, n in zip(starts[sizes > _SMALL].tolist(), sizes[sizes > _SMALL].tolist(), strict=True):
            own = fps[s : s + n]
            label = bucket_roots(own, radius)
            linked = label != np.arange(n)
            yield own[linked], own[label[linked]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = fps = np.zeros(0, np.uint64)
        seen: set[tuple[int, int]] = set()
        for batch in _and_none(batches):
            if batch is not None:
                keys = np.concatenate([keys, batch.column("key").to_numpy().view(np.uint64)])
                fps = np.concatenate([fps, batch.column("fp").to_numpy().view(np.uint64)])
                if len(keys) < _ROWS:
                    continue
            cut = len(keys) if batch is None else int((keys != keys[-1]).sum())  # the last bucket may go on
            if not cut:
                continue
            pairs = {p for u, v in of_whole(keys[:cut], fps[:cut]) for p in zip(u.tolist(), v.tolist(), strict=True)} - seen
            keys, fps = keys[cut:], fps[cut:]
            if len(seen) > 1 << 18:
                seen = set()
            seen |= pairs
            if pairs:
                u, v = np.array(sorted(pairs), np.uint64).T
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(u).view(np.int64)), pa.array(np.ascontiguousarray(v).view(np.int64))], ["a", "b"])

    return run


def _and_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b: links enough to connect all fingerprints (column fp, each once) that are within radius, and no others."""
    keyed = distinct.select("fp").transform(in_batches, _emit(radius), "key long, fp long")
    return keyed.repartition("key").sortWithinPartitions("key").transform(in_batches, _links(radius), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """v, label: the least vertex of the component of every vertex of edges (a, b).

    In each round every vertex points to the least vertex next to it, pointers are followed to their ends, and the edges,
    which thereby become fewer, are put between those ends, each once. Two rounds at least halve the vertices that have
    edges, so the work is in proportion to the edges at first. Each round is written to the shared folder.
    """
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges", narrow=True)
    rounds: list[DataFrame] = []
    while not rounds or edges.limit(1).count():
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("up")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("up")))
        ends = _ends(written(both.groupBy("v").agg(F.least("v", F.min("up")).alias("up")), "up", narrow=True))
        rounds.append(ends)
        left = edges.join(ends.toDF("a", "x"), "a").join(ends.toDF("b", "y"), "b").where("x <> y")
        left = written(left.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges", narrow=True)
        drop_written(edges)
        edges = left
    labels = rounds[0].withColumnRenamed("up", "label")
    for ends in rounds[1:]:
        labels = labels.join(ends.toDF("label", "up"), "label", "left").select("v", F.coalesce("up", "label").alias("label"))
    if len(rounds) > 1:
        labels = written(labels, "labels", narrow=True)
        for done in rounds:
            drop_written(done)
    drop_written(edges)
    return labels


def _ends(ups: DataFrame) -> DataFrame:
    """v, up with each pointer followed to a vertex that points to itself; frees ups, a table from written()."""
    while True:
        further = ups.join(ups.toDF("up", "second"), "up").join(ups.toDF("second", "third"), "second")
        new = written(further.select("v", F.col("third").alias("up"), F.col("second").alias("old")), "up", narrow=True)
        drop_written(ups)
        ups = new.select("v", "up")
        ups.scratch = new.scratch
        if not new.where("up <> old").limit(1).count():
            return ups


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, k1, k2, fp, root, component_id of every row; component_id: the smallest doc_id reachable over links.

    root, the component's least fingerprint, names it even where doc_ids repeat.

    Texts without words have fingerprint 0. Repeated rows and equal fingerprints are one vertex. A null doc_id is never
    a component_id unless its component has no other. Other columns are not read.
    """
    rows = written(fingerprints(docs, words), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct", narrow=True)
    labels = components(links(distinct, radius))
    linked = distinct.join(labels.withColumnRenamed("v", "fp"), "fp")
    ids = linked.groupBy("label").agg(F.min("least").alias("component_id"))
    linked = linked.join(ids, "label").select("fp", "label", "component_id")
    component = F.when(F.col("label").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id")
    by_fp = distinct.join(linked, "fp", "left").select("fp", F.coalesce("label", "fp").alias("root"), component)
    by_fp = written(by_fp, "components", narrow=True)  # as it is read, so that a fingerprint of many rows is split
    return rows.join(by_fp, "fp").select("doc_id", "k1", "k2", "fp", "root", "component_id")


def without_near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """docs with one row of each component: that with the smallest doc_id (null last), ties by key; all its columns."""
    near = near_duplicates(docs, words, radius)
    keep = near.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "k1", "k2")).alias("m")).select("m.k1", "m.k2")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), *row_key())
    return keyed.join(keep, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).select("row.*")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id of all documents."""
    near = near_duplicates(load(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
