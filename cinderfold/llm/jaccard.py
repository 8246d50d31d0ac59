"""Near-duplicates by the Jaccard similarity of texts' sets of five-word shingles.

Candidates are texts whose SimHash fingerprints are linked by ball hashing, and, as similar texts often differ in more bits,
texts that share a band of MinHashes; BANDS bands of ROWS leave out a pair of similarity 0.8 with a probability of 5e-6,
one of 0.9 with 7e-14. Whole sets of texts that candidates connect are compared: a link is a pair of similarity SIMILARITY or
more, never a shared band or close fingerprints, and no pair of different components goes uncompared.

A group of at most GROUP_SHINGLES shingles is compared in one task. A larger one is dealt over many: all its sets are held
against one, its centre, as they stream by; those that are not like the centre are then held, in blocks, against the whole
group, which is dealt into blocks as well. A group of copies thus takes one pass, and the work of any group is its size
times the number of its sets that are unlike its centre.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderfold.llm.common import in_batches, row_key, written
from cinderfold.llm.simhash import components, fingerprint, links, shingle_hashes

SHINGLE = 5
SIMILARITY = (4, 5)  # as a fraction, so that comparisons are of whole numbers
BANDS = 40
ROWS = 6
#: A task holds the sets of at most about so many shingles, or one text's.
GROUP_SHINGLES = 1 << 18
_CHUNK = 1024
_RNG = np.random.default_rng(42)
_XOR, _ODD, _MIX = (_RNG.integers(0, 2**64, n, np.uint64) | np.uint64(1) for n in (BANDS * ROWS, BANDS * ROWS, ROWS))
_SALT = _RNG.integers(0, 2**64, BANDS, np.uint64)


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted hashes of the text's shingles, each once."""
    return np.unique(shingle_hashes(text, SHINGLE))


def band_keys(own: np.ndarray) -> np.ndarray:
    """A key for each band of the MinHashes of a set; none of an empty set."""
    if not len(own):
        return own
    least = np.full(BANDS * ROWS, np.uint64(2**64 - 1))
    with np.errstate(over="ignore"):
        for a in range(0, len(own), _CHUNK):
            np.minimum(least, ((own[a : a + _CHUNK, None] ^ _XOR) * _ODD).min(0), out=least)
        return ((least.reshape(BANDS, ROWS) >> np.uint64(7)) * _MIX).sum(1, dtype=np.uint64) ^ _SALT


def similar_roots(sets: list[np.ndarray]) -> np.ndarray:
    """Least index of each set's component under links of similarity SIMILARITY or more; sets are not empty.

    Members of a component search the sets that are in none yet, so that a large group of similar sets is found in few
    searches.
    """
    up, down = SIMILARITY
    words, codes = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    label = np.arange(len(sets))
    left, starts = np.arange(len(sets)), np.cumsum(sizes) - sizes
    own = [codes[a : a + n] for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
    mark = np.zeros(len(words), bool)
    while len(left):
        root, queue = left[0], [left[0]]
        keep = np.arange(len(left)) > 0
        for i in queue:
            if not keep.all():
                codes, left = codes[np.repeat(keep, sizes[left])], left[keep]
                starts = np.cumsum(sizes[left]) - sizes[left]
                keep = np.ones(len(left), bool)
            if not len(left):
                break
            mark[own[i]] = True
            both = np.add.reduceat(mark[codes], starts, dtype=np.int64)
            mark[own[i]] = False
            hit = down * both >= up * (sizes[i] + sizes[left] - both)
            label[left[hit]] = root
            queue += left[hit].tolist()
            keep = ~hit
    return label


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        ids, keys, sizes, fps = [], [], [], []
        for t in batch.column("text"):
            raw = t.as_buffer().to_pybytes() if t.is_valid else b""
            own = shingle_set(raw)
            ids.append(xxhash.xxh3_64_intdigest(own.tobytes()))
            keys.append(band_keys(own).view(np.int64))
            sizes.append(len(own))
            fps.append(fingerprint(raw))
        yield pa.RecordBatch.from_arrays([batch.column("no"), batch.column("k1"), batch.column("k2"), pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64))], ["no", "k1", "k2", "sid", "keys", "n", "fp"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sid, root of the linked sets among the texts of each group; rows are sorted by group, which may run over batches."""
    group, held = None, {}

    def of_group() -> pa.RecordBatch:
        ids = sorted(held)
        label = similar_roots([held[i] for i in ids])
        linked = [(i, ids[r]) for i, r in zip(ids, label.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*linked, strict=True)], ["sid", "root"])

    for batch in batches:
        for g, sid, text in zip(batch.column("label").to_pylist(), batch.column("sid").to_pylist(), batch.column("text"), strict=True):
            if g != group and held:
                yield of_group()
                held = {}
            group = g
            if sid not in held:
                held[sid] = shingle_set(text.as_buffer().to_pybytes())
    if held:
        yield of_group()


def _similar(both: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | bool:
    """Whether sets of a and b shingles, of which they share both, are of similarity SIMILARITY or more."""
    return SIMILARITY[1] * both >= SIMILARITY[0] * (a + b - both)


def _with_centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sid, label, linked: whether a set is like its group's centre, which comes first of its rows (label, salt)."""
    group, centre = None, np.zeros(0, np.uint64)
    for batch in batches:
        ids, labels, linked = [], [], []
        for label, salt, role, sid, text in zip(*(batch.column(c).to_pylist() for c in ("label", "salt", "role", "sid")), batch.column("text"), strict=True):
            own = shingle_set(text.as_buffer().to_pybytes())
            if role == 0:
                group, centre = (label, salt), own
            else:
                assert group == (label, salt)
                ids.append(sid)
                labels.append(label)
                linked.append(bool(_similar(len(np.intersect1d(own, centre, True)), len(own), len(centre))))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.int64()), pa.array(linked, pa.bool_())], ["sid", "label", "linked"])


class _Block:
    """Sets that others are held against, with the links found that connect what was not connected before."""

    def __init__(self, ids: list[int], sets: list[np.ndarray]):
        self.ids, self.sizes = ids, np.array([len(x) for x in sets])
        every, own = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(every, kind="stable")
        self.words, starts = np.unique(every[order], return_index=True)
        self.owners, self.bounds = own[order], np.append(starts, len(every))
        self.up: dict[int, int] = {}

    def _root(self, x: int) -> int:
        while (up := self.up.get(x, x)) != x:
            self.up[x] = up = self.up.get(up, up)
            x = up
        return x

    def links(self, sid: int, own: np.ndarray, node: int) -> list[tuple[int, int]]:
        """New links of a set to the block's; node stands for it, one for all sets that are connected already."""
        at = np.minimum(np.searchsorted(self.words, own), len(self.words) - 1)
        at = at[self.words[at] == own]
        sizes = self.bounds[at + 1] - self.bounds[at]
        ahead = np.cumsum(sizes) - sizes
        both = np.bincount(self.owners[np.repeat(self.bounds[at] - ahead, sizes) + np.arange(sizes.sum())], minlength=len(self.ids))
        out = []
        for i in np.flatnonzero(_similar(both, self.sizes, len(own))).tolist():
            a, b = self._root(node), self._root(self.ids[i])
            if a != b:
                self.up[b] = a
                out.append((node, self.ids[i]))
        return out


def _against_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b: links of a group's sets (role 1) to those of a block of it (role 0), which come first of their rows."""
    group, ids, sets, block = None, [], [], None
    for batch in batches:
        found: list[tuple[int, int]] = []
        for label, salt, part, role, sid, node, text in zip(*(batch.column(c).to_pylist() for c in ("label", "salt", "part", "role", "sid", "node")), batch.column("text"), strict=True):
            if group != (label, salt, part):
                group, ids, sets, block = (label, salt, part), [], [], None
            own = shingle_set(text.as_buffer().to_pybytes())
            if role == 0:
                ids.append(sid)
                sets.append(own)
            elif ids:
                block = block or _Block(ids, sets)
                found += block.links(sid, own, node)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else ([], []))], ["a", "b"])


def _of_large_groups(whole: DataFrame, group_shingles: int) -> DataFrame:
    """sid, root of the sets of groups of `parts` above 1 that are linked to any other; rows: label, sid, centre, n, parts, text."""
    big = written(whole.withColumn("salt", F.pmod(F.xxhash64("sid"), "parts")), "groups")
    centres = big.where("sid = centre").select("label", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("salt"), F.lit(0).alias("role"), "sid", "text")
    star = centres.unionByName(big.select("label", "salt", F.lit(1).alias("role"), "sid", "text"))
    star = star.repartition("label", "salt").sortWithinPartitions("label", "salt", "role", "sid")
    linked = written(star.transform(in_batches, _with_centre, "sid long, label long, linked boolean"), "star", narrow=True)
    known = big.join(linked.select("sid", "linked"), "sid")
    apart = known.where("not linked")
    blocks = apart.groupBy("label").agg(F.ceil(F.sum("n") / group_shingles).alias("blocks"))
    edges = linked.where("linked").select(F.col("label").alias("l"), F.col("sid").alias("b")).join(big.where("sid = centre").select(F.col("label").alias("l"), F.col("sid").alias("a")), "l").select("a", "b")
    if linked.where("not linked").limit(1).count():
        node = F.when(F.col("linked"), F.col("centre")).otherwise(F.col("sid"))
        parts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("part")
        every = known.join(blocks, "label").select("label", "salt", parts, F.lit(1).alias("role"), "sid", node.alias("node"), "text")
        salts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("salt")
        held = apart.drop("salt").join(blocks, "label").select("label", salts, F.pmod(F.xxhash64("sid", F.lit(1)), "blocks").alias("part"), F.lit(0).alias("role"), "sid", F.col("sid").alias("node"), "text")
        dealt = held.unionByName(every).repartition("label", "salt", "part").sortWithinPartitions("label", "salt", "part", "role", "sid")
        edges = edges.unionByName(dealt.transform(in_batches, _against_block, "a long, b long"))
    return components(edges.where("a <> b").distinct()).select(F.col("v").alias("sid"), F.col("label").alias("root"))


def by_fingerprint(sets: DataFrame) -> DataFrame:
    """sid, key: a key for each component of fingerprints (column fps) that ball hashing links; none of empty sets."""
    fps = written(sets.where("n > 0").select("sid", F.explode("fps").alias("fp")), "fps", narrow=True)
    labels = components(links(fps.select("fp").distinct())).withColumnRenamed("v", "fp")
    return fps.join(labels, "fp", "left").select("sid", F.xxhash64(F.coalesce("label", "fp"), F.lit("fp")).alias("key"))


def similar_sets(docs: DataFrame, group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """sid, root, no, k1, k2: each distinct set of shingles, its component, and the row with it of least doc_id (null last), then key."""
    texts = docs.select(F.col("doc_id").isNull().alias("no"), *row_key(), F.col("text").cast("string").alias("text"))
    signed = texts.transform(in_batches, _signed, "no boolean, k1 long, k2 long, sid long, keys array<long>, n long, fp long")
    sets = written(signed.groupBy("sid").agg(F.min(F.struct("no", "k1", "k2")).alias("m"), F.first("keys").alias("keys"), F.first("n").alias("n"), F.collect_set("fp").alias("fps")).select("sid", "m.*", "keys", "n", "fps"), "sets", narrow=True)
    keyed = sets.select("sid", F.explode("keys").alias("key")).unionByName(by_fingerprint(sets))
    stars = keyed.groupBy("key").agg(F.min("sid").alias("a"), F.max("sid").alias("z")).where("a <> z").select("key", "a")
    stars = written(stars, "stars", narrow=True).join(keyed, "key").select("a", F.col("sid").alias("b")).where("a <> b").distinct()
    groups = components(stars).withColumnRenamed("v", "sid")
    members = sets.join(groups, "sid").select("k1", "k2", "sid", "label", "n")
    loads = members.groupBy("label").agg(F.ceil(F.sum("n") / group_shingles).alias("parts"), F.min("sid").alias("centre"))
    loads = written(loads, "loads", narrow=True)
    whole = texts.select("k1", "k2", "text").join(members.join(loads, "label"), ["k1", "k2"]).select("label", "sid", "centre", "n", "parts", "text")
    some_large = loads.where("parts > 1").limit(1).count() > 0
    if some_large:
        whole = written(whole, "members")
    small = whole.where("parts = 1").select("label", "sid", "text")
    roots = small.repartition("label").sortWithinPartitions("label", "sid").transform(in_batches, _verified, "sid long, root long")
    if some_large:
        roots = roots.unionByName(_of_large_groups(whole.where("parts > 1").dropDuplicates(["sid"]), group_shingles))
    return sets.drop("keys", "n", "fps").join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))


def without_similar(docs: DataFrame, group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """docs with one row of each component: that with the smallest doc_id (null last), ties by key; all its columns.

    Null texts are empty; all texts without words are one component, as are texts of the same shingles. group_shingles
    bounds what one task holds and changes no result.
    """
    keep = similar_sets(docs, group_shingles).groupBy("root").agg(F.min(F.struct("no", "k1", "k2")).alias("m")).select("m.k1", "m.k2")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), *row_key())
    return keyed.join(keep, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).select("row.*")
