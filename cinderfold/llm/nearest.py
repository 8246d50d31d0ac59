"""Approximate nearest neighbours by largest inner product over a hierarchical k-means tree.

The tree is fitted on a bounded sample, down to leaves that hold about LEAF_ROWS of all vectors each, so it grows with the
table until a leaf has only LEAST_SAMPLE rows of the sample (some 4096 leaves, then each grows); every vector is dealt to a
leaf. A query goes best bin first: a priority queue over the tree's nodes gives leaves in the order of their centres' inner
product with it, and so many leaves are visited as a calibration against exact answers finds to be enough for the recall
asked for. Leaves are searched where they lie, in blocks of bounded size, by exact products in double precision.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinderfold.llm.common import in_batches, load, written

NEIGHBOURS = 20
QUERY_EVERY = 20
RECALL = 0.95
#: The tree is fitted on at most so many vectors, and on fewer if these hold more than SAMPLE_VALUES numbers.
SAMPLE_ROWS = 1 << 16
SAMPLE_VALUES = 1 << 22
#: Recall is calibrated on at most so many queries, each against all vectors.
CALIBRATION_QUERIES = 256
BRANCHES = 8
LEAF_ROWS = 1024
LEAST_SAMPLE = 16
BLOCK_ROWS = 4096
_ROUNDS = 8
_CHUNK = 256


@dataclass
class Tree:
    """centres of all nodes; children of each, empty for leaves; leaf number of each leaf, -1 for others."""

    centres: np.ndarray
    children: list[list[int]]
    leaf: list[int]

    @property
    def n_leaves(self) -> int:
        return max(self.leaf) + 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row, by the nearest child at every node."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                out[rows] = self.leaf[node]
            elif len(rows):
                own = _nearest(x[rows], self.centres[self.children[node]])
                todo += [(c, rows[own == i]) for i, c in enumerate(self.children[node])]
        return out

    def best_first(self, query: np.ndarray, visits: int) -> list[int]:
        """The first leaves that the priority queue gives, nearest centre first."""
        products = self.centres @ query
        queue, out = [(0.0, 0)], []
        while queue and len(out) < visits:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                out.append(self.leaf[node])
            for c in self.children[node]:
                heapq.heappush(queue, (-products[c], c))
        return out


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)


def fit_tree(sample: np.ndarray, branches: int = BRANCHES, leaf_rows: int = LEAF_ROWS) -> Tree:
    """k-means of each node's rows into `branches`, down to nodes of at most leaf_rows rows or of equal rows."""
    rng = np.random.default_rng(0)
    width = sample.shape[1] if sample.ndim == 2 else 0
    tree = Tree(np.zeros((0, width)), [], [])
    centres: list[np.ndarray] = []

    def grow(rows: np.ndarray) -> int:
        node = len(centres)
        centres.append(sample[rows].mean(0) if len(rows) else np.zeros(width))
        tree.children.append([])
        tree.leaf.append(-1)
        own = None
        if len(rows) > leaf_rows:
            x = sample[rows]
            seeds = np.unique(x[rng.choice(len(x), min(len(x), 8 * branches), replace=False)], axis=0)
            at = seeds[rng.choice(len(seeds), min(branches, len(seeds)), replace=False)]
            for _ in range(_ROUNDS):
                own = _nearest(x, at)
                at = np.stack([x[own == i].mean(0) if (own == i).any() else at[i] for i in range(len(at))])
            own = _nearest(x, at)
        if own is None or len(np.unique(own)) < 2:
            tree.leaf[node] = sum(n >= 0 for n in tree.leaf)
        else:
            for i in np.unique(own):
                tree.children[node].append(grow(rows[own == i]))
        return node

    grow(np.arange(len(sample)))
    tree.centres = np.stack(centres)
    return tree


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, x of the rows that take part, with a1 and a2, which only equal vectors share.

    Vectors that are null, empty, zero, or hold null or non-finite components, null vec_ids, and vectors of another width
    than the commonest (the least of these, if tied) take no part.
    """
    x = F.col("x")
    fine = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("x")).where(
        F.col("vec_id").isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    )
    widths = fine.groupBy(F.size("x").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    return fine.where(F.size("x") == (widths[0].w if widths else 0)).withColumns({"a1": F.xxhash64("x"), "a2": F.hash("x")})


def _top(products: np.ndarray, x: np.ndarray, q: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and exact scores of the k best of one query, ties to the smaller id; products: about x @ q."""
    if len(products) > k:
        least = np.partition(products, len(products) - k)[len(products) - k]
        some = np.flatnonzero(products >= least - 1e-9 * (1 + abs(least)))
    else:
        some = np.arange(len(products))
    scores = (x[some] * q).sum(1)  # row by row, so equal whatever the block
    order = np.lexsort((ids[some], -scores))[:k]
    return ids[some][order], scores[order]


_BEST = pa.schema([("q", pa.int64()), ("leaf", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _best_rows(found: list[tuple]) -> pa.RecordBatch:
    q, leaf, ids, scores = zip(*found, strict=True) if found else ((), (), (), ())
    sizes = [len(i) for i in ids]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(np.array(q, np.int64), sizes)), pa.array(np.concatenate([np.broadcast_to(a, n) for a, n in zip(leaf, sizes, strict=True)] or [np.zeros(0)]).astype(np.int64)), pa.array(np.concatenate(ids or [np.zeros(0)]).astype(np.int64)), pa.array(np.concatenate(scores or [np.zeros(0)]))],
        schema=_BEST,
    )


def _k_best(df: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def exact(candidates: DataFrame, queries: np.ndarray, k: int) -> DataFrame:
    """q (row of queries), leaf, vec_id, score, rank: the k best of all candidates (vec_id, x, leaf) for a few queries."""
    frozen = candidates.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ids, leaf = _matrix(batch.column("x")), batch.column("vec_id").to_numpy(), batch.column("leaf").to_numpy()
            if len(ids):
                where = dict(zip(ids.tolist(), leaf.tolist(), strict=True))
                products = frozen.value @ x.T
                found = []
                for i, p in enumerate(products):
                    best, scores = _top(p, x, frozen.value[i], ids, k)
                    found.append((i, np.array([where[b] for b in best.tolist()]), best, scores))
                yield _best_rows(found)

    return _k_best(candidates.select("vec_id", "x", "leaf").transform(in_batches, run, "q long, leaf long, vec_id long, score double"), k)


def calibrate(tree: Tree, candidates: DataFrame, queries: np.ndarray, k: int, recall: float) -> tuple[int, float]:
    """Least number of leaf visits that reaches the recall on these queries, and the recall it reaches."""
    truth = exact(candidates, queries, k).select("q", "leaf").collect()
    ranks = {q: {leaf: i for i, leaf in enumerate(tree.best_first(queries[q], tree.n_leaves))} for q in {r.q for r in truth}}
    needed = np.sort([ranks[r.q][r.leaf] + 1 for r in truth])
    if not len(needed):
        return tree.n_leaves, 1.0
    visits = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])
    return visits, float((needed <= visits).mean())


def _search(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    if not left.num_rows or not right.num_rows:
        return pa.Table.from_batches([], _BEST)
    q, x = _matrix(left.column("x")), _matrix(right.column("x"))
    numbers, ids = left.column("q").to_numpy(), right.column("vec_id").to_numpy()
    found = []
    for a in range(0, len(q), _CHUNK):
        for i, p in enumerate(q[a : a + _CHUNK] @ x.T, a):
            best, scores = _top(p, x, q[i], ids, k)
            found.append((numbers[i], np.zeros(len(best)), best, scores))
    return pa.Table.from_batches([_best_rows(found)])


def nearest(vectors: DataFrame, k: int = NEIGHBOURS, query_every: int = QUERY_EVERY, recall: float = RECALL, leaf_rows: int = LEAF_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for every row whose vec_id is divisible by query_every, its k nearest other rows.

    leaves, visited and calibrated_recall say how many leaves there are, how many each query visits, and what share of the
    exact neighbours of the calibration's queries lies in them.

    Of equal vectors only the k + 1 with the least ids can be among anyone's k nearest, so no more are indexed, and equal
    queries are searched once. Repeated vec_ids count as rows of their own. Candidates of a leaf lie in blocks of
    block_rows; queries that meet there in as many; what a task holds doesn't grow with the table. The tree, its visits
    and counts by leaf are all that reaches the driver. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    same = Window.partitionBy("a1", "a2").orderBy("vec_id")
    kept = written(rows.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1).drop("n"), "vectors")
    asked = rows.where(F.col("vec_id") % query_every == 0)
    asked_once = written(asked.groupBy("a1", "a2").agg(F.min("vec_id").alias("q"), F.min_by("x", "vec_id").alias("x")), "queries")
    first = kept.limit(1).collect()
    width = len(first[0].x) if first else 1
    n_rows = kept.count()
    sample = _least(kept, n_rows, max(1, min(SAMPLE_ROWS, SAMPLE_VALUES // width)), "vec_id")
    share = sample.num_rows / max(n_rows, 1)
    tree = fit_tree(_matrix(sample.column("x")) if sample.num_rows else np.zeros((0, width)), leaf_rows=leaf_rows if share == 1 else max(LEAST_SAMPLE, round(leaf_rows * share)))
    frozen = spark.sparkContext.broadcast(tree)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = frozen.value.assign(_matrix(batch.column("x"))) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), pa.array(leaf)], ["vec_id", "x", "leaf"])

    kind = dict(kept.dtypes)["x"]
    candidates = written(kept.select("vec_id", "x").transform(in_batches, deal, f"vec_id long, x {kind}, leaf long"), "leaves")
    trial = _least(asked_once, asked_once.count(), CALIBRATION_QUERIES, "q")
    visits, reached = calibrate(tree, candidates, _matrix(trial.column("x")), k + 1, recall) if trial.num_rows else (1, 1.0)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x")) if batch.num_rows else []
            leaves = [frozen.value.best_first(q, visits) for q in x]
            yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("x"), pa.array(leaves, pa.list_(pa.int64()))], ["q", "x", "leaves"])

    routed = written(asked_once.select("q", "x").transform(in_batches, route, f"q long, x {kind}, leaves array<bigint>"), "routed")
    routed = routed.select("q", "x", F.explode("leaves").alias("leaf"))
    parts = lambda df: {r.leaf: -(-r["count"] // block_rows) for r in df.groupBy("leaf").count().collect()}
    of_rows, of_queries = parts(candidates), parts(routed.select("leaf"))
    grid = lambda df, own, other, ident, mine, theirs: _blocks(df, own, ident, mine).withColumn(theirs, F.explode(F.sequence(F.lit(0), _lookup(other) - 1)))
    left = grid(routed, of_queries, of_rows, "q", "qb", "cb")
    right = grid(candidates, of_rows, of_queries, "vec_id", "cb", "qb")
    keys = ["leaf", "qb", "cb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda a, b: _search(a, b, k + 1), "q long, leaf long, vec_id long, score double")
    lists = _k_best(found, k + 1).groupBy("q").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("best"))
    known = asked_once.select("a1", "a2", "q").join(lists, "q")
    others = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    return (
        asked.select(F.col("vec_id").alias("query_id"), "a1", "a2")
        .join(known, ["a1", "a2"])
        .select("query_id", F.posexplode(others).alias("i", "b"))
        .select("query_id", (F.col("i") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"), F.lit(tree.n_leaves).alias("leaves"), F.lit(visits).alias("visited"), F.lit(reached).alias("calibrated_recall"))
    )


def _least(vectors: DataFrame, n: int, rows: int, ident: str) -> pa.Table:
    """x of the `rows` vectors with the least a1; only about twice as many of the n ever leave their tasks."""
    for share in (min(1.0, 2 * rows / max(n, 1)), 1.0):
        bound = int(share * 2**64) - 2**63 - 1
        found = vectors.where(F.col("a1") <= bound).orderBy("a1", ident).limit(rows).select("x").toArrow()
        if share == 1.0 or found.num_rows == rows:
            break
    return found


def _lookup(parts: dict[int, int]) -> F.Column:
    """Number of blocks of the row's leaf; one entry a leaf that needs more than one."""
    many = {leaf: n for leaf, n in parts.items() if n > 1}
    if not many:
        return F.lit(1)
    return F.coalesce(F.create_map(*[F.lit(v) for kv in many.items() for v in kv])[F.col("leaf").cast("int")], F.lit(1))


def _blocks(df: DataFrame, parts: dict[int, int], ident: str, name: str) -> DataFrame:
    return df.withColumn(name, F.pmod(F.xxhash64(F.col(ident), F.lit(7)), _lookup(parts)).cast("int"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of all embeddings to every one whose vec_id is divisible by 20."""
    return nearest(load(spark, sf_dir, "embeddings"))
