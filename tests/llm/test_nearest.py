import numpy as np
import pytest

import cinderfold.llm.nearest as nearest_module
from cinderfold.llm.nearest import _matrix, calibrate, fit_tree, nearest, usable


def exact(ids, x, k, every):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = (x * x[i]).sum(1)
        rest = np.array([j for j in range(len(ids)) if j != i])
        order = rest[np.lexsort((ids[rest], -s[rest]))[:k]]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def clustered(n, seed=0, d=8):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(20, d))[rng.integers(0, 20, n)] * 2 + rng.normal(size=(n, d))).astype(np.float32)


def table(spark, ids, x):
    rows = [(int(i), None if v is None else [None if c is None else float(c) for c in v], 0, "") for i, v in zip(ids, x, strict=True)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, x string")


def test_tree_deals_all_and_queue_gives_every_leaf_once():
    x = clustered(1000).astype(float)
    tree = fit_tree(x, leaf_rows=30)
    leaf = tree.assign(x)
    assert tree.n_leaves > 20 and set(leaf.tolist()) <= set(range(tree.n_leaves))
    assert sorted(tree.best_first(x[0], tree.n_leaves)) == list(range(tree.n_leaves))
    assert fit_tree(np.ones((500, 3)), leaf_rows=10).n_leaves == 1


def test_all_leaves_give_exact_results(spark):
    ids, x = np.arange(600), clustered(600)
    x[100:160] = x[40]  # a third of the rows share few vectors
    x[200:300] = x[7]
    got = {}
    for r in nearest(table(spark, ids, x), k=5, recall=1.0, leaf_rows=40, block_rows=16).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    expected = exact(ids, x.astype(float), 5, 20)
    assert set(got) == set(expected)
    for q, rows in got.items():  # every query is a calibration query here, so recall 1.0 makes all of them exact
        rows.sort()
        assert [r[0] for r in rows] == [1, 2, 3, 4, 5]
        assert [(v, s) for _, v, s in rows] == expected[q]


def test_recall(spark):
    ids, x = np.arange(4000), clustered(4000, d=16)
    got = {}
    for r in nearest(table(spark, ids, x), leaf_rows=50).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    expected = exact(ids, x.astype(float), 20, 20)
    recall = np.mean([len(got[q] & {v for v, _ in e}) / 20 for q, e in expected.items()])
    assert recall >= 0.9


def test_recall_on_embeddings(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found = nearest(rows, leaf_rows=32).collect()
    ids, x = zip(*((r.vec_id, r.embedding) for r in rows.collect()), strict=True)
    expected = exact(np.array(ids), np.array(x, float), 20, 20)
    got = {}
    for r in found:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    recall = np.mean([len(got[q] & {v for v, _ in e}) / 20 for q, e in expected.items()])
    assert recall >= 0.9 and {r.calibrated_recall >= 0.95 and r.leaves > 30 and r.visited <= r.leaves for r in found} == {True}


def test_leaves_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(nearest_module, "SAMPLE_ROWS", 800)
    leaves = [nearest(table(spark, np.arange(n), clustered(n)), leaf_rows=50).first().leaves for n in (1600, 4800)]
    assert 20 < leaves[0] < leaves[1] / 1.5


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    x = [[1, 0], None, [0, 0], [nan, 1], [inf, 1], [None, 1], [], [1, 2, 3], [0, 1], [1, 1], [1, 1], [-1, 0], [0, 0]]
    ids = [0, 20, 40, 60, 80, 100, 120, 140, 160, 5, 6, -20, 41]
    got = [tuple(r)[:4] for r in nearest(table(spark, ids, x)).collect()]
    by = {}
    for q, rank, v, s in sorted(got):
        by.setdefault(q, []).append((rank, v, s))
    assert by == {0: [(1, 5, 1.0), (2, 6, 1.0), (3, 160, 0.0), (4, -20, -1.0)], 160: [(1, 5, 1.0), (2, 6, 1.0), (3, -20, 0.0), (4, 0, 0.0)], -20: [(1, 160, 0.0), (2, 0, -1.0), (3, 5, -1.0), (4, 6, -1.0)]}


def test_repeated_rows(spark):
    got = nearest(table(spark, [0, 0, 1], [[1, 0], [1, 0], [0, 1]])).collect()
    assert {r.query_id for r in got} == {0}


@pytest.mark.parametrize("rows", [[], [(0, [1.0])], [(3, [1.0]), (4, [2.0])]])
def test_no_pairs(spark, rows):
    assert nearest(table(spark, [r[0] for r in rows], [r[1] for r in rows])).count() == 0


def test_calibration_counts_what_it_visits(spark):
    x = clustered(500).astype(float)
    tree = fit_tree(x, leaf_rows=20)
    df = spark.createDataFrame([(i, v.tolist(), int(leaf)) for i, (v, leaf) in enumerate(zip(x, tree.assign(x), strict=True))], "vec_id long, x array<double>, leaf long")
    visits, reached = calibrate(tree, df, x[:20], 5, 0.9)
    assert reached >= 0.9 and 1 <= visits <= tree.n_leaves
    assert calibrate(tree, df, x[:20], 5, 1.0)[1] == 1.0
    assert _matrix(usable(df.withColumnRenamed("x", "embedding")).select("x").toArrow().column("x")).shape == (500, 8)
