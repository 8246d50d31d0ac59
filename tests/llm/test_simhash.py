import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from cinderfold.llm import simhash
from cinderfold.llm.simhash import bucket_roots, components, fingerprint, links, near_duplicates, roots, variant_masks, without_near_duplicates


def plain_fingerprint(text, words=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    parts, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            parts, word = parts + [word] * bool(word), ""
        else:
            word += c
    if not parts:
        return 0
    shingles = [" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aAÄä bB.\n\t\x0b\x1c\xa0 é")), max_size=60))
def test_fingerprint(text):
    assert fingerprint(text.encode()) == plain_fingerprint(text)


def test_fingerprint_over_blocks(monkeypatch):
    monkeypatch.setattr(simhash, "_ROWS", 7)
    text = " ".join(random.Random(1).choices("abcde", k=100))
    assert fingerprint(text.encode()) == plain_fingerprint(text)


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_variants_meet(radius):
    rng = random.Random(radius)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x ^ sum(1 << b for b in rng.sample(range(64), radius))
        assert any({x & keep ^ f for f in flips} & {y & keep ^ f for f in flips} for keep, flips in variant_masks(radius))


def union(fps, radius):
    a, b = np.triu_indices(len(fps), 1)
    near = np.bitwise_count(fps[a] ^ fps[b]) <= radius
    return roots(len(fps), a[near], b[near])


def cluster(seed, n, walk=True):
    """Fingerprints at a few bits from one another, in chains."""
    rng = random.Random(seed)
    out = [rng.getrandbits(64)]
    while len(out) < n:
        base = out[-1] if walk and rng.random() < 0.7 else rng.choice(out)
        out.append(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
    return out


@pytest.mark.parametrize("n", [2, 30, 400])
def test_bucket_roots(n):
    fps = np.unique(np.array(cluster(n, n), np.uint64))
    assert (bucket_roots(fps, 3) == union(fps, 3)).all()


def test_links_connect_exactly(spark, monkeypatch):
    fps = np.unique(np.array([f for s in range(25) for f in cluster(s, 20)] + cluster(99, 900, walk=False), np.uint64))
    distinct = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    got = {r.v: r.label for r in components(links(distinct)).collect()}
    signed = fps.view(np.int64).tolist()
    expected = union(fps, 3)
    mine = [got.get(f, f) for f in signed]
    assert len({(a, b) for a, b in zip(mine, expected.tolist(), strict=True)}) == len(set(mine)) == len(set(expected.tolist()))


def test_long_chain(spark):
    order = list(range(300))
    random.Random(4).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:], strict=False)) + [(1000, 1001)], "a long, b long")
    got = {r.v: r.label for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(300), 0), 1000: 1000, 1001: 1000}


def test_components_of_any_graph(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)]
    pairs += [(500 + i, 500 + i + 1) for i in range(60)] + [(700 + i, 799) for i in range(60)] + [(900, 900)]  # a sorted path, a star with its least last, a loop
    got = {r.v: r.label for r in components(spark.createDataFrame(pairs * 2, "a long, b long")).collect()}
    label = roots(1000, *np.array(pairs).T)
    assert got == {v: int(label[v]) for v in {x for p in pairs for x in p}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def rows_of_joins(spark, run):
    """Output rows of all joins that run() makes Spark execute."""
    store = spark._jsparkSession.sharedState().statusStore()
    each = lambda x: [x.apply(i) for i in range(x.size())]
    before = {e.executionId() for e in each(store.executionsList())}
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    out = 0
    for i in {e.executionId() for e in each(store.executionsList())} - before:
        values = store.executionMetrics(i)
        for node in each(store.planGraph(i).allNodes()):
            rows = [values.get(m.accumulatorId()) for m in each(node.metrics()) if "Join" in node.name() and m.name() == "number of output rows"]
            out += sum(int(v.get().replace(",", "")) for v in rows if v.isDefined())
    return out


def test_edges_of_a_dense_group_are_joined_once(spark):
    """Edges are joined once at either end, not in every round."""
    rng = random.Random(7)
    near = sorted({tuple(sorted(rng.sample(range(150), 2))) for _ in range(6000)})
    edges = spark.createDataFrame(near, "a long, b long")
    assert rows_of_joins(spark, lambda: components(edges).count()) < 2 * len(near) + 20 * 150


SCHEMA = "doc_id long, text string, lang string, fp string, k1 string, root string, row int"


def test_table(spark):
    words = [f"w{i}" for i in range(300)]
    random.Random(8).shuffle(words)
    base = " ".join(words)
    rows = [(10, base), (4, base), (7, base + " tail"), (7, "another text of its own here"), (3, "copy me please now"), (3, "copy me please now"), (None, "COPY me please\nnow"), (20, None), (21, ""), (22, " \n"), (None, "alone without id at all"), (30, "one"), (31, "One"), (32, "one two")]
    docs = spark.createDataFrame([(d, t, "", "", "", "", 0) for d, t in rows], SCHEMA)
    got = near_duplicates(docs).collect()
    fps = np.array([plain_fingerprint(t or "") for _, t in rows], np.uint64)
    label = union(fps, 3)
    expected = [(d, int(f), min([rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None], default=None)) for i, ((d, _), f) in enumerate(zip(rows, fps.view(np.int64), strict=True))]
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.fp, r.component_id) for r in got), key=key) == sorted(expected, key=key)
    kept = without_near_duplicates(docs)
    assert kept.columns == docs.columns
    out = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(out) == len(set(label.tolist()))
    assert (4, base) in out and (3, "copy me please now") in out and (7, "another text of its own here") in out and (None, "alone without id at all") in out and (20, None) in out


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(docs).count() == 0 and without_near_duplicates(docs).count() == 0
