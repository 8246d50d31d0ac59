import random
from itertools import combinations

import numpy as np
import pytest

from cinderfold.llm.jaccard import band_keys, shingle_set, similar_roots, without_similar
from tests.llm.test_pipeline import SCHEMA


def plain_set(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    out = []
    for _ in range(40):
        own = [word() for _ in range(rng.randint(20, 400))]
        out.append(own)
        for _ in range(rng.randint(0, 5)):
            copy = list(rng.choice(out[-3:]))
            for _ in range(rng.randint(0, max(1, len(copy) // 25))):
                copy[rng.randrange(len(copy))] = word()
            out.append(copy[rng.randint(0, 3) :])
    return [" ".join(w) for w in out]


def plain_roots(sets):
    label = list(range(len(sets)))
    for i, j in combinations(range(len(sets)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and label[i] != label[j]:
            lo, hi = sorted((label[i], label[j]))
            label = [lo if x == hi else x for x in label]
    return label


@pytest.mark.parametrize("seed", [1, 2])
def test_roots_are_those_of_all_pairs(seed):
    texts = corpus(seed)
    sets = [plain_set(t) for t in texts]
    assert similar_roots([shingle_set(t.encode()) for t in texts]).tolist() == plain_roots(sets)


def test_similar_pairs_share_a_band():
    texts = corpus(3)
    sets, keys = [plain_set(t) for t in texts], [band_keys(shingle_set(t.encode())) for t in texts]
    pairs = [(i, j) for i, j in combinations(range(len(texts)), 2) if jaccard(sets[i], sets[j]) >= 0.8]
    assert len(pairs) > 10 and all((keys[i] == keys[j]).any() for i, j in pairs)
    assert np.mean([(keys[i] == keys[j]).any() for i, j in combinations(range(len(texts)), 2) if jaccard(sets[i], sets[j]) < 0.1]) < 0.01


@pytest.mark.parametrize("seed", [4, 5])
def test_stage_keeps_one_of_each_component(spark, seed):
    import corpus_pipeline

    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), "", "", 1) for i, t in enumerate([*texts, texts[0], ""])], SCHEMA)
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, None).collect())
    assert got == sorted({*plain_roots([plain_set(t) for t in texts]), len(texts) + 1})


@pytest.mark.parametrize("group_shingles", [1, 300, 5000])
@pytest.mark.parametrize("seed", [6, 7])
def test_large_groups_are_dealt_out(spark, seed, group_shingles):
    texts = corpus(seed)
    rng = random.Random(seed)
    long = texts[0].split() * 3
    for _ in range(30):  # a chain of copies, of which the ends are unlike one another
        long[rng.randrange(len(long))] = rng.choice("xyz")
        texts.append(" ".join(long))
    texts += [texts[3]] * 3
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "", "", 1) for i, t in enumerate([*texts, None, ""])], SCHEMA)
    docs = docs.unionByName(docs.limit(5))
    got = sorted(r.doc_id for r in without_similar(docs, group_shingles).collect())
    assert got == sorted({*plain_roots([plain_set(t) for t in texts]), len(texts)})


def test_real_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 0")
    sets = {r.doc_id: plain_set(r.text.lower()) for r in docs.collect()}
    kept = {r.doc_id for r in without_similar(docs).collect()}
    by_shingle = {}
    for i, s in sets.items():
        for g in s:
            by_shingle.setdefault(g, []).append(i)
    pairs = {p for found in by_shingle.values() if len(found) < 60 for p in combinations(sorted(found), 2)}
    linked = {p for p in pairs if jaccard(sets[p[0]], sets[p[1]]) >= 0.8}
    assert len(linked) > 10 and not any(i in kept and j in kept for i, j in linked)
    assert {j for j in sets if j not in kept} == {j for _, j in linked}


def test_candidates_come_from_ball_hashing_too(spark, monkeypatch):
    from cinderfold.llm import jaccard

    rng = random.Random(8)
    rows = [(i, rng.randint(1, 9), [rng.getrandbits(63)]) for i in range(30)]
    rows += [(100 + i, 3, [rows[i][2][0] ^ 1 << i ^ 1 << i + 20 ^ 1 << i + 40]) for i in range(10)] + [(200, 3, rows[0][2]), (201, 0, [0]), (202, 0, [0])]
    keys = {r.sid: r.key for r in jaccard.by_fingerprint(spark.createDataFrame(rows, "sid long, n long, fps array<long>")).collect()}
    assert all(keys[i] == keys[100 + i] for i in range(10)) and keys[0] == keys[200] and len(set(keys.values())) == 30 and 201 not in keys
    called = []
    monkeypatch.setattr(jaccard, "by_fingerprint", lambda sets, f=jaccard.by_fingerprint: called.append(1) or f(sets))
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    texts = [" ".join(words), " ".join([*words[:-1], "x"]), " ".join(words[::-1])]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "", "", 1) for i, t in enumerate(texts)], SCHEMA)
    assert sorted(r.doc_id for r in without_similar(docs).collect()) == [0, 2] and called
