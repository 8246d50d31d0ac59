import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from cinderfold.llm import repeats
from cinderfold.llm.repeats import anchors, merged, op10_repeats, without_repeats


def plain(rows, length, keep):
    """Removed runs of each row by a dictionary of all strings; rows: (key order, bytes)."""
    places = defaultdict(list)
    for i, raw in enumerate(rows):
        for a in range(len(raw) - length + 1):
            places[raw[a : a + length]].append((i, a))
    out = [[] for _ in rows]
    for found in places.values():
        if len(found) > 1:
            for i, a in sorted(found)[1 if keep == "first" else 0 :]:
                out[i].append((a, a + length))
    return [merged(s, len(r)) for s, r in zip(out, rows, strict=True)]


def words(rng, n):
    return "".join(rng.choice("abcdeé  .") for _ in range(n))


def corpus(seed, n=60):
    rng = random.Random(seed)
    shared = [words(rng, rng.choice([150, 200, 260, 399, 400, 401, 500, 900])) for _ in range(8)]
    out = []
    for _ in range(n):
        parts = [words(rng, rng.randint(0, 500))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, len(s) // 3)
            parts += [s[a : rng.randint(2 * len(s) // 3, len(s))], words(rng, rng.choice([0, 1, 5, 300]))]
        out.append("".join(parts))
    return [*out, out[0], out[3], "ab" * 700, "x" * 1000, "", "x" * 399]


def test_equal_windows_have_equal_anchors(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 3000).astype(np.uint8)
    at, g = anchors(data, 200)
    shifted = np.concatenate([rng.integers(97, 100, 77).astype(np.uint8), data[500:1200], rng.integers(97, 100, 50).astype(np.uint8)])
    at2, g2 = anchors(shifted, 200)
    inner = {(a - 500 + 77, h) for a, h in zip(at.tolist(), g.tolist(), strict=True) if 700 <= a <= 900}
    assert inner and inner <= set(zip(at2.tolist(), g2.tolist(), strict=True))
    monkeypatch.setattr(repeats, "_SEGMENT", 301)
    again = anchors(data, 200)
    assert set(again[0].tolist()) == set(at.tolist())


SCHEMA = "doc_id long, text string, k1 string, spans string, kept string, n_bytes string, g int"


@pytest.mark.parametrize(("seed", "keep", "group_rows"), [(1, "none", 32768), (2, "none", 3), (3, "first", 32768), (4, "first", 2)])
def test_same_as_by_dictionary(spark, seed, keep, group_rows):
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t, "", "", "", "", 0) for i, t in enumerate(texts)], SCHEMA)
    raws = [t.encode() for t in texts]
    expected = plain(raws, 200, keep)
    got = without_repeats(docs, 200, keep, group_rows).collect()
    assert len(got) == len(texts)
    for r in got:
        runs = [(s.lo, s.hi) for s in r.spans]
        assert runs == expected[r.doc_id], r.doc_id
        ends = [0, *(x for run in runs for x in run), len(raws[r.doc_id])]
        assert bytes(r.kept) == b"".join(raws[r.doc_id][a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))


def test_odd_rows(spark):
    rng = random.Random(9)
    own, alone = words(rng, 700), words(rng, 700)
    rows = [(None, None), (1, None), (2, ""), (7, own), (7, own), (8, alone), (None, "q" + own), (9, alone[:399]), (10, words(rng, 60000) + own)]
    docs = spark.createDataFrame([(d, t, "", "", "", "", 0) for d, t in rows], SCHEMA)
    got = sorted(((r.doc_id, r.n_bytes, [(s.lo, s.hi) for s in r.spans]) for r in without_repeats(docs).collect()), key=str)
    expected = plain([(t or "").encode() for _, t in rows], 400, "none")
    assert got == sorted(((d, len((t or "").encode()), e) for (d, t), e in zip(rows, expected, strict=True)), key=str)


def test_empty_table(spark):
    assert without_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    raws = [d.text.encode() for d in docs]
    expected = plain(raws, 400, "none")
    assert sum(map(len, expected)) > 5
    for r in op10_repeats(spark, "/root/testdata/sf0.001").collect():
        i = next(i for i, d in enumerate(docs) if d.doc_id == r.doc_id)
        ends = [0, *(x for run in expected[i] for x in run), len(raws[i])]
        kept = b"".join(raws[i][a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(raws[i]), len(raws[i]) - len(kept), len(expected[i]), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("segment", [1, 7, 301, 1000])
def test_an_anchor_on_a_border_of_segments_is_one(monkeypatch, segment):
    data = np.random.default_rng(3).integers(97, 100, 3000).astype(np.uint8)
    at, g = anchors(data, 200)
    monkeypatch.setattr(repeats, "_SEGMENT", segment)
    again = anchors(data, 200)
    assert again[0].tolist() == at.tolist() and again[1].tolist() == g.tolist()


@pytest.mark.parametrize("keep", ["none", "first"])
def test_long_texts(spark, keep):
    rng = np.random.default_rng(4)
    n = 2 * repeats._SEGMENT + 5000
    long = rng.integers(97, 123, n).astype(np.uint8).tobytes().decode()
    at = repeats._SEGMENT - 300
    other = "-" * 50 + long[at : at + 700] + "-" * 50
    docs = spark.createDataFrame([(1, long, "", "", "", "", 0), (2, other, "", "", "", "", 0)], SCHEMA)
    got = {r.doc_id: ([(s.lo, s.hi) for s in r.spans], bytes(r.kept)) for r in without_repeats(docs, keep=keep).collect()}
    assert got[1] == (([(at, at + 700)], (long[:at] + long[at + 700 :]).encode()) if keep == "none" else ([], long.encode()))
    assert got[2] == ([(50, 750)], b"-" * 100)
