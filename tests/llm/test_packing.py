import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cinderfold.llm.packing import CAPACITY, cut, pack, pack_shard, pieces, sum_of_squares

public_tokenizers = pytest.importorskip("public_tokenizers")
FILE = public_tokenizers.path("byte_bpe_50k.json")


def plain(sizes, capacity):
    """Sum of squares by trying every choice."""
    gaps, out = [], []
    for item, size in enumerate(sizes):
        best = None
        for i in sorted((i for i, g in enumerate(gaps) if g >= size), key=lambda i: gaps[i]) or [None]:
            trial = gaps + [capacity - size] if i is None else [g - size if j == i else g for j, g in enumerate(gaps)]
            cost = sum(sum(g == h for g in trial) ** 2 for h in set(trial) if h)
            if best is None or cost < best[0]:
                best = (cost, i, trial)
        _, i, gaps = best
        if i is None:
            out.append([item])
        else:
            out[i].append(item)
    return sorted(gaps)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=40))
def test_places_as_the_definition_says(sizes):
    full, left = sum_of_squares(sizes, 12)
    gaps = sorted(12 - sum(sizes[i] for i in s) for s in full + left)
    assert gaps == plain(sizes, 12)
    assert sorted(i for s in full + left for i in s) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in s) == 12 for s in full)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 11), max_size=40))
def test_shards_go_from_the_longest_on(sizes):
    full, left = pack_shard(np.array(sizes, np.int64), np.arange(len(sizes)), 12)
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    assert (full, left) == tuple([[order[i] for i in s] for s in part] for part in sum_of_squares([sizes[i] for i in order], 12))


def test_nearly_as_few_as_the_tokens_need():
    sizes = np.clip(np.random.default_rng(0).exponential(400, 3000), 1, 2047).astype(int)
    full, left = pack_shard(sizes, np.arange(3000), 2048)
    assert len(full) + len(left) == -(-sizes.sum() // 2048)


def test_cut():
    assert cut(5, 4) == [0, 1, 5] and cut(8, 4) == [0, 4, 8] and cut(3, 4) == [0, 3] and cut(4, 4) == [0, 4] and cut(1, 4) == [0, 1]


def check(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for s in by.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("shard_items", [40, 1 << 16])
def test_table(spark, shard_items):
    rng = random.Random(2)
    lengths = [rng.choice([rng.randint(1, 100), rng.randint(1, 30)]) for _ in range(3000)]
    items = spark.createDataFrame([(i % 7, n, "x", None) for i, n in enumerate(lengths)], "doc_id long, length long, sequence_id string, offset string")
    rows = pack(items, 100, shard_items=shard_items).collect()
    assert sorted(r.length for r in rows) == sorted(lengths)
    least = -(-sum(lengths) // 100)
    assert check(rows, 100) <= least + 2


SCHEMA = "doc_id long, text string, length string, sequence_id string, piece string"


def test_documents(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(FILE)
    texts = {1: "a few words", 2: None, 3: "", 4: "some long text, " * 5000, 5: "a few words", None: "no id"}
    docs = spark.createDataFrame([(d, t, "", "", "") for d, t in texts.items()], SCHEMA)
    rows = pack(pieces(docs, FILE)).collect()
    check(rows, CAPACITY)
    for d, t in texts.items():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted((r for r in rows if r.doc_id == d), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert sum(r.length for r in own) == len(ids) and all(r.length == CAPACITY for r in own[1:])
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)


def test_empty_table(spark):
    assert pack(pieces(spark.createDataFrame([], SCHEMA), FILE)).count() == 0


def test_odd_lengths(spark):
    items = spark.createDataFrame([(1, None), (2, 0), (3, 101), (4, -5), (5, 100), (6, 30)], "doc_id long, length long")
    got = {r.doc_id: r for r in pack(items, 100).collect()}
    assert len(got) == 6 and all(got[i].sequence_id is None and got[i].offset is None for i in (1, 2, 3, 4))
    assert got[5].offset == got[6].offset == 0 and got[5].sequence_id != got[6].sequence_id
