import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import Row
from tokenizers import Tokenizer

import corpus_pipeline
from cinderfold.llm.language_id import fit, predict_bytes
from cinderfold.llm.mixing import mix, sizes
from cinderfold.llm.pii import key_of, replace
from tests.llm.test_mixing import water
from tests.llm.test_packing import check
from tests.llm.test_simhash import plain_fingerprint, union

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, k1 string, extra int"


def rows_of():
    rng = random.Random(6)
    words = {"aa": "lorem ipsum dolor sit amet consectetur adipiscing elit".split(), "bb": "über straße und nicht wir haben schön größe".split()}
    rows = []
    for i in range(250):
        lang = rng.choice(["aa", "bb"])
        text = " ".join(rng.choice(words[lang]) + rng.choice(["", "", "s"]) for _ in range(rng.randint(3, 200)))
        rows.append((i, text + rng.choice(["", "", f" mail me{i}@x.org"]), lang, rng.choice(["s1", "s1", "s2", None])))
    copies = [(300 + i, rows[i % 5][1].upper() if i % 2 else rows[i % 5][1], "aa", "s1") for i in range(60)]
    odd = [(400, None, "aa", "s1"), (401, "", None, None), (402, "12 34 !!", "aa", "s2"), (None, rows[9][1] + " and more", "aa", "s1"), (403, "lorem " * 900, "aa", "s2"), rows[3], rows[3]]
    rows = rows + copies + odd
    return [(d, t, lang, s, None if t is None else len(t), "", "", 1) for d, t, lang, s in rows]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.createDataFrame(rows_of(), SCHEMA)
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], None).cache())
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "personal_data", "mixture", "packing"]
    assert all(s.dtypes == stages[0].dtypes for s in stages[1:-1])


def test_language(stages):
    docs, kept = stages[0].collect(), stages[1].collect()
    model = fit(stages[0])
    got = predict_bytes(model, [None if d.text is None else d.text.encode() for d in docs])
    assert Counter(kept) == Counter(Row(**d.asDict() | {"lang": lang}) for d, (lang, _, bits) in zip(docs, got, strict=True) if lang != "und" and bits < 8)
    assert {d.lang for d in kept} == {"aa", "bb"}
    assert {d.doc_id for d in docs} - {d.doc_id for d in kept} == {400, 401, 402}


def test_near_dedup(stages):
    docs, kept = stages[1].collect(), stages[2].collect()
    label = union(np.array([plain_fingerprint(d.text) for d in docs], np.uint64), 3)
    groups = defaultdict(list)
    for d, g in zip(docs, label.tolist(), strict=True):
        groups[g].append(d)
    assert Counter(d.doc_id for d in kept) == Counter(min((d.doc_id for d in g if d.doc_id is not None), default=None) for g in groups.values())
    assert set(kept) <= set(docs) and len(kept) < len(docs) - 50


def test_personal_data(spark, stages):
    expected = Counter(replace(d.text, key_of(spark))[0] for d in stages[2].collect())
    out = stages[3].collect()
    assert Counter(d.text for d in out) == expected and all(d.n_chars == len(d.text) for d in out)
    assert not any("me" in d.text and "@x.org" in d.text for d in out)


def test_mixture(stages):
    docs, out = stages[3].collect(), stages[4].collect()
    times = Counter(out)
    assert set(out) <= set(docs)
    taken = {(r.k1, r.k2): r.times for r in mix(sizes(stages[3])).collect()}
    assert sum(times.values()) == sum(taken.values())
    size = defaultdict(int)
    for d in docs:
        size[d.source] += len(d.text.split())
    names = sorted(s for s in size if s) + [None]
    for s, target in zip(names, water([size[s] for s in names]), strict=True):
        assert abs(sum(len(d.text.split()) for d in out if d.source == s) - target) <= max(len(d.text.split()) for d in docs if d.source == s) / 2


def test_packing(stages):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs, rows = stages[4].collect(), stages[5].collect()
    check(rows, 2048)
    expected = Counter()
    for d in docs:
        ids = np.array([*tok.encode(d.text, add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        expected.update((d.doc_id, i, a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert Counter((r.doc_id, r.piece, r.start, r.ids_crc32) for r in rows) == expected


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, None)
    assert docs.count() == 0
