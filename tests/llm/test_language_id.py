import math
import random
import zlib

import numpy as np
import pytest

from cinderfold.llm.language_id import ContextTree, LanguageModel, _windows, fit, identify, predict_bytes


def crc_is_held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 0


def slow_bits(samples, order, text):
    """Code length by plain counting: longest context first, escapes down to a uniform byte."""
    counts = [{} for _ in range(order + 1)]
    data = b"".join(b" " * order + t for t in samples)
    for k in range(order + 1):
        for i in range(len(data) - k):
            row = counts[k].setdefault(data[i : i + k], {})
            row[data[i + k]] = row.get(data[i + k], 0) + 1
    text, bits = b" " * order + text, 0.0
    for i in range(order, len(text)):
        for k in range(order, -1, -1):
            row = counts[k].get(text[i - k : i])
            if row is None:
                continue
            room = sum(row.values()) + len(row)
            if text[i] in row:
                bits -= math.log2(row[text[i]] / room)
                break
            bits -= math.log2(len(row) / room)
        else:
            bits += 8
    return bits


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_code_lengths_match_plain_counting(order):
    rng = random.Random(order)
    word = lambda: "".join(rng.choice("abcé ") for _ in range(rng.randint(0, 30))).encode()
    samples = {"x": [word() for _ in range(20)], "y": [word() for _ in range(5)]}
    texts = [word() for _ in range(30)] + [b"", b"zzz\xff", b"a" * 500]
    got = LanguageModel(samples, order).bits(texts)
    for i, lang in enumerate(("x", "y")):
        assert got[:, i] == pytest.approx([slow_bits(samples[lang], order, t) for t in texts])


def test_blocks_join_up(monkeypatch):
    from cinderfold.llm import language_id

    rng = random.Random(3)
    texts = [bytes(rng.choices(b"abc ", k=n)) for n in (0, 1, 300, 2, 0, 0, 77, 1000, 0)]
    model = LanguageModel({"x": texts[:4], "y": texts[4:]})
    whole = model.bits(texts)
    for block in (1, 3, 5, 64, 301):
        monkeypatch.setattr(language_id, "_BLOCK", block)
        assert np.allclose(model.bits(texts), whole)


def test_tree_of_nothing():
    assert ContextTree([], 2).code_lengths(_windows(np.frombuffer(b"abcd", np.uint8), 3)).tolist() == [8, 8]


def test_no_language_and_no_letters():
    assert predict_bytes(LanguageModel({}), [b"abc", None]) == [("und", 0.0, None)] * 2
    got = predict_bytes(LanguageModel({"b": [b"same"], "a": [b"same"]}), [b"same", b"12 !", None, b"", b"___"])
    assert [g[0] for g in got] == ["a", "und", "und", "und", "und"] and got[0][1] == 0.5


SCHEMA = "doc_id long, text string, lang string, source string, score string, h int"


def test_table(spark):
    rng = random.Random(5)
    words = {"aa": ["lorem", "ipsum", "dolor", "sit"], "bb": ["über", "straße", "und", "nicht"], "cc": ["que", "niño", "por", "más"]}
    rows = []
    for i in range(300):
        lang = rng.choice(sorted(words))
        rows.append((i, " ".join(rng.choices(words[lang], k=rng.randint(3, 40))), lang, None, "", 0))
    rows += [(1000, None, "aa", None, "", 0), (1001, "", None, None, "", 0), (None, "straße und", None, None, "", 0), (1002, "que " * 50000, "aa", None, "", 0), (7, rows[7][1], rows[7][2], None, "", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = identify(docs, fit(docs, sample_rows=50)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(r.held_out == crc_is_held_out(r.doc_id) and 0 <= r.score <= 1 for r in got)
    assert all(by[i].lang_pred == rows[i][2] for i in range(300))
    assert (by[1000].lang_pred, by[1001].lang_pred, by[None].lang_pred, by[1002].lang_pred) == ("und", "und", "bb", "cc")


def test_never_learns_from_held_out_rows(spark):
    out = [i for i in range(50) if crc_is_held_out(i)]
    kept = [i for i in range(50) if not crc_is_held_out(i)]
    docs = spark.createDataFrame([(i, "abc", "held", None, "", 0) for i in out] + [(i, "abd", "seen", None, "", 0) for i in kept], SCHEMA)
    model = fit(docs)
    assert model.languages == ["seen"]
    assert {r.lang_pred for r in identify(docs, model).collect()} == {"seen"}


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert identify(docs, fit(docs)).count() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = identify(docs, fit(docs)).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) > 150 and np.mean([r.lang == r.lang_pred for r in got]) > 0.98
