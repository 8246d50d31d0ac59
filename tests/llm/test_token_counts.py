import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import models

from cinderfold.llm.token_counts import SPACE, UNKNOWN_PENALTY, TrieCounts, token_counts, vocabulary

public_tokenizers = pytest.importorskip("public_tokenizers")
FILE = public_tokenizers.path("piece_bpe_32k.model")
SMALL = {"a": -1.1, "b": -2.3, "ab": -1.9, "abb": -2.05, SPACE: -0.7, SPACE + "a": -1.3, "bb": -3.7, "é": -4.1}


def by_trying_all(text, scores):
    """(score, pieces) of the best of all segmentations."""
    if not text:
        return 0.0, 0
    unknown = min(scores.values()) - UNKNOWN_PENALTY
    cuts = [(text[:n], scores[text[:n]], 1) for n in range(1, len(text) + 1) if text[:n] in scores]
    if text[0] not in scores:
        cuts.append((text[0], unknown, len(text[0].encode())))
    return max(((s + (rest := by_trying_all(text[len(p) :], scores))[0], n + rest[1]) for p, s, n in cuts), key=lambda x: x[0])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abéx汉", max_size=9), max_size=8))
def test_best_of_all_segmentations(words):
    counts = TrieCounts(SMALL, most_nodes=20)
    for w in words:
        assert counts[w] == by_trying_all(SPACE + w, SMALL)[1]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abéx汉", max_size=30))
def test_long_words_count_as_any(word):
    counts = TrieCounts(SMALL)
    assert counts._long(SPACE + word) == counts[word]


def test_a_very_long_word_leaves_no_nodes():
    counts = TrieCounts(SMALL)
    assert counts["ab" * 200_000] == 1 + 200_000 and len(counts.best) == 1 and not counts


@pytest.fixture(scope="module")
def scores():
    return vocabulary(FILE)


@pytest.fixture(scope="module")
def other(scores):
    """Another implementation of unigram segmentation, with the same pieces."""
    bytes_ = [(f"<0x{b:02X}>", -1000.0) for b in range(256)]
    least = min(scores.values())
    return models.Unigram([("<unk>", 0.0), *scores.items(), *[(p, least) for p, _ in bytes_]], 0, True)


def test_same_as_the_library(scores, other, spark):
    counts = TrieCounts(scores)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    words = sorted({w for d in docs for w in d.text.split()}) + ["汉字", "naïve", "\U0001f600\U0001f600x", "x" * 300, "<s>", "don't"]
    for w in words:
        assert counts[w] == len(other.tokenize(SPACE + w)), w


def test_shared_prefixes_are_worked_out_once(scores):
    counts = TrieCounts(scores)
    counts["prefixes"]
    nodes = len(counts.best)
    counts["prefix"]
    assert len(counts.best) == nodes == len("prefixes") + 2


SCHEMA = "doc_id long, text string, n_words string, n_tokens string"


def test_table(spark, scores):
    texts = [(1, "two words"), (1, "two words"), (2, None), (3, ""), (None, " \n\t "), (4, "  two \n\n words "), (5, "long text " * 50000)]
    docs = spark.createDataFrame([(d, t, "", "") for d, t in texts], SCHEMA)
    got = sorted(map(tuple, token_counts(docs, FILE).collect()), key=str)
    counts = TrieCounts(scores)
    assert got == sorted([(d, *(counts.count(t) if t else (0, 0))) for d, t in texts], key=str)
    assert counts.count("two words") == counts.count("  two \n\n words ")


def test_empty_table(spark):
    assert token_counts(spark.createDataFrame([], SCHEMA), FILE).count() == 0
