import random
import re

import pytest
from pyspark.sql import functions as F

from cinderfold.operators import corpus, evaluation, gate, replay, tokens
from cinderfold.functions import model, text

SF = "/root/testdata/sf0.001"


def plain_gate(rows):
    """The rules one by one, with the shingles of all accepted texts."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        t = t or ""
        n = len(t.split())
        strange = [x for x in re.findall(r"\bCVE-\d{4}-\d{4,}\b", t, re.ASCII) if x not in gate.KNOWN_IDS]
        banned = next((p for p in gate.BANNED if p in t.lower()), None)
        w = [x.lower() for x in re.findall("[A-Za-z]+", t)]
        own = set(zip(w, w[1:], w[2:], w[3:], strict=False))
        overlap = len(own & seen) / max(1, len(own))
        if n < 120:
            out[i] = f"short({n})"
        elif n > 600:
            out[i] = f"long({n})"
        elif banned:
            out[i] = f"banned:{banned}"
        elif re.search(r"\bVDB-\d+\b", t, re.ASCII):
            out[i] = "fake_vdb"
        elif strange:
            out[i] = f"fake_cve:{strange[0]}"
        elif overlap > 0.5:
            out[i] = f"similar({overlap * 100:.0f}%)"
        else:
            out[i] = "ok"
            seen |= own
    return out


def test_sequential_gate_is_a_plain_replay(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdef") for _ in range(3)) for _ in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([50, 130, 300, 700]))) for _ in range(60)]
    for _ in range(60):
        t = rng.choice(texts).split()
        at = rng.randrange(len(t))
        texts.append(" ".join(t[:at] + [rng.choice(words) for _ in range(rng.randint(0, 200))] + t[at:]))
    texts += [None, "", texts[0] + " As an AI, VDB-12", texts[1] + " VDB-7 " + "x " * 200, texts[2] + " y" * 130 + " CVE-2021-44228 CVE-2020-1234"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.reason for r in gate.sequential(df).collect()}
    assert got == plain_gate(rows) and {"ok", "short(50)"} <= set(got.values()) and any(v.startswith("similar") for v in got.values())


def test_sequential_gate_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert {r.doc_id: r.reason for r in gate.sequential(docs).collect()} == plain_gate([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("context", [1, 2, 5, 16])
def test_packing_is_one_stream(spark, context):
    rng = random.Random(context)
    rows = [(i, [rng.randrange(100) for _ in range(rng.choice([0, 1, 2, 7, 40]))]) for i in range(30)] + [(5000, [1, 2, 3])]
    flat = [t for _, ts in rows for t in ts]
    got = {r.idx: (r.x, r.y) for r in tokens.packed(spark.createDataFrame(rows, "o long, t array<int>").repartition(3), "o", "t", context).collect()}
    expected = {}
    for i in range(len(flat) // context):
        y = flat[i * context + 1 : (i + 1) * context + 1]
        expected[i] = (flat[i * context : (i + 1) * context], y + [tokens.IGNORE] * (context - len(y)))
    assert got == expected


def test_contains_any_by_either_way(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, "xone two three four"), (3, "a\tb  c d"), (4, None), (5, ""), (6, "four five")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "two three four five"), (2, "one two three four"), (3, "five"), (4, None), (5, ""), (6, "b  c d"), (7, "no such words here")], "item_id long, text string")
    expected = {(d.doc_id, i.item_id) for d in docs.collect() for i in items.collect() if d.text is not None and i.text and i.text in d.text}
    assert {tuple(r) for r in corpus.contains_any(docs, items).collect()} == expected
    monkeypatch.setattr(corpus, "KNOWN_WORDS", 1)
    assert {tuple(r) for r in corpus.contains_any(docs, items).collect()} == expected
    assert corpus.contains_any(docs, items.limit(0)).count() == 0


def test_top_words_break_ties_by_first_place(spark):
    docs = spark.createDataFrame([(2, "c b c"), (1, "b a d"), (3, "d e"), (4, None)], "doc_id long, text string")
    assert [(r["rank"], r.word, r.n) for r in corpus.top_words(docs, 4).orderBy("rank").collect()] == [(1, "b", 2), (2, "d", 2), (3, "c", 2), (4, "a", 1)]
    sources = spark.createDataFrame([("x", 5), ("y", 2), ("x", 9), ("y", 7), ("z", 1)], "s string, i int")
    assert [r.s for r in corpus.most_common(sources, "s", "i").collect()] == ["y", "x", "z"]


def test_lengths_of_cleaned_text(spark):
    rows = spark.createDataFrame([("  " + "x" * 4 + "   ",), ("x" * 9,), (None,)], "t string")
    assert [r[0] for r in rows.select(text.within(F.col("t"), 4, 8)).collect()] == ["xxxx", None, None]
    assert [r[0] for r in rows.select(text.within(F.col("t"), 5, None, 7)).collect()] == [None, "x" * 7, None]


def test_leaked_and_limits(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "i int, text string")
    assert [r.i for r in corpus.leaked(rows, rows.where("i = 2")).collect()] == [2]
    assert [r.i for r in corpus.first_rows(rows, ["i"], 2).collect()] == [1, 2] and corpus.first_rows(rows, ["i"], None).count() == 3


def test_empty_means(spark):
    none = spark.createDataFrame([], "i int, loss double")
    assert model.mean_loss(none, "i").first().mean_loss == float("inf")
    scored = spark.createDataFrame([("s", None)], "s string, v double")
    assert evaluation.mean_log_probability(scored, ["s"], "v").first().score == float("-inf")


def test_year_audit_of_no_rows(spark):
    got = {tuple(r) for r in corpus.year_audit(spark.createDataFrame([("x",), (None,)], "id string")).collect()}
    assert got == {("missing", None, 2)}
    assert {tuple(r) for r in corpus.year_audit(spark.createDataFrame([], "id string")).collect()} == {("missing", None, 0)}


def test_train_batches_are_shuffled_alike(spark):
    rows = spark.range(100).withColumnRenamed("id", "doc_id")
    by = lambda df: {r.doc_id: r.batch_no for r in tokens.batches(tokens.shuffled(df, "doc_id", 7), "place", 10, True).collect()}
    a = by(rows)
    assert a == by(rows.repartition(5)) and sorted(a.values()) == sorted(list(range(10)) * 10) and [a[i] for i in range(20)] != sorted(a[i] for i in range(20))


def test_gate_stream_is_a_plain_replay(spark):
    from cinderfold import plans

    seen, expected = set(), {}
    for d in sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id):
        w = [x.lower() for x in re.findall("[A-Za-z]+", d.text or "")]
        own = set(zip(w, w[1:], w[2:], w[3:], strict=False))
        overlap = len(own & seen) / max(1, len(own))
        expected[d.doc_id] = (overlap <= 0.5, round(overlap, 6))
        seen |= own if overlap <= 0.5 else set()
    assert {r.doc_id: (r.accepted, r.overlap) for r in plans.load().QUERIES["stream_gate"](spark, SF).collect()} == expected


def plain_replay(rows, seen=()):
    """order: (shingles, those in accepted texts before); rows in order."""
    seen, out = set(seen), []
    for i, t in rows:
        w = [x.lower() for x in re.findall("[A-Za-z]+", t or "")]
        own = set(zip(w, w[1:], w[2:], w[3:], strict=False))
        out.append((i, len(own), len(own & seen)))
        if 2 * out[-1][2] <= len(own):
            seen |= own
    return out


@pytest.mark.parametrize("open_rows", [1 << 17, 300, 30])
def test_replay_of_chains(spark, monkeypatch, open_rows):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(5000)]
    rows, now = [], [rng.choice(words) for _ in range(40)]
    for i in range(300):  # each shares about half with the one before, so most decisions hang on others
        now = [rng.choice(words) for _ in range(rng.randint(0, 80))] if rng.random() < 0.1 else now[rng.randint(5, 25) :] + [rng.choice(words) for _ in range(rng.randint(5, 25))]
        rows.append((i - 150, " ".join(now)))
    rows += [(1000, None), (1001, "one two three"), (1002, "é " + rows[7][1].upper().replace(" ", "é1"))]
    monkeypatch.setattr(replay, "_BUCKET_BYTES", 1 << 12)
    texts, n_bytes = replay.placed(spark.createDataFrame(rows, "n long, text string").repartition(5), "n", "text")
    got = {(r.at, r.total, r.covered) for r in replay.replayed(texts, n_bytes, open_rows).collect()}
    assert got == set(plain_replay(rows)) and 50 < sum(2 * c > n for _, n, c in got) < 250


def test_replay_of_equal_and_null_orders(spark, monkeypatch):
    monkeypatch.setattr(replay, "_VOCABULARY", 3)
    monkeypatch.setattr(replay, "_CHUNK", 5)
    rows = [(2, "a b c d e"), (2, "a b c d e"), (None, "a b c d f"), (1, "a b c d g"), (-(2**63), "b c d e f g h"), (2, None), (2, "")]
    texts, n_bytes = replay.placed(spark.createDataFrame(rows, "n long, text string"), "n", "text")
    got = [(r.ord, r.total, r.covered) for r in replay.replayed(texts, n_bytes).join(texts.select("at", "ord"), "at").orderBy("at").collect()]
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert [x[0] for x in got] == sorted((r[0] for r in rows), key=lambda x: key((x,)))
    assert sorted(x[1:] for x in got) == sorted(x[1:] for x in plain_replay(sorted(rows, key=lambda r: (*key(r), r[1] or ""))))

