import random
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from cinderfold.llm.mixing import MOST, OP3_SQL, SCHEDULES, curriculum, in_training_order, integrate, mix, op3_mixing, position, sizes, source_targets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, target string, taken string, k1 string, _at string"


def water(sizes_, weights=(1, 2, 3), most=MOST):
    """Targets by sharing what is over again and again."""
    w = [weights[i % len(weights)] for i in range(len(sizes_))]
    full, total = set(), sum(sizes_)
    while True:
        left = total - sum(most * sizes_[i] for i in full)
        open_ = sum(w[i] for i in range(len(w)) if i not in full)
        targets = [most * sizes_[i] if i in full else left * w[i] / open_ for i in range(len(w))]
        over = {i for i in range(len(w)) if i not in full and targets[i] > most * sizes_[i]}
        if not over:
            return targets
        full |= over


@pytest.mark.parametrize("sizes_", [[10], [1, 100, 1], [5, 0, 7, 1000, 2, 2], [100, 90, 80, 1, 1, 1, 50], [3, 2, 1], [1, 1, 1, 1, 1, 1, 1, 1000000]])
def test_targets(spark, sizes_):
    df = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes_)], "source string, source_size long")
    got = {r.source: r.target for r in source_targets(df).collect()}
    assert [got[f"s{i}"] for i in range(len(sizes_))] == pytest.approx(water(sizes_))


def test_positions_invert_the_integral(spark):
    shares = [i / 50 for i in range(50)]
    df = spark.createDataFrame([(s, i) for s in shares for i in range(len(SCHEDULES))], "share double, schedule int")
    for r in df.withColumn("t", position(F.col("share"), F.col("schedule"))).collect():
        demand = 0.0
        for t0, t1, w0, w1, before, behind in integrate(SCHEDULES[r.schedule]):
            if t0 <= r.t <= t1:
                demand = before + (r.t - t0) * (w0 + (w0 + (w1 - w0) * (r.t - t0) / (t1 - t0))) / 2
        assert demand == pytest.approx(r.share, abs=1e-9)


def rows_of(n=400, seed=1):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(1, 60))), "en", rng.choice(["a", "a", "a", "b", "C", "é", None]), 1, "", "", "", "") for i in range(n)]
    return rows + [(n, None, None, "b", None, "", "", "", ""), (n + 1, "", None, None, None, "", "", "", ""), (None, "no id", None, "a", None, "", "", "", ""), (n + 2, "x " * 3000, None, "hot", 1, "", "", "", ""), rows[5], rows[5]]


def test_mix(spark):
    docs = spark.createDataFrame(rows_of(), SCHEMA)
    got = mix(sizes(docs)).collect()
    assert len(got) == docs.count()
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert 0 <= r.taken <= MOST * r.size and r.taken == r.times * r.size
    names = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None]
    expected = dict(zip(names, water([sum(r.size for r in by[s]) for s in names]), strict=True))
    for s, rs in by.items():
        assert rs[0].target == pytest.approx(expected[s]) and rs[0].source_size == sum(r.size for r in rs)
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= max(r.size for r in rs) / 2
    again = mix(sizes(docs.repartition(7))).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(again, key=key)


def test_training_order(spark):
    docs = spark.createDataFrame(rows_of(), SCHEMA)
    out = in_training_order(docs)
    assert out.columns == docs.columns
    times = {(r.k1, r.k2): 0 for r in mix(sizes(docs)).collect()}
    for r in mix(sizes(docs)).collect():
        times[r.k1, r.k2] += r.times if r["size"] else 1
    assert out.count() == sum(times.values())
    turns = curriculum(mix(sizes(docs))).collect()
    assert all(0 <= t.position <= 1 for t in turns)


def test_oracle(spark, tmp_path):
    docs = spark.createDataFrame(rows_of(), SCHEMA).select("doc_id", "text", "lang", "source", "n_chars")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, op3_mixing(spark, str(tmp_path)).collect()), key=key) == sorted(con.execute(OP3_SQL).fetchall(), key=key)


def test_query_is_read_from_the_range_sorted_sequence(spark, tmp_path, monkeypatch):
    from cinderfold.llm import mixing

    docs = spark.createDataFrame(rows_of(), SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    monkeypatch.setattr(mixing, "in_sequence", lambda turns, f=mixing.in_sequence: kept.append(f(turns)) or kept[-1])
    got = op3_mixing(spark, str(tmp_path)).collect()
    assert len(kept) == 1 and sum(r.taken for r in got) == kept[0].agg(F.sum("size")).first()[0]
    order = [r.position for r in kept[0].collect()]
    assert order == sorted(order) and len(order) > 400


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert mix(sizes(docs)).count() == 0 and in_training_order(docs).count() == 0
