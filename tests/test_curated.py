import hashlib

import pytest

from cinderfold.sources import curated


def test_cycles(spark):
    rows = curated.weaknesses(spark, quota=32).collect()
    assert len(rows) == 32 and len({r.id for r in rows}) == 15
    assert sum(r.id == "CWE-79" for r in rows) == 3 and sum(r.id == "CWE-287" for r in rows) == 2
    assert curated.risks(spark).count() == 2000
    assert all(len(r.text) >= 100 for r in rows)


def test_templates_and_unique_texts(spark):
    rows = curated.from_templates(spark, ["number {n}", "fixed"], 5, "t-", "made")
    assert sorted((r.id, r.text) for r in rows.collect()) == [("t-0", "number 0"), ("t-1", "fixed"), ("t-2", "number 2"), ("t-3", "fixed"), ("t-4", "number 4")]
    assert {r.id for r in curated.unique_texts(rows).collect()} == {"t-0", "t-1", "t-2", "t-4"}


def test_generated(spark):
    def transport(prompt):
        if prompt == "bad":
            raise OSError("down")
        return prompt.upper()

    rows = curated.generated(spark.createDataFrame([("1", "ok"), ("2", "bad")], "id string, prompt string"), transport).collect()
    assert {r.id: (r.text, r.error) for r in rows} == {"1": ("OK", None), "2": (None, "down")}


def test_seeded_order(spark):
    df = spark.range(50)
    a, b, c = ([r.id for r in curated.seeded_order(d, "id", s).collect()] for d, s in ((df, 42), (df.repartition(3), 42), (df, 43)))
    assert a == b != c and sorted(c) == list(range(50))


def test_required(spark):
    rows = spark.createDataFrame([("u", "MIT"), ("v", "")], "url string, license string")
    assert curated.required(rows, "url").count() == 2
    with pytest.raises(ValueError, match="license"):
        curated.required(rows, "url", "license")


def test_checksums(spark, tmp_path):
    (tmp_path / "w.bin").write_bytes(b"weights")
    assert [tuple(r) for r in curated.checksums(spark, str(tmp_path)).collect()] == [("w.bin", 7, hashlib.sha256(b"weights").hexdigest())]
