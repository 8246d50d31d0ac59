import datetime
import json

import pytest

from cinderfold.sources import files, paged
from cinderfold.streaming import ingest


def write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content)
    return str(path)


def test_jsonl(spark, tmp_path):
    write(tmp_path / "a.jsonl", '{"id": 1, "text": "x"}\n\n{"id": "b", "text": "é", "source": "s"}\n')
    rows = sorted(map(tuple, files.read_jsonl(spark, str(tmp_path)).collect()), key=str)
    assert rows == [("1", "x", None), ("b", "é", "s")]
    write(tmp_path / "b.jsonl", "{bad\n")
    good, bad = files.read_jsonl_tolerant(spark, str(tmp_path))
    assert good.count() == 2 and bad.count() == 1
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_jsonl(spark, str(tmp_path)).collect()
    named = files.with_source_file(spark.read.schema(files.RECORD).json(f"{tmp_path}/a.jsonl"))
    assert {r.source_file for r in named.collect()} == {"a"}


def test_jsonl_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", "é\n汉", "s")], files.RECORD)
    files.write_jsonl(df, f"{tmp_path}/out")
    files.write_jsonl(df, f"{tmp_path}/out", append=True)
    assert files.read_jsonl(spark, f"{tmp_path}/out").collect() == df.collect() * 2


@pytest.mark.parametrize(("present", "force", "chosen"), [({"cve", "cve_full", "ctf"}, False, {"cve_full", "ctf"}), ({"cve", "ctf"}, False, {"cve", "ctf"}), ({"cve", "cve_full"}, True, {"cve"}), ({"cve_full"}, True, {"cve_full"}), ({"ctf"}, False, {"ctf"})])
def test_source_selection(spark, present, force, chosen):
    rows = [(s, "cve" if s == "cve_full" else None) for s in sorted(present)]
    manifest = spark.createDataFrame(rows, "source_file string, supersedes string")
    assert {r.source_file for r in files.select_sources(manifest, force).where("selected").collect()} == chosen


def test_markdown(spark, tmp_path):
    write(tmp_path / "LICENSE", "MIT")
    write(tmp_path / "a" / "long.md", "word " * 60)
    write(tmp_path / "a" / "huge.md", "x" * 50000)
    write(tmp_path / "b" / "other.md", "other " * 60)
    write(tmp_path / "short.md", "short")
    write(tmp_path / "a" / "no.txt", "word " * 60)
    rows = {r.path: r for r in files.read_markdown(spark, str(tmp_path), "org/repo", "MIT").collect()}
    assert set(rows) == {"a/long.md", "a/huge.md", "b/other.md"}
    assert len(rows["a/huge.md"].text) == 12000 and rows["a/long.md"].license_file_present and rows["a/long.md"].id == "org/repo:a/long.md"
    assert files.read_markdown(spark, str(tmp_path), "r", "MIT", subdir="a").count() == 2
    (tmp_path / "LICENSE").unlink()
    assert not files.read_markdown(spark, str(tmp_path), "r", "MIT").first().license_file_present


def test_stix(spark, tmp_path):
    long = "d" * 120
    objects = [
        {"type": "attack-pattern", "name": "One", "description": long, "kill_chain_phases": [{"kill_chain_name": "mitre-attack", "phase_name": "p1"}, {"kill_chain_name": "x", "phase_name": "no"}, {"kill_chain_name": "mitre-attack", "phase_name": "p2"}], "external_references": [{"source_name": "capec", "external_id": "CAPEC-1"}, {"source_name": "mitre-attack", "external_id": "T1"}]},
        {"type": "attack-pattern", "name": "Old", "description": long, "revoked": True},
        {"type": "attack-pattern", "name": "Gone", "description": long, "x_mitre_deprecated": True},
        {"type": "attack-pattern", "name": "Empty", "description": ""},
        {"type": "malware", "name": "Other", "description": long},
        {"type": "attack-pattern", "name": "Bare", "description": long},
    ]
    path = write(tmp_path / "bundle.json", json.dumps({"objects": objects}))
    got = {r.id: r.text for r in files.read_techniques(spark, path).collect()}
    assert got == {"T1": f"MITRE ATT&CK Technique T1: One\nTactic: p1, p2\n\n{long}", "Bare": f"MITRE ATT&CK Technique : Bare\nTactic: unknown\n\n{long}"}
    assert {r.id for r in files.read_attack_patterns(spark, path).collect()} == {"CAPEC-1", "Old", "Gone", "Bare"}


def test_atom(spark, tmp_path):
    entry = lambda i, t, s: f"<entry><id> {i} </id><title>{t}</title><summary>{s}</summary></entry>"
    path = write(tmp_path / "feed.xml", f'<feed xmlns="http://www.w3.org/2005/Atom">{entry("x1", "Title", "s" * 120)}{entry("x2", "T", "")}{entry("x3", "T", "short")}</feed>')
    assert [(r.id, r.text) for r in files.read_atom(spark, path).collect()] == [("x1", "Title\n\n" + "s" * 120)]


def test_exploits(spark, tmp_path):
    index = write(tmp_path / "index.csv", 'id,file,description,platform,type,codes\n1,exploits/a.py,"One, two",linux,local,CVE-2020-1\n2,exploits/none.py,No,linux,local,\n3,exploits/big.txt,Big,win,dos,\n4,,Empty,x,y,\n')
    write(tmp_path / "repo" / "exploits" / "a.py", "code " * 30)
    write(tmp_path / "repo" / "exploits" / "big.txt", "x" * 9000)
    got = files.read_exploits(spark, index, str(tmp_path / "repo")).collect()
    assert [(r.id, r.text.split("\n")[:3]) for r in got] == [("edb-1", ["Exploit-DB #1: One, two", "Platform: linux / local", "CVE: CVE-2020-1"])]


def test_writeups(spark):
    rows = [(1, "", "w" * 200, None), (2, None, None, ["c" * 150, "d" * 60]), (3, "short", "w" * 300, None), (4, "t" * 250, "w", None)]
    got = {r.ord: r.text for r in files.writeups(spark.createDataFrame(rows, "ord int, text string, writeup string, content array<string>")).collect()}
    assert got == {1: "w" * 200, 2: "c" * 150 + " " + "d" * 60, 4: "t" * 250}


def test_merge_keeps_the_first(spark):
    a = spark.createDataFrame([("a1", "Same  text"), ("a2", "own")], "id string, text string")
    b = spark.createDataFrame([("b1", " same TEXT ", "x"), ("b2", "new", "y")], "id string, text string, repo string")
    assert {r.id for r in files.merge([a, b]).collect()} == {"a1", "a2", "b2"}


def test_year_windows():
    windows = paged.year_windows(2020, 2024)
    assert len(windows) == 20
    days = []
    for start, end, year in windows:
        a, b = datetime.date.fromisoformat(start[:10]), datetime.date.fromisoformat(end[:10])
        assert a.year == b.year == year and (b - a).days < 119
        days += [a + datetime.timedelta(days=i) for i in range((b - a).days + 1)]
    assert days == [datetime.date(2020, 1, 1) + datetime.timedelta(days=i) for i in range(len(days))] and days[-1] == datetime.date(2024, 12, 31)


def test_paged(spark):
    items = [{"cve": {"id": f"CVE-2023-{i}", "descriptions": [{"lang": "en", "value": f"{'long ' * 20}{i}" if i != 3 else "short"}]}} for i in range(5)]

    def fetch(start, end, index):
        return {"vulnerabilities": items[index : index + 3], "totalResults": 5} if start.startswith("2023-01") else {"vulnerabilities": [], "totalResults": 0}

    spark.dataSource.register(paged.paged_source("pages_for_test", paged.year_windows(2023, 2023), fetch))
    got = paged.read_paged(spark, "pages_for_test")
    assert {r.id for r in got.collect()} == {f"CVE-2023-{i}" for i in (0, 1, 2, 4)}
    existing = spark.createDataFrame([("CVE-2023-0", "kept as it was")], "id string, text string")
    assert {r.id for r in paged.read_paged(spark, "pages_for_test", existing).collect()} == {f"CVE-2023-{i}" for i in (1, 2, 4)}
    assert paged.read_paged(spark, "pages_for_test", per_year=2).count() == 2


def test_fallback(spark):
    def broken():
        raise OSError("no network")

    assert paged.with_fallback(broken, lambda: spark.range(0), lambda: spark.range(3)).count() == 3
    with pytest.raises(OSError):
        paged.with_fallback(broken, broken)


def test_ingest_stream(spark, tmp_path):
    source, sink, check = (f"{tmp_path}/{x}" for x in ("in", "sink", "check"))
    schema = "id long, text string"
    for batch in ([(1, "a"), (2, "b"), (2, "c")], [(2, "later"), (3, "d")]):
        spark.createDataFrame(batch, schema).write.mode("append").parquet(source)
        ingest.ingest_stream(spark.readStream.schema(schema).parquet(source), sink, check, "id", ["text"])
    assert sorted(map(tuple, spark.read.parquet(sink).collect())) == [(1, "a"), (2, "b"), (3, "d")]
    ingest.ingest_stream(spark.readStream.schema(schema).parquet(source), sink, f"{check}2", "id", ["text"])  # all again
    assert spark.read.parquet(sink).count() == 3


def test_gate_stream(spark, tmp_path):
    words = " ".join("abcdefghijklmnopqrstuvwxyz"[i : i + 3] for i in range(20))
    rows = [(1, words), (2, words + " more of it"), (3, "quite another text with other words"), (4, None)]
    spark.createDataFrame(rows, "n long, text string").write.parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ingest.ROCKSDB)
    stream = ingest.gate_stream(spark.readStream.schema("n long, text string").parquet(f"{tmp_path}/in"), "n", "text")
    stream.writeStream.format("memory").queryName("gate").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    assert {r.ord: r.accepted for r in spark.table("gate").collect()} == {1: True, 2: False, 3: True, 4: True}


def test_gate_into(spark, tmp_path):
    from tests.test_operators import plain_replay

    source, sink, check = (f"{tmp_path}/{x}" for x in ("in", "sink", "check"))
    words = [f"{a}{b}{c}" for a in "abc" for b in "defg" for c in "hijkl"]
    batches = [[(5, " ".join(words[:20])), (1, " ".join(words[10:30])), (7, None)], [(5, " ".join(words[15:40])), (2, " ".join(words[2:19])), (3, "new words in here alone")], [(0, " ".join(words[20:42])), (9, "new words in here")]]
    expected, rows = {}, []
    for batch in batches:
        rows += sorted(batch, key=lambda r: r[0])
        spark.createDataFrame(batch, "n long, text string").write.mode("append").parquet(source)
        out = ingest.gate_into(spark.readStream.schema("n long, text string").parquet(source), sink, check, "n", "text")
    expected = sorted((i, 2 * c <= n, c / max(1, n)) for i, n, c in plain_replay(rows))
    assert sorted(map(tuple, out.collect())) == expected and 2 <= sum(not a for _, a, _ in expected) <= 5


def test_windowed_stream_equals_batch(spark, tmp_path):
    schema = spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema
    stream = ingest.windowed_counts(spark.readStream.schema(schema).parquet("/root/testdata/sf0.001/events.parquet*"), "ts", "event_type", "value", "1 day", "0 seconds")
    stream.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    batch = ingest.windowed_counts(spark.read.parquet("/root/testdata/sf0.001/events.parquet"), "ts", "event_type", "value", "1 day", "0 seconds")
    key = lambda r: (r.start, r.event_type, r.n)
    assert sorted(map(key, spark.table("counts").collect())) == sorted(map(key, batch.collect()))
