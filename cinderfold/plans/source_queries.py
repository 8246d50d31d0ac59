"""Queries of readers and writers: each writes files from the tables in their own format, reads them back by the library's
reader, and is held against SQL over the tables. Single files hold tables of a fixed size (nation, region)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinderfold.functions import model
from cinderfold.plans.fragments import CLEAN
from cinderfold.plans.registry import docs, query, table
from cinderfold.sources import curated, files, paged
from cinderfold.sources.scratch import scratch


def _records(spark, sf_dir):
    return docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), "text", "source")


def _digest(c):
    return F.md5(F.col(c).cast("binary")).alias("digest")


# JSON


@query("SELECT CAST(doc_id AS VARCHAR) AS id, md5(text) AS digest, source FROM documents")
def jsonl_round_trip(spark, sf_dir):
    path = scratch(spark, "jsonl")
    files.write_jsonl(_records(spark, sf_dir), path)
    return files.read_jsonl(spark, path).select("id", _digest("text"), "source")


@query("SELECT 'record' AS kind, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS total FROM documents WHERE doc_id % 10 <> 3 UNION ALL SELECT 'malformed', count(*), NULL FROM documents WHERE doc_id % 10 = 3")
def jsonl_tolerant(spark, sf_dir):
    path = scratch(spark, "mixed")
    line = F.to_json(F.struct("id", "text", "source"))
    broken = F.when(F.col("id") % 10 == 3, F.substring(line, F.lit(1), F.length(line) - 2)).otherwise(line)
    _records(spark, sf_dir).select(F.explode(F.when(F.col("id") % 10 == 4, F.array(broken, F.lit(" \t"))).otherwise(F.array(broken)))).write.text(path)
    good, bad = files.read_jsonl_tolerant(spark, path)
    counted = lambda df, kind, total: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), total.cast("long").alias("total"))
    return counted(good, "record", F.sum(F.col("id").cast("long"))).unionByName(counted(bad, "malformed", F.lit(None)))


@query("SELECT source, count(*) AS n, count(DISTINCT doc_id) AS n_ids FROM documents GROUP BY source")
def jsonl_append(spark, sf_dir):
    path, rows = scratch(spark, "appended"), _records(spark, sf_dir)
    for half in (0, 1):
        files.write_jsonl(rows.where(F.col("id") % 2 == half), path, append=True)
    return files.read_jsonl(spark, path).groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_ids"))


@query("SELECT r_name AS source_file, count(*) AS n, min(n_name) AS least FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def source_discovery(spark, sf_dir):
    path = scratch(spark, "sources")
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lines = rows.select("r_name", F.to_json(F.struct(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("text"))).alias("line"))
    for r in lines.groupBy("r_name").agg(F.array_join(F.collect_list("line"), "\n").alias("text")).collect():
        files.write_file(spark, f"{path}/{r.r_name}.jsonl", r.text + "\n")
    found = files.with_source_file(files.read_jsonl(spark, f"{path}/*.jsonl"))
    return found.groupBy("source_file").agg(F.count("*").alias("n"), F.min("text").alias("least"))


@query("SELECT count(*) AS n_docs, count(DISTINCT source) AS n_sources, round(avg(length(text)), 6) AS mean_length FROM documents")
def metrics_document(spark, sf_dir):
    path = scratch(spark, "metrics") + ".json"
    metrics = docs(spark, sf_dir).agg(F.count("*").alias("n_docs"), F.count_distinct("source").alias("n_sources"), F.round(F.avg(F.length("text")), 6).alias("mean_length"))
    files.write_document(metrics, path)
    return files.read_document(spark, path, "n_docs long, n_sources long, mean_length double")


@query("SELECT 50261 AS vocab_size, name, id FROM (VALUES ('BOS', 50257), ('EOS', 50258), ('PAD', 50259), ('UNK', 50260)) t(name, id)")
def tokenizer_facts(spark, sf_dir):
    path = scratch(spark, "tokenizer") + ".json"
    files.write_tokenizer_facts(spark, path, model.VOCABULARY, model.SPECIAL_IDS)
    return files.read_tokenizer_facts(spark, path)


# Trees of files

_PAGE = "'# ' || n_name || chr(10) || chr(10) || repeat('The nation ' || n_name || ' has the number ' || n_nationkey || '.' || chr(10), CAST(n_nationkey * n_nationkey + 1 AS INTEGER))"


@query(f"WITH t AS (SELECT n_nationkey AS k, {CLEAN.format(_PAGE)} AS text FROM nation) SELECT 'org/repo:docs/n' || k || '.md' AS id, 'docs/n' || k || '.md' AS path, md5(substr(text, 1, 12000)) AS digest, TRUE AS license_file_present FROM t WHERE length(text) >= 200")
def markdown_tree(spark, sf_dir):
    path = scratch(spark, "tree")
    files.write_file(spark, f"{path}/LICENSE", "MIT")
    for r in table(spark, sf_dir, "nation").collect():
        page = f"# {r.n_name}\n\n" + f"The nation {r.n_name} has the number {r.n_nationkey}.\n" * (r.n_nationkey**2 + 1)
        files.write_file(spark, f"{path}/docs/n{r.n_nationkey}.md", page)
        files.write_file(spark, f"{path}/docs/n{r.n_nationkey}.txt", page)
    return files.read_markdown(spark, path, "org/repo", "MIT", subdir="docs").select("id", "path", _digest("text"), "license_file_present")


_CODE = "repeat('line of ' || n_name || chr(10), CAST(n_nationkey * n_nationkey * 2 AS INTEGER))"
_HEAD = "'Exploit-DB #' || n_nationkey || ': ' || n_name || ', found' || chr(10) || 'Platform: linux / local' || CASE WHEN n_nationkey % 2 = 0 THEN chr(10) || 'CVE: CVE-2020-' || n_nationkey ELSE '' END"


@query(f"WITH t AS (SELECT n_nationkey AS k, {CLEAN.format(f'{_HEAD} || chr(10) || chr(10) || {_CODE}')} AS text FROM nation WHERE n_nationkey % 5 <> 4) SELECT 'edb-' || k AS id, md5(text) AS digest FROM t WHERE length(text) BETWEEN 100 AND 8000")
def exploit_files(spark, sf_dir):
    path = scratch(spark, "exploits")
    index = ["id,file,description,platform,type,codes"]
    for r in table(spark, sf_dir, "nation").collect():
        k = r.n_nationkey
        index.append(f'{k},code/{k}.txt,"{r.n_name}, found",linux,local,{f"CVE-2020-{k}" if k % 2 == 0 else ""}')
        if k % 5 != 4:
            files.write_file(spark, f"{path}/tree/code/{k}.txt", f"line of {r.n_name}\n" * (k * k * 2))
    files.write_file(spark, f"{path}/index.csv", "\n".join(index) + "\n")
    return files.read_exploits(spark, f"{path}/index.csv", f"{path}/tree").select("id", _digest("text"))


@query("SELECT 'n' || n_nationkey || '.txt' AS file, CAST(strlen(n_name) AS BIGINT) AS bytes, sha256(n_name) AS sha256 FROM nation")
def export_checksums(spark, sf_dir):
    path = scratch(spark, "export")
    for r in table(spark, sf_dir, "nation").collect():
        files.write_file(spark, f"{path}/n{r.n_nationkey}.txt", r.n_name)
    return curated.export(spark, path, {"format": "text"})


@query("SELECT n_name, n_regionkey FROM nation")
def required_keys(spark, sf_dir):
    return curated.required(table(spark, sf_dir, "nation").select("n_name", F.col("n_regionkey").cast("string").alias("n_regionkey")), "n_name", "n_regionkey").select("n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))


# Feeds and bundles


@query(f"WITH t AS (SELECT doc_id, {CLEAN.format('coalesce(source, $$$$) || chr(10) || chr(10) || text')} AS t FROM documents WHERE length(text) > 0) SELECT 'urn:' || doc_id AS id, md5(t) AS digest FROM t WHERE length(t) >= 100")
def atom_feed(spark, sf_dir):
    path = scratch(spark, "feed")
    entries = docs(spark, sf_dir).select(F.concat(F.lit("urn:"), F.col("doc_id")).alias("id"), F.col("source").alias("title"), F.col("text").alias("summary"))
    entries.write.format("xml").option("rootTag", "feed").option("rowTag", "entry").save(path)
    return files.read_atom(spark, path).select("id", _digest("text"))


@query("SELECT 'a' || i AS id, md5('Title ' || i || chr(10) || chr(10) || rtrim(repeat('word' || i || ' ', CAST(i % 40 AS INTEGER)))) AS digest FROM range(1050) r(i) WHERE length('Title ' || i || chr(10) || chr(10) || rtrim(repeat('word' || i || ' ', CAST(i % 40 AS INTEGER)))) >= 100 AND i % 40 > 0")
def paged_feed(spark, sf_dir):
    def fetch(start: int, n: int) -> str:
        entries = [f"<entry><id>a{i}</id><title>Title {i}</title><summary>{f'word{i} ' * (i % 40)}</summary></entry>" for i in range(start, start + n)]
        return f"<feed>{''.join(entries)}</feed>"

    spark.dataSource.register(paged.feed_source("cinderfold_feed", 1050, fetch))
    return paged.read_feed(spark, "cinderfold_feed").select("id", _digest("text"))


def _bundles(spark, sf_dir):
    """One STIX bundle in a file for every 256 ids."""
    k, path = F.col("doc_id"), scratch(spark, "stix")
    phase = lambda chain, name: F.struct(F.lit(chain).alias("kill_chain_name"), name.alias("phase_name"))
    reference = lambda source, ident: F.struct(F.lit(source).alias("source_name"), ident.alias("external_id"))
    phases = F.when(k % 3 == 0, F.array(phase("mitre-attack", F.lit("one")), phase("other", F.lit("no")), phase("mitre-attack", F.concat(F.lit("p"), k)))).otherwise(F.array(phase("other", F.lit("no"))))
    references = F.array(reference("capec", F.when(k % 2 == 0, F.concat(F.lit("CAPEC-"), k)).otherwise("")), reference("mitre-attack", F.when(k % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("T"), k))))
    item = F.struct(
        F.when(k % 5 == 0, "malware").otherwise("attack-pattern").alias("type"),
        F.concat(F.lit("Name "), k).alias("name"),
        F.col("text").alias("description"),
        F.when(k % 7 == 0, True).alias("revoked"),
        (k % 11 == 0).alias("x_mitre_deprecated"),
        phases.alias("kill_chain_phases"),
        references.alias("external_references"),
    )
    rows = docs(spark, sf_dir).select(F.floor(k / 256).alias("bundle"), k, item.alias("o"))
    grouped = rows.groupBy("bundle").agg(F.to_json(F.struct(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "o"))), lambda x: x["o"]).alias("objects"))).alias("value"))  # 256 objects
    grouped.write.partitionBy("bundle").text(path)
    return path


def _stix_sql(head: str, ident: str, where: str) -> str:
    return f"WITH t AS (SELECT {ident} AS id, {CLEAN.format(f'{head} || chr(10) || chr(10) || text')} AS t FROM documents WHERE doc_id % 5 <> 0 AND text <> '' {where}) SELECT id, md5(t) AS digest FROM t WHERE length(t) >= 100"


_TECHNIQUE = "CASE WHEN doc_id % 4 = 0 THEN $$$$ ELSE $$T$$ || doc_id END"


@query(_stix_sql(f"$$MITRE ATT&CK Technique $$ || {_TECHNIQUE} || $$: Name $$ || doc_id || chr(10) || $$Tactic: $$ || CASE WHEN doc_id % 3 = 0 THEN $$one, p$$ || doc_id ELSE $$unknown$$ END", "CASE WHEN doc_id % 4 = 0 THEN 'Name ' || doc_id ELSE 'T' || doc_id END", "AND doc_id % 7 <> 0 AND doc_id % 11 <> 0"))
def stix_techniques(spark, sf_dir):
    return files.read_techniques(spark, _bundles(spark, sf_dir), most=None).select("id", _digest("text"))


@query(_stix_sql("$$CAPEC $$ || CASE WHEN doc_id % 2 = 0 THEN $$CAPEC-$$ || doc_id ELSE $$$$ END || $$: Name $$ || doc_id", "CASE WHEN doc_id % 2 = 0 THEN 'CAPEC-' || doc_id ELSE 'Name ' || doc_id END", ""))
def stix_attack_patterns(spark, sf_dir):
    return files.read_attack_patterns(spark, _bundles(spark, sf_dir), most=None).select("id", _digest("text"))


# Paged records

_FIRST, _LAST, _IN_WINDOW = 2020, 2021, 2500


def _fetch(start: str, end: str, index: int) -> dict:
    """A page of made-up records: every hundredth repeats the id before it, every seventh is too short."""
    window = (int(start[:4]) - _FIRST) * 4 + {"01": 0, "04": 1, "08": 2, "12": 3}[start[5:7]]
    found = []
    for i in range(index, min(index + paged.PAGE, _IN_WINDOW)):
        n = window * _IN_WINDOW + i - (i % 100 == 99)
        say = lambda lang, n=n, i=i: {"lang": lang, "value": "short" if i % 7 == 0 else f"{lang} text {n} " * 8}
        found.append({"cve": {"id": f"CVE-{start[:4]}-{10000 + n}", "descriptions": [[say("en")], [say("fr"), say("en")], [say("de")], []][i % 4]}})
    return {"vulnerabilities": found, "totalResults": _IN_WINDOW}


_PAGED_SQL = f"""WITH i AS (SELECT w, i, w * {_IN_WINDOW} + i - CASE WHEN i % 100 = 99 THEN 1 ELSE 0 END AS n FROM range(8) a(w), range({_IN_WINDOW}) b(i)),
 t AS (SELECT w, i, {_FIRST} + w // 4 AS year, 'CVE-' || ({_FIRST} + w // 4) || '-' || (10000 + n) AS id, CASE WHEN i % 4 = 3 THEN '' WHEN i % 7 = 0 THEN 'short' ELSE rtrim(repeat(CASE WHEN i % 4 = 2 THEN 'de' ELSE 'en' END || ' text ' || n || ' ', 8)) END AS text FROM i),
 f AS (SELECT * FROM t WHERE length(text) >= 50 QUALIFY row_number() OVER (PARTITION BY id ORDER BY w, i) = 1)"""


def _register(spark):
    spark.dataSource.register(paged.paged_source("cinderfold_pages", paged.year_windows(_FIRST, _LAST), _fetch))


@query(f"{_PAGED_SQL} SELECT id, md5(text) AS digest, CAST(year AS INTEGER) AS year FROM f WHERE CAST(right(id, 5) AS INTEGER) % 50 <> 0")
def paged_records(spark, sf_dir):
    _register(spark)
    existing = spark.range(0, 4 * 2 * _IN_WINDOW, 50).select(F.explode(F.array(*[F.concat(F.lit(f"CVE-{y}-"), F.col("id") + 10000) for y in (_FIRST, _LAST)])).alias("id"))
    return paged.read_paged(spark, "cinderfold_pages", existing).select("id", _digest("text"), "year")


@query(f"{_PAGED_SQL} SELECT id, CAST(year AS INTEGER) AS year FROM f QUALIFY row_number() OVER (PARTITION BY year ORDER BY w, i) <= 500")
def capped_records(spark, sf_dir):
    _register(spark)
    return paged.read_paged(spark, "cinderfold_pages", per_year=500).select("id", "year")


# Stand-ins


@query("SELECT 'mitre_attack' AS source, 200 AS n, 200 AS n_texts UNION ALL SELECT 'capec', 200, 200 UNION ALL SELECT 'ctf', 21, 21")
def fallback_records(spark, sf_dir):
    def missing():
        return files.read_jsonl(spark, scratch(spark, "missing"))

    found = [paged.with_fallback(missing, lambda: files.merge([spark.createDataFrame([], files.RECORD)]), lambda s=s: curated.fallback(spark, s)) for s in ("mitre_attack", "capec", "ctf")]
    return files.union_all(*found).groupBy("source").agg(F.count("*").cast("int").alias("n"), F.count_distinct("text").cast("int").alias("n_texts"))
