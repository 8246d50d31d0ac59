"""Readers and writers of corpus files: JSON Lines, Markdown trees, Atom feeds, STIX bundles, CSV with files beside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinderfold.functions.text import clean_text, content_hash, first_filled, strip
from cinderfold.operators.corpus import first_rows, first_wins, union_all

RECORD = "id string, text string, source string"
CORRUPT = "_corrupt_record"


def read_jsonl(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """Strict: a malformed line fails the job. Blank lines are skipped; missing keys are null."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: str = RECORD) -> tuple[DataFrame, DataFrame]:
    """Records, and the lines that are malformed."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    lines = spark.read.text(path).where(strip(F.col("value")) != "")
    both = lines.select("value", F.from_json("value", f"{schema}, {CORRUPT} string", options).alias("r"))
    return both.where(F.col(f"r.{CORRUPT}").isNull()).select("r.*").drop(CORRUPT), both.where(F.col(f"r.{CORRUPT}").isNotNull()).select("value")


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_document(row: DataFrame, path: str) -> None:
    """A table of one row, such as the metrics of a run, as one indented JSON document at exactly that path."""
    found = row.select(F.to_json(F.struct(*row.columns), {"pretty": "true", "ignoreNullFields": "false"}).alias("d")).limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"a document has one row, not {len(found) or 'none'}")
    write_file(row.sparkSession, path, found[0].d + "\n")


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def write_file(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written by the driver to any store that Spark can write to."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_tokenizer_facts(spark: SparkSession, path: str, vocabulary: int, special: dict[str, int]) -> None:
    """Vocabulary size and special ids of a tokenizer as a JSON document."""
    ids = F.struct(*[F.lit(i).alias(name) for name, i in special.items()])
    write_document(spark.range(1).select(F.lit(vocabulary).alias("vocab_size"), ids.alias("special_tokens")), path)


def read_tokenizer_facts(spark: SparkSession, path: str) -> DataFrame:
    """name, id of the special ids, with vocab_size in every row."""
    facts = read_document(spark, path, "vocab_size int, special_tokens map<string, int>")
    return facts.select("vocab_size", F.explode("special_tokens").alias("name", "id"))


def with_source_file(df: DataFrame) -> DataFrame:
    """df with source_file, the stem of the *.jsonl file a row came from."""
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.jsonl$", 1)  # escaped as in an address
    return df.withColumn("source_file", F.url_decode(F.replace(stem, F.lit("+"), F.lit("%2B"))))


def select_sources(manifest: DataFrame, force_legacy: bool = False) -> DataFrame:
    """manifest (source_file, supersedes) with selected: a source gives way to one that supersedes it, or the other way
    round if the legacy one is forced and there."""
    newer = manifest.where(F.col("supersedes").isNotNull()).select(F.col("supersedes").alias("source_file"), F.col("source_file").alias("_by"))
    present = manifest.select(F.col("source_file").alias("supersedes"), F.lit(True).alias("_legacy_there")).distinct()
    both = manifest.join(newer, "source_file", "left").join(present, "supersedes", "left")
    selected = ~(F.col("supersedes").isNotNull() & F.coalesce("_legacy_there", F.lit(False))) if force_legacy else F.col("_by").isNull()
    return both.select("source_file", "supersedes", selected.alias("selected"))


def read_markdown(spark: SparkSession, path: str, repo: str, license: str, subdir: str | None = None, least: int = 200, most: int = 12000) -> DataFrame:
    """Cleaned Markdown files below path/subdir, at least `least` characters, cut at `most`, with repository facts."""
    root = path if subdir is None else f"{path}/{subdir}"
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root, wholetext=True)
    files = files.select(F.col("value"), F.col("_metadata.file_path").alias("file"))
    licences = spark.read.option("pathGlobFilter", "LICENSE*").format("binaryFile").load(path).limit(1).count()
    relative = F.regexp_replace(F.col("file"), r"^.*?\Q" + path.rstrip("/") + r"\E/", "")
    text = clean_text(F.col("value"))
    out = files.select(F.concat(F.lit(f"{repo}:"), relative).alias("id"), text.alias("text"), F.lit("ctf_repo").alias("source"), F.lit(repo).alias("repo"), relative.alias("path"), F.lit(license).alias("license"), F.lit(licences > 0).alias("license_file_present"))
    return out.where(F.length("text") >= least).withColumn("text", F.substring("text", 1, most))


def read_atom(spark: SparkSession, path: str, least: int = 100) -> DataFrame:
    """Entries of Atom feeds as records; entries without a summary are left out."""
    return atom_records(spark.read.format("xml").option("rowTag", "entry").schema("id string, title string, summary string").load(path), least)


def atom_records(rows: DataFrame, least: int = 100) -> DataFrame:
    """id, text, source of entries (id, title, summary)."""
    title, summary = strip(F.coalesce("title", F.lit(""))), strip(F.coalesce("summary", F.lit("")))
    text = clean_text(F.when(title != "", F.concat(title, F.lit("\n\n"), summary)).otherwise(summary))
    out = rows.where(summary != "").select(strip(F.coalesce("id", F.lit(""))).alias("id"), text.alias("text"), F.lit("arxiv").alias("source"))
    return out.where(F.length("text") >= least)


_STIX = """struct<objects: array<struct<type: string, name: string, description: string, revoked: boolean, x_mitre_deprecated: boolean,
  kill_chain_phases: array<struct<kill_chain_name: string, phase_name: string>>,
  external_references: array<struct<source_name: string, external_id: string>>>>>"""


def _stix(spark: SparkSession, path: str) -> DataFrame:
    bundles = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("_file"))
    found = bundles.select("_file", F.from_json("value", _STIX).alias("b")).select("_file", F.posexplode("b.objects").alias("_no", "o")).select("_file", "_no", "o.*")
    return found.where((F.col("type") == "attack-pattern") & (F.coalesce("description", F.lit("")) != ""))


def _external(source: str) -> Column:
    match = F.try_element_at(F.filter("external_references", lambda r: r["source_name"] == source), F.lit(1))
    return F.coalesce(match["external_id"], F.lit(""))


def read_techniques(spark: SparkSession, path: str, least: int = 100, most: int | None = 5000) -> DataFrame:
    """The first `most` attack patterns (by file, then place) of STIX bundles that are neither revoked nor deprecated, with
    their phases in a header."""
    on = lambda flag: F.coalesce(F.col(flag), F.lit(False))
    rows = _stix(spark, path).where(~on("revoked") & ~on("x_mitre_deprecated"))
    phases = F.transform(F.filter("kill_chain_phases", lambda p: p["kill_chain_name"] == "mitre-attack"), lambda p: F.coalesce(p["phase_name"], F.lit("")))
    named = F.when(F.coalesce(F.size(phases), F.lit(0)) > 0, F.array_join(phases, ", ")).otherwise("unknown")
    ident, name = _external("mitre-attack"), F.coalesce("name", F.lit(""))
    text = clean_text(F.concat(F.lit("MITRE ATT&CK Technique "), ident, F.lit(": "), name, F.lit("\nTactic: "), named, F.lit("\n\n"), F.col("description")))
    out = rows.select("_file", "_no", first_filled(ident, name).alias("id"), text.alias("text"), F.lit("mitre_attack").alias("source"))
    return first_rows(out.where(F.length("text") >= least), ["_file", "_no"], most).drop("_file", "_no")


def read_attack_patterns(spark: SparkSession, path: str, least: int = 100, most: int | None = 3000) -> DataFrame:
    """The first `most` attack patterns of STIX bundles under their catalogue id."""
    ident, name = _external("capec"), F.coalesce("name", F.lit(""))
    text = clean_text(F.concat(F.lit("CAPEC "), ident, F.lit(": "), name, F.lit("\n\n"), F.col("description")))
    out = _stix(spark, path).select("_file", "_no", first_filled(ident, name).alias("id"), text.alias("text"), F.lit("capec").alias("source"))
    return first_rows(out.where(F.length("text") >= least), ["_file", "_no"], most).drop("_file", "_no")


def read_exploits(spark: SparkSession, index: str, root: str, least: int = 100, most: int = 8000, rows: int | None = 5000) -> DataFrame:
    """The first `rows` (by number) of a CSV index joined to the files they name; texts out of bounds are dropped, not cut."""
    names = "id string, file string, description string, platform string, type string, codes string"
    head = spark.read.option("header", True).option("enforceSchema", False).option("multiLine", True).option("escape", '"').schema(names).csv(index)
    files = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True)
    files = files.select("value", F.regexp_replace(F.col("_metadata.file_path"), r"^.*?\Q" + root.rstrip("/") + r"\E/", "").alias("_path"))
    field = lambda c: F.coalesce(F.col(c), F.lit(""))
    codes = strip(field("codes"))
    header = F.concat(F.lit("Exploit-DB #"), field("id"), F.lit(": "), field("description"), F.lit("\nPlatform: "), field("platform"), F.lit(" / "), field("type"), F.when(codes != "", F.concat(F.lit("\nCVE: "), codes)).otherwise(""))
    both = head.join(files, strip(F.col("file")) == F.col("_path"))
    out = both.select(F.concat(F.lit("edb-"), field("id")).alias("id"), clean_text(F.concat(header, F.lit("\n\n"), F.col("value"))).alias("text"), F.lit("exploitdb").alias("source"), F.try_to_number(F.col("id"), F.lit("999999999")).alias("_no"))
    return first_rows(out.where(F.length("text").between(least, most)), ["_no", "id"], rows).drop("_no")


def writeups(rows: DataFrame, least: int = 200) -> DataFrame:
    """ord, text of dataset rows (ord, text, writeup, content array): the first that is filled, lists joined by a space."""
    text = clean_text(first_filled(F.col("text"), F.col("writeup"), F.array_join("content", " ")))
    return rows.select("ord", text.alias("text")).where(F.length("text") >= least)


def cyclic(rows: DataFrame, order: str, quota: int, n: int) -> DataFrame:
    """n rows repeated in turn up to a quota, with copy (from 0)."""
    ranked = rows.withColumn("_i", F.row_number().over(Window.orderBy(order)) - 1)
    copies = ranked.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(-(-quota // n) - 1))))
    return copies.where(F.col("copy") * n + F.col("_i") < quota).drop("_i")


def merge(sources: list[DataFrame]) -> DataFrame:
    """All sources in order, first copy of each text wins: rank of the source, then place in it, decide."""
    ranked = union_all(*[s.withColumn("src_rank", F.lit(i)).withColumn("line_no", F.monotonically_increasing_id()) for i, s in enumerate(sources)])
    return first_wins(ranked.withColumn("norm_md5", content_hash(F.col("text"))), ["norm_md5"], ["src_rank", "line_no"])
