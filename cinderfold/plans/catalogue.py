"""All queries of the library outside its llm subpackage, each beside the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinderfold.functions import model, text
from cinderfold.operators import corpus, evaluation, gate, scanner, tokens
from cinderfold.plans.fragments import ALPHA, CLEAN, NORM, NW, SPLIT, TOKENS, WORDS, W
from cinderfold.plans.registry import docs, query, table
from cinderfold.sources import curated, paged
from cinderfold.sources.files import cyclic, select_sources

#: Keywords of categories, and domain terms. Fixed values.
CATEGORIES = {
    "web": ["sql injection", "xss", "csrf", "ssrf", "jwt", "cookie", "http", "web app"],
    "pwn": ["buffer overflow", "rop", "shellcode", "pwntools", "gadget", "libc", "heap"],
    "crypto": ["rsa", "aes", "cipher", "encryption", "decrypt", "hash collision", "oracle"],
    "reverse": ["reverse engineer", "ghidra", "ida", "disassembl", "binary analysis"],
    "forensics": ["pcap", "wireshark", "memory dump", "volatility", "steganograph", "forensic"],
}
TERMS = ["vulnerability", "attacker", "remote", "arbitrary", "overflow", "injection", "execute", "denial", "service", "exploit", "malware", "authentication", "privilege", "escalation", "bypass"]


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source and length of the texts that are left, with their split; texts themselves stay where they are."""
    keep = ["doc_id", "source", F.length("text").cast("long").alias("length")]
    return corpus.split(corpus.dedup(docs(spark, sf_dir), keep=keep))


# Corpus: dedup, split, ingest


@query(f"WITH {SPLIT} SELECT split, count(*) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM parts GROUP BY split")
def corpus_split_summary(spark, sf_dir):
    return parts(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n_docs"), F.sum("length").alias("n_chars"))


@query(f"""SELECT 'documents' AS kind, doc_id AS id, CAST(length(c) AS BIGINT) AS clean_len, md5(c) AS clean_md5 FROM (SELECT doc_id, {CLEAN.format('text')} AS c FROM documents)
UNION ALL SELECT 'pages', page_id, CAST(length(c) AS BIGINT), md5(c) FROM (SELECT page_id, {CLEAN.format('html')} AS c FROM pages)""")
def clean_text_hash(spark, sf_dir):
    out = lambda df, kind, ident, c: df.select(F.lit(kind).alias("kind"), F.col(ident).alias("id"), text.clean_text(F.col(c)).alias("c"))
    both = out(docs(spark, sf_dir), "documents", "doc_id", "text").unionByName(out(table(spark, sf_dir, "pages"), "pages", "page_id", "html"))
    return both.select("kind", "id", F.length("c").cast("long").alias("clean_len"), F.md5(F.col("c").cast("binary")).alias("clean_md5"))


@query(f"WITH {SPLIT} SELECT doc_id, norm_md5 FROM firsts")
def dedup_first_wins(spark, sf_dir):
    return corpus.dedup(docs(spark, sf_dir), keep=["doc_id"])


@query(f"SELECT doc_id, CAST(('0x' || md5({NORM}))::UHUGEINT % 100 AS INTEGER) AS bucket FROM documents")
def hash_bucket(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.hash_bucket(text.content_hash(F.col("text"))).alias("bucket"))


_RULES_SQL = ", ".join(f"('{name}', {lo}, {'NULL' if hi is None else hi}::INTEGER, {'NULL' if cut is None else cut}::INTEGER)" for name, (lo, hi, cut) in text.LENGTHS.items())


@query(f"""SELECT doc_id, rule, n >= least AND (most IS NULL OR n <= most) AS kept, CAST(CASE WHEN NOT (n >= least AND (most IS NULL OR n <= most)) THEN 0 WHEN n > cut THEN cut ELSE n END AS BIGINT) AS out_len
FROM (SELECT doc_id, length({CLEAN.format("text")}) AS n FROM documents), (VALUES {_RULES_SQL}) r(rule, least, most, cut)""")
def min_length_filter(spark, sf_dir):
    clean = docs(spark, sf_dir).select("doc_id", text.nfkd(F.coalesce("text", F.lit(""))).alias("t"))  # decomposed once for all rules
    outs = F.array(*[F.struct(F.lit(name).alias("rule"), text.within_clean(text.clean_ascii(F.col("t")), *rule).alias("out")) for name, rule in text.LENGTHS.items()])
    rows = clean.select("doc_id", F.explode(outs).alias("r"))
    return rows.select("doc_id", "r.rule", F.col("r.out").isNotNull().alias("kept"), F.coalesce(F.length("r.out"), F.lit(0)).cast("long").alias("out_len"))


@query("SELECT source, doc_id, CAST(rn AS INTEGER) AS rn FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 20")
def per_source_cap(spark, sf_dir):
    return corpus.cap(docs(spark, sf_dir).select("source", "doc_id"), "source", ["doc_id"], 20)


@query(f"""WITH {SPLIT}, old AS (SELECT doc_id FROM parts WHERE split = 'val') SELECT doc_id, 'existing' AS origin FROM old UNION ALL SELECT DISTINCT doc_id, 'new' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM old)""")
def anti_join_ingest(spark, sf_dir):
    existing = parts(spark, sf_dir).where("split = 'val'").select("doc_id")
    incoming = docs(spark, sf_dir).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))
    return corpus.ingest(existing, incoming, "doc_id", ["digest"]).select("doc_id", "origin")


_RAW_SPLIT = f"raw AS (SELECT text, CASE WHEN ('0x' || md5({NORM}))::UHUGEINT % 100 < 5 THEN 'val' ELSE 'train' END AS split FROM documents)"


def _raw_split(spark, sf_dir):
    return corpus.split(docs(spark, sf_dir).withColumn("norm_md5", text.content_hash(F.col("text"))))


def _leak(spark, sf_dir, probe, other):
    rows = _raw_split(spark, sf_dir).select("split", "text")
    own = rows.where(F.col("split") == probe)
    n = own.agg(F.count("*").alias(f"n_{probe}"))
    hit = corpus.leaked(own, rows.where(F.col("split") == other)).agg(F.count("*").alias("n_leaked"))
    return n.crossJoin(hit)  # one row each


@query(f"WITH {_RAW_SPLIT} SELECT count(*) AS n_val, CAST(coalesce(sum(CASE WHEN text IN (SELECT text FROM raw WHERE split = 'train') THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_leaked FROM raw WHERE split = 'val'")
def leakage_val_in_train(spark, sf_dir):
    return _leak(spark, sf_dir, "val", "train")


@query(f"WITH {_RAW_SPLIT} SELECT count(*) AS n_train, CAST(coalesce(sum(CASE WHEN text IN (SELECT text FROM raw WHERE split = 'val') THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_leaked FROM raw WHERE split = 'train'")
def leakage_train_in_val(spark, sf_dir):
    return _leak(spark, sf_dir, "train", "val")


@query("SELECT doc_id, item_id FROM documents d, benchmark b WHERE length(b.text) > 0 AND contains(d.text, b.text)")
def benchmark_contamination(spark, sf_dir):
    return corpus.contains_any(docs(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@query("""SELECT source, count(CASE WHEN n > 1 THEN 1 END) AS dup_groups, CAST(coalesce(sum(CASE WHEN n > 1 THEN n - 1 END), 0) AS BIGINT) AS dup_extra FROM (SELECT source, text, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source""")
def exact_dup_stats(spark, sf_dir):
    return corpus.duplicates(docs(spark, sf_dir), ["source"])


@query("""SELECT count(CASE WHEN n > 1 THEN 1 END) AS dup_groups, CAST(coalesce(sum(CASE WHEN n > 1 THEN n - 1 END), 0) AS BIGINT) AS dup_extra FROM (SELECT text, count(*) AS n FROM documents GROUP BY ALL)""")
def cross_source_dups(spark, sf_dir):
    return corpus.duplicates(docs(spark, sf_dir), [])


@query("SELECT source_file, selected FROM (VALUES ('cve', FALSE), ('cve_full', TRUE), ('ctf', TRUE), ('papers', TRUE)) t(source_file, selected)")
def source_supersession(spark, sf_dir):
    return select_sources(spark.createDataFrame([("cve", None), ("cve_full", "cve"), ("ctf", None), ("papers", None)], "source_file string, supersedes string")).select("source_file", "selected")


@query("SELECT i, CAST(g AS INTEGER) AS copy FROM range(15) r(i), range(334) c(g) WHERE g * 15 + i < 5000")
def cyclic_repeat(spark, sf_dir):
    return cyclic(spark.range(15).withColumnRenamed("id", "i"), "i", 5000, 15)


@query("""SELECT source, CASE WHEN c.lang = 'en' THEN 'both' ELSE 'other_only' END AS kind, count(*) AS n FROM (SELECT DISTINCT source, lang FROM documents) c GROUP BY ALL""")
def distinct_sources(spark, sf_dir):
    pairs = docs(spark, sf_dir).select("source", "lang").distinct()
    english = pairs.where("lang = 'en'")
    rest = pairs.exceptAll(english)
    return corpus.union_all(english.withColumn("kind", F.lit("both")), rest.withColumn("kind", F.lit("other_only"))).groupBy("source", "kind").agg(F.count("*").alias("n"))


# Dates


@query("""SELECT CAST(y AS INTEGER) AS year, CAST(strftime(s, '%Y-%m-%d') AS VARCHAR) AS win_start, strftime(least(s + INTERVAL 118 DAY, make_date(y, 12, 31)), '%Y-%m-%d') AS win_end FROM (SELECT y, make_date(y, 1, 1) + INTERVAL (119 * k) DAY AS s FROM range(2015, 2027) a(y), range(4) b(k))""")
def year_windows(spark, sf_dir):
    return spark.createDataFrame([(y, s[:10], e[:10]) for s, e, y in paged.year_windows(2015, 2026)], "year int, win_start string, win_end string")


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST((dayofyear(o_orderdate) - 1) // 119 AS INTEGER) AS win_no, count(*) AS n FROM orders GROUP BY ALL")
def orders_by_window(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year"), paged.window_number(F.col("o_orderdate")).alias("win_no")).agg(F.count("*").alias("n"))


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS bucket, count(*) AS n FROM orders GROUP BY ALL")
def year_histogram(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT CAST(year(o_orderdate) // 10 * 10 AS INTEGER) AS bucket, count(*) AS n FROM orders GROUP BY ALL")
def decade_histogram(spark, sf_dir):
    return year_histogram(spark, sf_dir).groupBy(text.decade(F.col("bucket")).alias("bucket")).agg(F.sum("n").alias("n"))


_CVE_TEXT = "CASE doc_id % 4 WHEN 0 THEN 'CVE-' || (1999 + doc_id % 27) || '-' || doc_id || ' and CVE-1999-1' WHEN 1 THEN 'see CVE-0007-' || doc_id WHEN 2 THEN 'cve-2021-1' END"


@query(f"SELECT doc_id, CAST(nullif(regexp_extract(t, 'CVE-(\\d{{4}})-\\d+', 1), '') AS INTEGER) AS year FROM (SELECT doc_id, {_CVE_TEXT} AS t FROM documents)")
def cve_years(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.cve_year(F.expr(_CVE_TEXT)).alias("year"))


# Audit


@query("SELECT source, " + ", ".join(f"CAST(trunc(round(quantile_cont(length(text), {p / 100}), 6)) AS BIGINT) AS p{p}" for p in (50, 90, 95, 99)) + ", CAST(max(length(text)) AS BIGINT) AS max_len FROM documents GROUP BY source")
def length_percentiles(spark, sf_dir):
    return docs(spark, sf_dir).groupBy("source").agg(*corpus.percentiles(F.length("text"), (0.5, 0.9, 0.95, 0.99)), F.max(F.length("text").cast("long")).alias("max_len"))


@query(f"WITH {SPLIT} SELECT split, count(*) AS n, CAST(sum(length(text)) // count(*) AS BIGINT) AS avg_len, CAST(min(length(text)) AS BIGINT) AS min_len, CAST(max(length(text)) AS BIGINT) AS max_len, CAST(sum(length(text)) // 4 AS BIGINT) AS est_tokens FROM parts GROUP BY split")
def length_summary(spark, sf_dir):
    n = F.col("length")
    return parts(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n"), F.floor(F.sum(n) / F.count("*")).alias("avg_len"), F.min(n).alias("min_len"), F.max(n).alias("max_len"), text.est_tokens(F.sum(n)).alias("est_tokens"))


@query("SELECT source, n, first, row_number() OVER (ORDER BY n DESC, first, source) AS rank FROM (SELECT coalesce(source, 'unknown') AS source, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY ALL)")
def source_histogram(spark, sf_dir):
    counts = corpus.most_common(docs(spark, sf_dir).select(F.coalesce("source", F.lit("unknown")).alias("source"), "doc_id"), "source", "doc_id")
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "first", "source")).cast("long"))  # one row a source


@query("SELECT source, CAST(sum(length(text)) // 4 AS BIGINT) AS est_tokens, round(sum(length(text)) / sum(sum(length(text))) OVER (), 6) AS share FROM documents GROUP BY source")
def token_share(spark, sf_dir):
    per = docs(spark, sf_dir).groupBy("source").agg(F.sum(F.length("text").cast("long")).alias("c"))
    return per.select("source", text.est_tokens(F.col("c")).alias("est_tokens"), F.round(F.col("c") / F.sum("c").over(Window.partitionBy()), 6).alias("share"))


def _category_sql() -> str:
    hits = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS category FROM documents WHERE {' OR '.join(f'contains(lower(text), $${w}$$)' for w in ws)}" for k, ws in CATEGORIES.items())
    return f"WITH hits AS ({hits}), every AS (SELECT doc_id, category FROM hits UNION ALL SELECT doc_id, 'none' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM hits)) SELECT category, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 6) AS share FROM every GROUP BY category"


@query(_category_sql())
def keyword_categories(spark, sf_dir):
    rows = docs(spark, sf_dir)
    total = rows.agg(F.count("*").alias("t"))
    counts = rows.select(F.explode(corpus.labelled(F.col("text"), CATEGORIES)).alias("category")).groupBy("category").agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(total)).select("category", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))  # total is one row


@query(f"""SELECT CAST(rank AS INTEGER) AS rank, word, n FROM (SELECT word, n, row_number() OVER (ORDER BY n DESC, first) AS rank FROM (SELECT word, count(*) AS n, min(doc_id * 4294967296 + i) AS first
FROM (SELECT doc_id, unnest({WORDS}) AS word, generate_subscripts({WORDS}, 1) AS i FROM documents) GROUP BY word)) WHERE rank <= 20""")
def word_freq_topk(spark, sf_dir):
    return corpus.top_words(docs(spark, sf_dir), 20)


@query(f"WITH w AS (SELECT unnest({WORDS}) AS word FROM documents) SELECT t.term, count(w.word) AS n FROM (SELECT unnest({TERMS!r}) AS term) t LEFT JOIN w ON w.word = t.term GROUP BY t.term")
def domain_term_counts(spark, sf_dir):
    terms = spark.createDataFrame([(t,) for t in TERMS], "term string")
    counts = corpus.word_counts(docs(spark, sf_dir)).where(F.col("word").isin(TERMS))
    return terms.join(counts, F.col("term") == F.col("word"), "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH w AS (SELECT unnest({WORDS}) AS word FROM documents) SELECT count(DISTINCT word) AS unique_words, count(*) AS total_words FROM w")
def vocabulary_size(spark, sf_dir):
    return corpus.word_counts(docs(spark, sf_dir)).agg(F.count("*").alias("unique_words"), F.sum("n").alias("total_words"))


@query("""WITH b AS (SELECT min(length(text)) AS lo, max(length(text)) AS hi FROM documents), p AS (SELECT least(CAST(floor(CASE WHEN hi > lo THEN (length(text) - lo) / ((hi - lo) / 50) ELSE 0 END) AS INTEGER), 49) AS bin FROM documents, b WHERE text IS NOT NULL) SELECT bin, count(*) AS n FROM p GROUP BY bin""")
def length_histogram(spark, sf_dir):
    return evaluation.histogram(docs(spark, sf_dir).select(F.length("text").alias("n_")), "n_")


@query(f"WITH {SPLIT} SELECT round(sum(CASE WHEN split = 'val' THEN 1 ELSE 0 END) / greatest(1, sum(CASE WHEN split = 'train' THEN 1 ELSE 0 END)), 6) AS ratio FROM parts")
def split_ratio(spark, sf_dir):
    n = lambda s: F.count(F.when(F.col("split") == s, 1))
    return parts(spark, sf_dir).agg(F.round(n("val") / F.greatest(F.lit(1), n("train")), 6).alias("ratio"))


# Gate


def _gate_sql() -> str:
    banned = " ".join(f"WHEN contains(lower(text), $${p}$$) THEN $$banned:{p}$$" for p in gate.BANNED)
    known = "[" + ", ".join(f"'{k}'" for k in gate.KNOWN_IDS) + "]"
    return rf"""SELECT doc_id, reason = 'ok' AS ok, reason FROM (SELECT doc_id, CASE WHEN n < 120 THEN 'short(' || n || ')' WHEN n > 600 THEN 'long(' || n || ')' {banned}
 WHEN regexp_matches(text, '\bVDB-\d+\b') THEN 'fake_vdb' WHEN len(odd) > 0 THEN 'fake_cve:' || odd[1] ELSE 'ok' END AS reason
 FROM (SELECT doc_id, text, len({WORDS}) AS n, list_filter(regexp_extract_all(text, '\bCVE-\d{{4}}-\d{{4,}}\b'), lambda x: NOT list_contains({known}, x)) AS odd FROM documents))"""


@query(_gate_sql())
def quality_gate(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", gate.reason(F.col("text")).alias("reason")).select("doc_id", (F.col("reason") == "ok").alias("ok"), "reason")


@query(f"""WITH d AS (SELECT doc_id, {ALPHA} AS w FROM documents), g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 4)),
 b AS (SELECT {ALPHA} AS w FROM benchmark), p AS (SELECT DISTINCT array_to_string(w[i:i + 3], ' ') AS gram FROM (SELECT w, unnest(range(1, len(w) - 2)) AS i FROM b WHERE len(w) >= 4))
 SELECT d.doc_id, count(g.gram) AS grams, count(p.gram) AS seen, round(count(p.gram) / greatest(count(g.gram), 1), 6) AS overlap FROM d LEFT JOIN g ON d.doc_id = g.doc_id LEFT JOIN p ON g.gram = p.gram GROUP BY d.doc_id""")
def shingle_containment(spark, sf_dir):
    return corpus.shingle_overlap(docs(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@query("""SELECT doc_id, CASE WHEN u < 0.40::DOUBLE THEN 'first_person_retrospective' WHEN u < 0.40::DOUBLE + 0.25::DOUBLE THEN 'third_person_explanatory' WHEN u < 0.40::DOUBLE + 0.25::DOUBLE + 0.20::DOUBLE THEN 'second_person_walkthrough' WHEN u < 0.40::DOUBLE + 0.25::DOUBLE + 0.20::DOUBLE + 0.10::DOUBLE THEN 'qa_format' ELSE 'scenario' END AS register FROM (SELECT doc_id, CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::UBIGINT AS DOUBLE) / 4294967296.0::DOUBLE AS u FROM documents)""")
def weighted_pick(spark, sf_dir):
    u = F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    return docs(spark, sf_dir).select("doc_id", gate.weighted_pick(u).alias("register"))


@query()
def gate_sequential(spark, sf_dir):
    return gate.sequential(docs(spark, sf_dir))


# Scanner

_LINES = r"lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS code FROM documents), kept AS (SELECT * FROM lines WHERE NOT regexp_matches(code, '^\s*(//|#|\*)'))"
#: RE2 has no lookahead. The one rule with it backs off over white space, so it fails only right before a quote and "<".
_RE2 = [p.replace(r"""\s*(?!['"]<)""", r"""(?:\s|[^'"\s]|['"](?:[^<]|$)|$)""") for _, _, p in scanner.RULES]
_SCAN = ", hits AS (" + " UNION ALL ".join(f"SELECT doc_id, {i} AS rule_id, '{c}' AS category, '{s}' AS severity, len(regexp_extract_all(code, $re$(?i){p}$re$)) AS n FROM kept" for i, ((c, s, _), p) in enumerate(zip(scanner.RULES, _RE2, strict=True))) + ")"


@query(f"WITH {_LINES}{_SCAN} SELECT doc_id, rule_id, category, severity, CAST(sum(n) AS BIGINT) AS n_hits FROM hits WHERE n > 0 GROUP BY ALL")
def code_scan_counts(spark, sf_dir):
    return scanner.rule_counts(docs(spark, sf_dir), "doc_id")


@query(f"WITH {_LINES}{_SCAN} SELECT severity, CAST(sum(n) AS BIGINT) AS n, CASE severity WHEN 'CRITICAL' THEN 'Error' WHEN 'HIGH' THEN 'Warning' ELSE 'Information' END AS level FROM hits WHERE n > 0 GROUP BY severity")
def severity_breakdown(spark, sf_dir):
    return code_scan_counts(spark, sf_dir).groupBy("severity").agg(F.sum("n_hits").alias("n")).withColumn("level", scanner.level(F.col("severity")))


def _findings_sql() -> str:
    """Places from what stands before each match: a lazy prefix and the match, one behind the other, make up a line's start."""
    said = " UNION ALL ".join(f"SELECT doc_id, line, code, {i} AS rule_id, regexp_extract_all(code, $re$(?i)(.*?)(?:{p})$re$, 0) AS upto, regexp_extract_all(code, $re$(?i)(.*?)(?:{p})$re$, 1) AS ahead FROM kept" for i, p in enumerate(_RE2))
    rules = ", ".join(f"({i}, '{c}', '{s}', $m${m}$m$)" for i, ((c, s, _), m) in enumerate(zip(scanner.RULES, scanner.MESSAGES, strict=True)))
    return rf"""WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS code, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line FROM documents),
 kept AS (SELECT * FROM lines WHERE NOT regexp_matches(code, '^\s*(//|#|\*)')), found AS ({said}),
 every AS (SELECT *, unnest(range(1, len(upto) + 1)) AS k FROM found WHERE len(upto) > 0)
 SELECT doc_id, e.rule_id, CAST(line AS INTEGER) AS line, CAST(list_sum(list_transform(upto[1:k - 1], lambda x: length(x))) + length(ahead[k]) + 1 AS INTEGER) AS "column", category, severity, description, regexp_replace(code, '\A{W}+|{W}+\z', '', 'g') AS code
 FROM (SELECT *, CASE WHEN k = 1 THEN 0 END AS z FROM every) e JOIN (VALUES {rules}) r(rule_id, category, severity, description) ON e.rule_id = r.rule_id""".replace("list_sum(list_transform(upto[1:k - 1], lambda x: length(x)))", "coalesce(list_sum(list_transform(upto[1:k - 1], lambda x: length(x))), 0)")


@query(_findings_sql())
def code_scan_findings(spark, sf_dir):
    return scanner.findings(docs(spark, sf_dir), "doc_id")


# Tokens


@query(f"SELECT doc_id, CAST(k AS INTEGER) AS chunk_no, CAST(len(t[k * 960 + 1:k * 960 + 1024]) AS BIGINT) AS chunk_len, t[k * 960 + 1] AS first_tok FROM (SELECT doc_id, t, unnest(range(0, CAST(ceil(greatest(len(t) - 1024, 0) / 960.0) AS BIGINT) + 1)) AS k FROM (SELECT doc_id, {TOKENS} AS t FROM documents))")
def token_chunks(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", F.posexplode(tokens.chunks(tokens.word_lengths(F.col("text")))).alias("chunk_no", "c"))
    return rows.select("doc_id", "chunk_no", F.size("c").cast("long").alias("chunk_len"), F.get("c", F.lit(0)).alias("first_tok"))


@query(f"""WITH t AS (SELECT doc_id, unnest({TOKENS}) AS tok, generate_subscripts({TOKENS}, 1) AS i FROM documents), f AS (SELECT tok, row_number() OVER (ORDER BY doc_id, i) - 1 AS p, lead(tok, 1, -1) OVER (ORDER BY doc_id, i) AS nxt, count(*) OVER () AS n FROM t)
SELECT CAST(p // 128 AS BIGINT) AS idx, CAST(sum(tok) AS BIGINT) AS x_sum, CAST(sum(nxt) AS BIGINT) AS y_sum, CAST(sum(CASE WHEN nxt = -1 THEN 1 ELSE 0 END) AS BIGINT) AS n_pad FROM f WHERE (p // 128 + 1) * 128 <= n GROUP BY 1""")
def packed_samples(spark, sf_dir):
    rows = tokens.packed(docs(spark, sf_dir).select("doc_id", tokens.word_lengths(F.col("text")).alias("t")), "doc_id", "t", 128)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, v: a + v)
    return rows.select("idx", total("x").alias("x_sum"), total("y").alias("y_sum"), F.size(F.filter("y", lambda v: v == tokens.IGNORE)).cast("long").alias("n_pad"))


@query(f"SELECT doc_id, CAST(max(n) OVER (PARTITION BY doc_id // 8) - n AS BIGINT) AS pad_count, CAST(n AS BIGINT) AS mask_sum FROM (SELECT doc_id, len({TOKENS}) AS n FROM documents)")
def batch_padding(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", F.floor(F.col("doc_id") / 8).alias("b"), tokens.word_lengths(F.col("text")).alias("t"))
    out = tokens.padded(rows, "t", "b", model.SPECIAL_IDS["PAD"])
    return out.select("doc_id", F.col("pad_count").cast("long").alias("pad_count"), F.aggregate("mask", F.lit(0).cast("long"), lambda a, v: a + v).alias("mask_sum"))


@query("SELECT CAST(b AS BIGINT) AS batch_no, count(*) AS n FROM (SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 32 AS b FROM documents) GROUP BY b HAVING count(*) = 32")
def batch_assign(spark, sf_dir):
    return tokens.batches(docs(spark, sf_dir).select("doc_id"), "doc_id", 32, True).groupBy("batch_no").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, CAST(n // 128 + CASE WHEN n % 128 >= 2 THEN 1 ELSE 0 END AS BIGINT) AS n_windows, CAST(n // 128 * 127 + CASE WHEN n % 128 >= 2 THEN n % 128 - 1 ELSE 0 END AS BIGINT) AS n_scored FROM (SELECT doc_id, len({TOKENS}) AS n FROM documents)")
def eval_windows(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", tokens.windows(tokens.word_lengths(F.col("text")), 128).alias("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("n_windows"), F.aggregate("w", F.lit(0).cast("long"), lambda a, v: a + F.size(v["y"])).alias("n_scored"))


# Evaluation: scores are made up from ids, as no model runs here


@query(f"SELECT source, round(exp(sum(loss * n) / sum(n)), 6) AS ppl FROM (SELECT source, len({WORDS}) AS n, (length(text) % 13) / 10.0::DOUBLE AS loss FROM documents) WHERE n >= 10 GROUP BY source")
def perplexity(spark, sf_dir):
    rows = docs(spark, sf_dir).select("source", F.size(text.words(F.col("text"))).alias("n"), (F.length("text") % 13 / F.lit(10.0)).alias("loss")).where("n >= 10")
    return rows.groupBy("source").agg(F.round(model.perplexity(F.col("loss"), F.col("n")), 6).alias("ppl"))


@query("SELECT doc_id, label AS predicted FROM (SELECT doc_id, label, row_number() OVER (PARTITION BY doc_id ORDER BY (doc_id * 7 + ord * 13) % 3 DESC, ord) AS r FROM labels, (VALUES (0, 'Critical'), (1, 'High'), (2, 'Medium'), (3, 'Low')) c(ord, label)) WHERE r = 1")
def argmax_label(spark, sf_dir):
    rows = evaluation.candidates(table(spark, sf_dir, "labels").select("doc_id"), evaluation.SEVERITIES)
    return evaluation.argmax_label(rows.withColumn("score", (F.col("doc_id") * 7 + F.col("ord") * 13) % 3), "doc_id")


@query("SELECT task, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS correct, count(*) AS total, round(sum(CASE WHEN ok THEN 1 ELSE 0 END) / count(*), 6) AS accuracy FROM (SELECT 'quality' AS task, quality = doc_id % 2 AS ok FROM labels UNION ALL SELECT 'toxic', toxic = doc_id % 3 // 2 FROM labels) GROUP BY ROLLUP (task)")
def accuracy_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "labels")
    quality = rows.select(F.lit("quality").alias("task"), (F.col("quality") == F.col("doc_id") % 2).alias("correct"))
    toxic = rows.select(F.lit("toxic").alias("task"), (F.col("toxic") == F.floor(F.col("doc_id") % 3 / 2)).alias("correct"))
    return evaluation.accuracy(quality.unionByName(toxic))


@query("""WITH e AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS logit FROM embeddings), r AS (SELECT *, rank() OVER (PARTITION BY vec_id ORDER BY logit DESC) AS rank FROM e)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, round(exp(logit) / sum(exp(logit)) OVER (PARTITION BY vec_id), 6) AS prob FROM r WHERE rank <= 5""")
def topk_softmax(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.explode("embedding").alias("v"))
    return evaluation.top_k_softmax(rows.select("vec_id", F.col("v").cast("double").alias("logit")), "vec_id", 5).select("vec_id", "rank", F.round("prob", 6).alias("prob"))


@query("SELECT CAST(s AS BIGINT) AS step, round(CASE WHEN s < 2000 THEN 3e-4::DOUBLE * (s + 1) / 2000 ELSE 1e-5::DOUBLE + (3e-4::DOUBLE - 1e-5::DOUBLE) * 0.5 * (1 + cos(pi() * least((s - 2000) / 8000, 1))) END, 12) AS lr FROM range(0, 12001, 50) t(s)")
def lr_schedule(spark, sf_dir):
    return spark.range(0, 12001, 50).select(F.col("id").alias("step"), F.round(model.learning_rate(F.col("id")), 12).alias("lr"))


@query("SELECT preset, CAST(2 * 50261 * d + l * (4 * d * d + 2 * d + 2 * d * f + d + f + 4 * d) AS BIGINT) AS n, round((2 * 50261 * d + l * (4 * d * d + 2 * d + 2 * d * f + d + f + 4 * d)) / 1e6)::BIGINT || 'M' AS size FROM (VALUES ('tiny', 2, 256, 1024), ('small', 6, 512, 2048), ('medium', 12, 768, 3072)) p(preset, l, d, f)")
def param_count(spark, sf_dir):
    rows = spark.createDataFrame([(k, v[0], v[1], v[3]) for k, v in model.PRESETS.items()], "preset string, l long, d long, f long")
    return rows.select("preset", model.parameters(F.col("l"), F.col("d"), F.col("f")).alias("n")).withColumn("size", model.readable(F.col("n")))


_LOG_SQL = "(SELECT user_id AS run, event_id AS step, floor(value) / 4 AS val_loss, CASE WHEN event_id % 9 = 0 THEN 'complete' END AS status FROM events) l"


def _log(spark, sf_dir):
    """A made-up log of as many runs as there are users."""
    rows = table(spark, sf_dir, "events")
    return rows.select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), (F.floor("value") / 4).alias("val_loss"), F.when(F.col("event_id") % 9 == 0, "complete").alias("status"))


@query(f"SELECT run, step, min(val_loss) OVER (PARTITION BY run ORDER BY step) AS best, coalesce(val_loss < min(val_loss) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS is_best FROM {_LOG_SQL}")
def best_so_far(spark, sf_dir):
    return evaluation.best_so_far(_log(spark, sf_dir), by=["run"]).select("run", "step", "best", "is_best")


@query(f"SELECT run, coalesce(arg_max(val_loss, step) FILTER (WHERE status = 'complete'), arg_max(val_loss, step)) AS final_loss FROM {_LOG_SQL} GROUP BY run")
def final_metric(spark, sf_dir):
    return _log(spark, sf_dir).groupBy("run").agg(evaluation.final_metric(F.col("val_loss"), F.col("status"), F.col("step")).alias("final_loss"))


@query("""WITH l AS (SELECT lang AS phase, doc_id, (length(text) % 13) / 10.0::DOUBLE AS val_loss, doc_id % 50 = 0 AS done FROM documents), f AS (SELECT phase, coalesce(arg_max(val_loss, doc_id) FILTER (WHERE done), arg_max(val_loss, doc_id)) AS val_loss FROM l GROUP BY phase),
 t AS (SELECT lang AS phase, round(avg(CASE WHEN quality = doc_id % 2 THEN 1 ELSE 0 END), 6) AS accuracy FROM documents JOIN labels USING (doc_id) WHERE lang <> 'en' GROUP BY lang) SELECT f.phase, val_loss, accuracy FROM f LEFT JOIN t ON f.phase = t.phase""")
def phase_comparison(spark, sf_dir):
    rows = docs(spark, sf_dir).withColumnRenamed("lang", "phase")
    log = rows.select("phase", "doc_id", (F.length("text") % 13 / F.lit(10.0)).alias("val_loss"), F.when(F.col("doc_id") % 50 == 0, "complete").alias("status"))
    final = log.groupBy("phase").agg(evaluation.final_metric(F.col("val_loss"), F.col("status"), F.col("doc_id")).alias("val_loss"))
    answers = rows.select("phase", "doc_id").join(table(spark, sf_dir, "labels"), "doc_id").where("phase <> 'en'")  # one phase has no results
    right = answers.groupBy("phase").agg(F.round(F.avg((F.col("quality") == F.col("doc_id") % 2).cast("int")), 6).alias("accuracy"))
    return final.join(right, "phase", "left")


@query(f"""WITH r AS (SELECT source, len({WORDS}) AS n, (length(text) % 13) / 10.0::DOUBLE AS loss, (length(text) % 11) / 9.0::DOUBLE AS other FROM documents), p AS (SELECT source, round(exp(sum(loss * n) / sum(n)), 6) AS ppl, round(exp(sum(other * n) / sum(n)), 6) AS baseline FROM r GROUP BY source)
SELECT source, CASE WHEN ppl < baseline THEN 'better' ELSE 'not better' END AS verdict, ppl, baseline FROM p""")
def baseline_verdict(spark, sf_dir):
    rows = docs(spark, sf_dir).select("source", F.size(text.words(F.col("text"))).alias("n"), (F.length("text") % 13 / F.lit(10.0)).alias("loss"), (F.length("text") % 11 / F.lit(9.0)).alias("other"))
    per = rows.groupBy("source").agg(F.round(model.perplexity(F.col("loss"), F.col("n")), 6).alias("ppl"), F.round(model.perplexity(F.col("other"), F.col("n")), 6).alias("baseline"))
    return per.select("source", evaluation.verdict(F.col("ppl"), F.col("baseline")).alias("verdict"), "ppl", "baseline")


@query("SELECT conv_id, turn, contains(lower(text), 'en') OR contains(lower(text), 'the') AS hit FROM conversations")
def answer_hits(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", evaluation.names_any(F.col("text"), F.lit("EN"), F.lit("The"), F.lit("")).alias("hit"))


@query("SELECT CASE WHEN a < b THEN 'better' ELSE 'not better' END AS verdict, a AS ppl, b AS baseline FROM (SELECT 142.09::DOUBLE AS a, 26.76::DOUBLE AS b)")
def baseline_verdict(spark, sf_dir):
    own = spark.createDataFrame([("x", 142.09)], "texts string, ppl double").join(spark.createDataFrame([("x", 26.76)], "texts string, baseline double"), "texts")
    return own.select(F.when(F.col("ppl") < F.col("baseline"), "better").otherwise("not better").alias("verdict"), "ppl", "baseline")


@query("SELECT conv_id, turn, reply FROM (SELECT conv_id, turn, CASE WHEN starts_with(text, substr(text, 1, 5)) THEN regexp_replace(substr(text, 6), '\\A\\s+|\\s+\\z', '', 'g') END AS reply FROM conversations)")
def prompt_strip(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.strip_prompt(F.col("text"), F.substring("text", 1, 5)).alias("reply"))


# Built-in records


@query("SELECT id, CAST(count(*) AS BIGINT) AS n FROM (SELECT " + "[" + ", ".join(f"'{w[0]}'" for w in curated.WEAKNESSES) + "][i % 15 + 1] AS id FROM range(5000) r(i)) GROUP BY id")
def curated_weaknesses(spark, sf_dir):
    return curated.weaknesses(spark).groupBy("id").agg(F.count("*").alias("n"))


@query("SELECT id, CAST(count(*) AS BIGINT) AS n FROM (SELECT " + "[" + ", ".join(f"'{w[0]}'" for w in curated.RISKS) + "][i % 10 + 1] AS id FROM range(2000) r(i)) GROUP BY id")
def curated_risks(spark, sf_dir):
    return curated.risks(spark).groupBy("id").agg(F.count("*").alias("n"))


@query("SELECT 't-' || i AS id, CASE WHEN i % 2 = 0 THEN 'pattern ' || i ELSE 'another pattern' END AS text FROM range(200) r(i)")
def template_fallback(spark, sf_dir):
    return curated.from_templates(spark, ["pattern {n}", "another pattern"], 200, "t-", "made").select("id", "text")
