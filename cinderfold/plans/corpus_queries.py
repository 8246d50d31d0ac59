"""Queries of the corpus and evaluation operators that the catalogue doesn't hold."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cinderfold.functions import codec, model, text
from cinderfold.operators import corpus, evaluation, tokens
from cinderfold.plans.fragments import CLEAN, SPLIT, TOKENS, W
from cinderfold.plans.registry import docs, query, table
from cinderfold.sources import curated
from cinderfold.sources.files import writeups
from cinderfold.sources.scratch import scratch

# Audit


@query(f"SELECT count(*) AS n_rows, CAST(sum(CASE WHEN regexp_replace(t, '{W}+', '', 'g') = '' THEN 1 ELSE 0 END) AS BIGINT) AS n_empty FROM (SELECT repeat(' ', CAST(doc_id % 3 AS INTEGER)) || chr(9) || CASE WHEN doc_id % 4 = 0 THEN '' ELSE coalesce(text, '') END AS t FROM documents)")
def empty_texts(spark, sf_dir):
    padded = F.concat(F.repeat(F.lit(" "), (F.col("doc_id") % 3).cast("int")), F.lit("\t"), F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.coalesce("text", F.lit(""))))
    return docs(spark, sf_dir).select(text.is_empty(padded).alias("e")).agg(F.count("*").alias("n_rows"), F.sum(F.col("e").cast("long")).alias("n_empty"))


_IDS = "CASE WHEN doc_id % 5 = 0 THEN 'DOC-' || doc_id ELSE 'CVE-' || (1999 + doc_id % 27) || '-' || (1000 + doc_id) END"


@query(f"""WITH y AS (SELECT CAST(nullif(regexp_extract(id, 'CVE-(\\d{{4}})-\\d+', 1), '') AS INTEGER) AS b FROM (SELECT {_IDS} AS id FROM documents)), c AS (SELECT b AS bucket, count(*) AS n FROM y WHERE b IS NOT NULL GROUP BY b)
SELECT 'year' AS kind, bucket, n FROM c UNION ALL SELECT 'decade', CAST(bucket // 10 * 10 AS INTEGER), CAST(sum(n) AS BIGINT) FROM c GROUP BY 2 UNION ALL SELECT 'missing', NULL, count(*) FROM y WHERE b IS NULL
UNION ALL SELECT 'span', min(bucket), NULL FROM c UNION ALL SELECT 'span', max(bucket), NULL FROM c UNION ALL SELECT * FROM (SELECT 'top', bucket, n FROM c ORDER BY n DESC, bucket LIMIT 5)""")
def cve_year_audit(spark, sf_dir):
    return corpus.year_audit(docs(spark, sf_dir).select(F.expr(_IDS).alias("id")))


@query(f"WITH {SPLIT} SELECT count(DISTINCT source) AS n_sources, count(DISTINCT CASE WHEN split = 'val' THEN source END) AS n_val FROM parts")
def sources_of_both_splits(spark, sf_dir):
    rows = corpus.split(corpus.dedup(docs(spark, sf_dir), keep=["doc_id", "source"]))
    pairs = rows.select("source", "split").distinct()  # at most two rows a source
    return pairs.agg(F.count_distinct("source").alias("n_sources"), F.count_distinct(F.when(F.col("split") == "val", F.col("source"))).alias("n_val"))


@query("SELECT year, n, row_number() OVER (ORDER BY year) AS place FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders GROUP BY ALL)")
def years_ascending(spark, sf_dir):
    years = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))
    return years.withColumn("place", F.row_number().over(Window.orderBy("year")).cast("long")).orderBy("year")  # one row a year


@query("SELECT source, doc_id FROM documents ORDER BY source, doc_id LIMIT 100")
def early_stop(spark, sf_dir):
    return corpus.first_rows(docs(spark, sf_dir).select("source", "doc_id"), ["source", "doc_id"], 100)


@query(f"WITH {SPLIT} SELECT split, doc_id, md5(text) AS digest FROM parts")
def split_files(spark, sf_dir):
    path = scratch(spark, "split")
    corpus.write_split(corpus.split(corpus.dedup(docs(spark, sf_dir), keep=["doc_id", "text"])), path)
    return spark.read.parquet(path).select("split", "doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"SELECT doc_id AS id, md5(t) AS digest FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '\\A{W}+|{W}+\\z', '', 'g') AS t FROM documents) QUALIFY row_number() OVER (PARTITION BY lower(t) ORDER BY doc_id) = 1")
def unique_texts(spark, sf_dir):
    pad = F.when(F.col("doc_id") % 2 == 1, F.lit("\t\n ")).otherwise(F.lit(""))
    rows = docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.concat(pad, F.coalesce("text", F.lit("")), pad).alias("text"))
    return curated.unique_texts(rows).select("id", F.md5(text.strip(F.col("text")).cast("binary")).alias("digest"))


@query("SELECT doc_id FROM documents")
def seeded_order(spark, sf_dir):
    return curated.seeded_order(docs(spark, sf_dir).select("doc_id"), "doc_id")


@query(f"WITH w AS (SELECT doc_id, {CLEAN.format('CASE WHEN doc_id % 3 = 0 AND text <> $$$$ THEN text WHEN doc_id % 3 = 1 AND text <> $$$$ THEN text ELSE substr(text, 1, 300) || $$ $$ || substr(text, 301, 300) END')} AS t FROM documents) SELECT doc_id, md5(t) AS digest FROM w WHERE length(t) >= 200")
def writeup_rows(spark, sf_dir):
    third = F.col("doc_id") % 3
    rows = docs(spark, sf_dir).select(
        F.col("doc_id").alias("ord"),
        F.when(third == 0, F.col("text")).alias("text"),
        F.when(third == 1, F.col("text")).otherwise(F.lit("")).alias("writeup"),
        F.array(F.substring("text", 1, 300), F.substring("text", 301, 300)).alias("content"),
    )
    return writeups(rows).select(F.col("ord").alias("doc_id"), F.md5(F.col("text").cast("binary")).alias("digest"))


# Tokens


@query("SELECT doc_id, md5(coalesce(text, '')) AS digest, 50257 AS first, 50258 AS last FROM documents")
def token_round_trip(spark, sf_dir):
    import public_tokenizers

    path, ends = public_tokenizers.path("byte_bpe_50k.json"), (model.SPECIAL_IDS["BOS"], model.SPECIAL_IDS["EOS"])
    rows = docs(spark, sf_dir).select("doc_id", codec.encode(F.coalesce("text", F.lit("")), path, *ends).alias("t"))
    return rows.select("doc_id", F.md5(codec.decode(F.col("t"), path, ends).cast("binary")).alias("digest"), F.get("t", F.lit(0)).alias("first"), F.element_at("t", -1).alias("last"))


@query(f"SELECT doc_id, CAST(len(t[-64:]) AS BIGINT) AS n, CAST(coalesce(list_sum(t[-64:]), 0) AS BIGINT) AS total FROM (SELECT doc_id, {TOKENS} AS t FROM documents)")
def last_tokens(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", tokens.last_tokens(tokens.word_lengths(F.col("text")), 64).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n"), F.aggregate("t", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))


@query(f"SELECT doc_id, CAST(w - n AS BIGINT) AS pad_count, CASE WHEN w > n THEN 50259 ELSE t[1] END AS first, CASE WHEN n = 0 THEN CASE WHEN w > 0 THEN 50259 END ELSE t[-1] END AS last FROM (SELECT *, len(t) AS n, max(len(t)) OVER (PARTITION BY doc_id // 8) AS w FROM (SELECT doc_id, {TOKENS} AS t FROM documents))")
def left_padding(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", F.floor(F.col("doc_id") / 8).alias("b"), tokens.word_lengths(F.col("text")).alias("t"))
    out = tokens.padded(rows, "t", "b", model.SPECIAL_IDS["PAD"], left=True)
    return out.select("doc_id", F.col("pad_count").cast("long").alias("pad_count"), F.get("t", F.lit(0)).alias("first"), F.try_element_at("t", F.lit(-1)).alias("last"))


@query("SELECT CAST(b AS BIGINT) AS batch_no, count(*) AS n, min(doc_id) AS least FROM (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 32 AS b FROM documents) GROUP BY b")
def eval_batches(spark, sf_dir):
    return tokens.batches(docs(spark, sf_dir).select("doc_id"), "doc_id", 32, False).groupBy("batch_no").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))


@query("SELECT CAST(b AS BIGINT) AS batch_no, CAST(32 AS BIGINT) AS n FROM range((SELECT count(*) // 32 FROM documents)) r(b)")
def train_batches(spark, sf_dir):
    rows = tokens.shuffled(docs(spark, sf_dir).select("doc_id"), "doc_id", 42)
    return tokens.batches(rows, "place", 32, True).groupBy("batch_no").agg(F.count("*").alias("n"))


# Evaluation and model facts


@query("WITH p AS (SELECT vec_id, unnest(embedding[1:CAST(vec_id % 4 AS INTEGER)]) AS v FROM embeddings) SELECT e.vec_id, round(avg(CAST(p.v AS DOUBLE)), 6) AS score FROM embeddings e LEFT JOIN p ON e.vec_id = p.vec_id GROUP BY e.vec_id")
def mean_log_probability(spark, sf_dir):
    some = F.slice("embedding", 1, (F.col("vec_id") % 4).cast("int"))
    positions = table(spark, sf_dir, "embeddings").select("vec_id", F.explode_outer(some).alias("v")).withColumn("v", F.col("v").cast("double"))
    out = evaluation.mean_log_probability(positions, ["vec_id"], "v")
    return out.select("vec_id", F.round(F.when(F.col("score") > float("-inf"), F.col("score")), 6).alias("score"))


@query("SELECT round(avg(loss), 6) AS mean_loss FROM (SELECT (length(text) % 13) / 10.0::DOUBLE AS loss FROM documents ORDER BY doc_id LIMIT 20)")
def mean_batch_loss(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", (F.length("text") % 13 / F.lit(10.0)).alias("loss"))
    return model.mean_loss(rows, "doc_id").select(F.round("mean_loss", 6).alias("mean_loss"))


@query("""WITH r AS (SELECT doc_id, 'quality' AS task, CAST(doc_id % 2 AS INTEGER) AS predicted, quality AS expected FROM labels UNION ALL SELECT doc_id, 'toxic', CAST(doc_id % 3 // 2 AS INTEGER), toxic FROM labels)
SELECT task, CAST(sum(CASE WHEN predicted = expected THEN 1 ELSE 0 END) AS BIGINT) AS correct, count(*) AS total, md5(string_agg(doc_id || ':' || predicted || ':' || expected, ' ' ORDER BY doc_id, predicted, expected)) AS details FROM r GROUP BY task""")
def accuracy_details(spark, sf_dir):
    rows = table(spark, sf_dir, "labels")
    as_task = lambda name, predicted: rows.select(F.lit(name).alias("task"), "doc_id", predicted.cast("int").alias("predicted"), F.col(name).alias("expected"))
    both = as_task("quality", F.col("doc_id") % 2).unionByName(as_task("toxic", F.floor(F.col("doc_id") % 3 / 2)))
    out = evaluation.details(both.withColumn("correct", F.col("predicted") == F.col("expected")), "doc_id")
    said = F.array_join(F.transform("details", lambda d: F.concat_ws(":", d["doc_id"], d["predicted"], d["expected"])), " ")
    return out.select("task", "correct", "total", F.md5(said.cast("binary")).alias("details"))


@query("SELECT preset, CAST(n AS BIGINT) AS n FROM (VALUES ('tiny', 14708992), ('small', 45173248), ('medium', 124442880)) p(preset, n)")
def exact_parameters(spark, sf_dir):
    rows = spark.createDataFrame([(k, v[0], v[1], v[3]) for k, v in model.PRESETS.items()], "preset string, l long, d long, f long")
    return rows.select("preset", model.exact_parameters(F.col("l"), F.col("d"), F.col("f")).alias("n"))


@query("SELECT name, id FROM (VALUES ('BOS', 50257), ('EOS', 50258), ('PAD', 50259), ('UNK', 50260)) t(name, id)")
def special_ids(spark, sf_dir):
    return spark.createDataFrame(list(model.SPECIAL_IDS.items()), "name string, id int")


@query(f"SELECT doc_id // 2 AS id, min(doc_id) AS first, md5(arg_min(text, doc_id)) AS digest FROM documents GROUP BY 1")
def stream_ingest(spark, sf_dir):
    from cinderfold.streaming.ingest import ingest_stream

    sink, schema = scratch(spark, "sink"), "id long, first long, text string"
    incoming = scratch(spark, "incoming")
    docs(spark, sf_dir).select(F.floor(F.col("doc_id") / 2).alias("id"), F.col("doc_id").alias("first"), "text").write.parquet(incoming)
    for _ in range(2):  # the second run has a checkpoint of its own, reads all again and adds nothing
        ingest_stream(spark.readStream.schema(schema).parquet(incoming), sink, scratch(spark, "checkpoint"), "id", ["first"])
    return spark.read.schema(schema).parquet(sink).select("id", "first", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windowed_counts(spark, sf_dir):
    from cinderfold.streaming.ingest import windowed_counts

    sink = scratch(spark, "windows")
    events = table(spark, sf_dir, "events")
    stream = windowed_counts(spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*"), "ts", "event_type", "value", "1 day", "0 seconds")
    put = lambda batch, _: batch.write.mode("overwrite").parquet(sink)
    stream.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", scratch(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    back = spark.read.schema(stream.schema).parquet(sink)
    return back.select(F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def _run_stream(spark, stream, mode: str):
    """What a finite stream's only batch gives, by way of a table."""
    sink = scratch(spark, "stream")
    put = lambda batch, n: batch.write.mode("append").parquet(sink)
    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", scratch(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(sink)


@query("SELECT DISTINCT user_id FROM events")
def stream_dedup(spark, sf_dir):
    from cinderfold.streaming.ingest import dedup_stream

    events = table(spark, sf_dir, "events")
    return _run_stream(spark, dedup_stream(spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*"), "user_id", "ts", "1000 days"), "append").select("user_id")


@query()
def stream_gate(spark, sf_dir):
    from cinderfold.streaming.ingest import gate_into

    stream = spark.readStream.schema(docs(spark, sf_dir).schema).parquet(f"{sf_dir}/documents.parquet*")
    out = gate_into(stream, scratch(spark, "gate"), scratch(spark, "checkpoint"), "doc_id", "text")
    return out.select(F.col("ord").alias("doc_id"), "accepted", F.round("overlap", 6).alias("overlap"))
