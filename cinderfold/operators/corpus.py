"""Dedup, split, ingest, audit and statistics of a text corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderfold.functions.text import NOT_SPACE, alphabetic, bind, content_hash, cve_year, decade, hash_bucket, is_validation, shingles, words


#: Words of items that may be written into a plan.
KNOWN_WORDS = 4096


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by `order`; partial aggregates keep a frequent key from filling one task."""
    rows = df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row"))
    return rows.select("_row.*")


def dedup(docs: DataFrame, text: str = "text", order: tuple[str, ...] = ("doc_id",), keep: list[Column | str] | None = None) -> DataFrame:
    """The first of all rows whose normal forms are equal, with norm_md5.

    keep: the columns that are asked for (else all); name them, and texts stay out of the shuffle.
    """
    hashed = docs.select(*(docs.columns if keep is None else keep), content_hash(F.col(text)).alias("norm_md5"))
    return first_wins(hashed, ["norm_md5"], list(order))


def split(docs: DataFrame, share: float = 0.05, digest: str = "norm_md5") -> DataFrame:
    """docs with bucket and split (train or val), by content alone: copies never part."""
    docs = docs.withColumn("bucket", hash_bucket(F.col(digest)))
    return docs.withColumn("split", F.when(is_validation(F.col("bucket"), share), "val").otherwise("train"))


def union_all(*tables: DataFrame) -> DataFrame:
    """Rows of all tables; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def ingest(existing: DataFrame, incoming: DataFrame, key: str, order: list[str]) -> DataFrame:
    """existing and the first incoming row of every new key: what is there already wins, and a second run adds nothing."""
    new = first_wins(incoming, [key], order).join(existing.select(key).distinct(), key, "left_anti")
    return union_all(existing.withColumn("origin", F.lit("existing")), new.withColumn("origin", F.lit("new")))


def leaked(probe: DataFrame, other: DataFrame, text: str = "text") -> DataFrame:
    """Rows of probe whose text is in other, by its 128-bit digest: texts themselves aren't shuffled for it. Null is in no other."""
    digest = F.md5(F.col(text).cast("binary")).alias("_h")
    return probe.select("*", digest).join(other.select(digest).distinct(), "_h", "left_semi").drop("_h")


def cap(df: DataFrame, by: str, order: list[str], most: int) -> DataFrame:
    """The first `most` rows of each group with their number rn; a rank limit runs before the shuffle."""
    ranked = df.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return ranked.where(F.col("rn") <= most)


def first_rows(df: DataFrame, order: list[str], most: int | None) -> DataFrame:
    """The first `most` rows by order, as a collector that stops early takes them; all if there's no limit."""
    return df if most is None else df.orderBy(*order).limit(most)


def write_split(parts: DataFrame, path: str) -> None:
    """Write the rows of split() below path in a folder for each split, so that a reader of one never opens the other."""
    parts.write.mode("overwrite").partitionBy("split").parquet(path)


def most_common(df: DataFrame, by: str, order: str) -> DataFrame:
    """by, n, first (the least order), the commonest first; of values that are as common, the one that was seen first."""
    return df.groupBy(by).agg(F.count("*").alias("n"), F.min(order).alias("first")).orderBy(F.desc("n"), "first", by)


def top_words(docs: DataFrame, k: int, order: str = "doc_id", text: str = "text") -> DataFrame:
    """rank, word, n of the k commonest words; of words that are as common, the one that stands first in the corpus.

    order is a whole number; with a place in the text it makes one number, so that the aggregation stays a hashed one.
    """
    start = (F.coalesce(F.col(order), F.lit(-1)).cast("decimal(20,0)") * F.lit(1 << 32)).cast("decimal(38,0)")
    own = docs.select(start.alias("_o"), F.posexplode(words(F.col(text))).alias("_i", "word"))
    counts = own.groupBy("word").agg(F.count("*").alias("n"), F.min((F.col("_o") + F.col("_i")).cast("decimal(38,0)")).alias("_first"))
    top = counts.orderBy(F.desc("n"), "_first").limit(k)
    return top.select(F.row_number().over(Window.orderBy(F.desc("n"), "_first")).alias("rank"), "word", "n")  # of k rows


def year_audit(ids: DataFrame, ident: str = "id", top: int = 5) -> DataFrame:
    """kind, bucket, n: rows by year and decade of their ids, rows without a year (missing, bucket null), the first and
    last year (span, n null) and the `top` commonest years, ties to the earlier."""
    years = ids.groupBy(cve_year(F.col(ident)).alias("bucket")).agg(F.count("*").alias("n"))  # one row a year
    known = years.where("bucket is not null")
    kind = lambda df, name, n="n": df.select(F.lit(name).alias("kind"), F.col("bucket").cast("int").alias("bucket"), F.expr(n).cast("long").alias("n"))
    span = known.agg(F.explode(F.array(F.min("bucket"), F.max("bucket"))).alias("bucket")).where("bucket is not null")
    decades = known.groupBy(decade(F.col("bucket")).alias("bucket")).agg(F.sum("n").alias("n"))
    missing = years.agg(F.lit(None).cast("int").alias("bucket"), F.coalesce(F.sum(F.when(F.col("bucket").isNull(), F.col("n"))), F.lit(0)).alias("n"))
    return union_all(kind(known, "year"), kind(decades, "decade"), kind(missing, "missing"), kind(span, "span", "null"), kind(known.orderBy(F.desc("n"), "bucket").limit(top), "top"))


def duplicates(df: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """Per group: texts that occur more than once, and the rows beyond the first of each."""
    counts = df.groupBy(*by, F.md5(F.col(text).cast("binary")).alias("_h")).count()
    more = F.when(F.col("count") > 1, F.col("count"))
    return counts.groupBy(*by).agg(F.count(more).alias("dup_groups"), F.coalesce(F.sum(more) - F.count(more), F.lit(0)).alias("dup_extra"))


def percentiles(c: Column, ps: tuple[float, ...]) -> list[Column]:
    """Exact inclusive percentiles, truncated to whole numbers after rounding off the interpolation's error."""
    return [F.coalesce(F.round(F.percentile(c, F.lit(p)), 6).cast("long"), F.lit(0)).alias(f"p{round(p * 100)}") for p in ps]


def labelled(text: Column, keywords: dict[str, list[str]]) -> Column:
    """All labels with a keyword in the lower-cased text, or none."""

    def of(low: Column) -> Column:
        return F.array_compact(F.array(*[F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(k)) for k in ks]), F.lit(label)) for label, ks in keywords.items()]))

    found = bind(F.lower(F.coalesce(text, F.lit(""))), of)
    return bind(found, lambda hits: F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit("none"))))


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select(F.explode(words(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def contains_any(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Pairs of document and item whose text the document holds.

    Items of three words or more are looked up by the longest of their inner words, which stand whole in any text that
    holds the item. If the items have at most KNOWN_WORDS such words, texts without any are dropped as they are read, and
    no word of the corpus is shuffled; else the join is by word and only its hits are compared. Shorter items, if there
    are any, are compared with every text.
    """
    cut = lambda c: F.regexp_extract_all(c, F.lit(f"{NOT_SPACE}+"), F.lit(0))
    own = items.where(F.col(text).isNotNull()).select(F.col(item_id), F.col(text).alias("_item"), cut(F.col(text)).alias("_w"))
    inner = F.transform(F.slice("_w", F.lit(2), F.greatest(F.size("_w") - 2, F.lit(0))), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))
    long = own.where(F.size("_w") >= 3).select(item_id, "_item", F.array_max(inner)["w"].alias("_key"))
    texts = docs.where(F.col(text).isNotNull()).select(doc_id, F.col(text).alias("_text"))
    short = own.where((F.size("_w") < 3) & (F.length("_item") > 0)).select(item_id, "_item")
    known = [r["_key"] for r in long.select("_key").distinct().limit(KNOWN_WORDS + 1).collect()]
    if len(known) <= KNOWN_WORDS:
        some = F.array(*map(F.lit, known)) if known else F.array().cast("array<string>")
        held = texts.select(doc_id, "_text", F.array_intersect(cut(F.col("_text")), some).alias("_keys")).where(F.size("_keys") > 0)
        hits = held.select(doc_id, "_text", F.explode("_keys").alias("_key")).join(long, "_key").where(F.contains("_text", "_item")).select(doc_id, item_id)
        return _with_short(hits, texts, short, doc_id, item_id)
    keys = texts.select(doc_id, F.explode(F.array_distinct(cut(F.col("_text")))).alias("_key")).join(long, "_key").select(doc_id, item_id, "_item")
    hits = keys.join(texts, doc_id).where(F.contains("_text", "_item")).select(doc_id, item_id)
    return _with_short(hits, texts, short, doc_id, item_id)


def _with_short(hits: DataFrame, texts: DataFrame, short: DataFrame, doc_id: str, item_id: str) -> DataFrame:
    if short.limit(1).count():
        hits = hits.unionByName(texts.join(short, F.contains("_text", "_item")).select(doc_id, item_id))
    return hits.distinct()


def shingle_overlap(docs: DataFrame, prior: DataFrame, k: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, grams, seen, overlap: the share of a document's distinct shingles that prior texts hold."""
    own = docs.select(doc_id, F.explode_outer(shingles(alphabetic(F.col(text)), k)).alias("_gram"))
    known = prior.select(F.explode(shingles(alphabetic(F.col(text)), k)).alias("_gram")).distinct().withColumn("_hit", F.lit(1))
    counts = own.join(known, "_gram", "left").groupBy(doc_id).agg(F.count("_gram").alias("grams"), F.count("_hit").alias("seen"))
    return counts.withColumn("overlap", F.round(F.col("seen") / F.greatest(F.col("grams"), F.lit(1)), 6))
