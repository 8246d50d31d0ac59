"""Chunks, padding, packing and windows of token arrays. The codec is any expression that gives ARRAY<INT>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderfold.functions.text import bind, words

IGNORE = -1
#: Ordinals of so many consecutive values share a bucket of the running token count.
ORDINALS_A_BUCKET = 4096


def word_lengths(text: Column) -> Column:
    """A codec that any engine can repeat: each word's length."""
    return F.transform(words(text), F.length)


def chunks(tokens: Column, size: int = 1024, overlap: int = 64) -> Column:
    """Overlapping slices; the last one reaches the end, and a short text is one."""
    stride = size - overlap

    def of(t: Column) -> Column:
        last = F.greatest(F.size(t) - size, F.lit(0)) + stride - 1
        return F.transform(F.sequence(F.lit(0), (F.floor(last / stride) * stride).cast("int"), F.lit(stride)), lambda i: F.slice(t, i + 1, size))

    return bind(tokens, of)


def padded(df: DataFrame, tokens: str, batch: str, pad: int, left: bool = False) -> DataFrame:
    """df with tokens filled up to its batch's longest, pad_count and a 0/1 mask."""
    most = F.max(F.size(tokens)).over(Window.partitionBy(batch))
    df = df.withColumn("pad_count", (most - F.size(tokens)).cast("int"))
    fill, ones = F.array_repeat(F.lit(pad), F.col("pad_count")), F.array_repeat(F.lit(1), F.size(tokens))
    zeros = F.array_repeat(F.lit(0), F.col("pad_count"))
    out, mask = (F.concat(fill, F.col(tokens)), F.concat(zeros, ones)) if left else (F.concat(F.col(tokens), fill), F.concat(ones, zeros))
    return df.withColumn("mask", mask).withColumn(tokens, out)


def placed(df: DataFrame, ordinal: str, tokens: str) -> DataFrame:
    """_start (tokens of all documents before), _n, _t (tokens) of every document in one stream of all.

    Running counts are summed per bucket of ordinals first, so no task orders the whole corpus.
    """
    sized = df.select(F.col(ordinal).alias("_o"), F.col(tokens).alias("_t"), F.size(tokens).cast("long").alias("_n"), F.floor(F.col(ordinal) / ORDINALS_A_BUCKET).alias("_b"))
    ahead = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = sized.groupBy("_b").agg(F.sum("_n").alias("_in")).select("_b", F.coalesce(F.sum("_in").over(ahead), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_b").orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)
    return sized.withColumn("_at", F.sum("_n").over(within) - F.col("_n")).join(buckets, "_b").select((F.col("_base") + F.col("_at")).alias("_start"), "_n", "_t")


def packed(df: DataFrame, ordinal: str, tokens: str, context: int) -> DataFrame:
    """idx, x, y of the whole samples of the stream; y is x moved on by one, IGNORE past the end.

    A document is cut where samples end, and the cuts are what is shuffled; the token behind a sample comes along as one
    more cut.
    """
    rows = placed(df, ordinal, tokens).where("_n > 0")
    first, last = F.floor(F.col("_start") / context), F.floor((F.col("_start") + F.col("_n") - 1) / context)
    cuts = rows.select("_start", "_t", F.explode(F.sequence(first, last)).alias("idx")).withColumn("_from", F.greatest(F.col("idx") * context, F.col("_start")))
    at = (F.col("_from") - F.col("_start") + 1).cast("int")
    room = ((F.col("idx") + 1) * context - F.col("_from")).cast("int")
    own = F.struct(F.col("idx"), F.col("_from").alias("place"), F.slice("_t", at, room).alias("t"))
    behind = F.struct((F.col("idx") - 1).alias("idx"), F.col("_from").alias("place"), F.slice("_t", at, 1).alias("t"))
    both = cuts.select(F.inline(F.when((F.col("_from") == F.col("idx") * context) & (F.col("idx") > 0), F.array(own, behind)).otherwise(F.array(own))))
    flat = both.groupBy("idx").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("place", "t"))), lambda c: c["t"])).alias("t"))  # context + 1 tokens at most
    y = F.slice("t", 2, context)
    return flat.where(F.size("t") >= context).select("idx", F.slice("t", 1, context).alias("x"), F.concat(y, F.array_repeat(F.lit(IGNORE), F.lit(context) - F.size(y))).alias("y"))


def shuffled(df: DataFrame, ident: str, seed: int, buckets: int = 1 << 16) -> DataFrame:
    """df with `place`, an order that hangs on the id and the seed alone and that batches() takes as its order: a hash in
    some buckets' worth of ordinals."""
    return df.withColumn("place", F.pmod(F.xxhash64(F.col(ident), F.lit(seed)), F.lit(buckets * ORDINALS_A_BUCKET)))


def batches(df: DataFrame, order: str, size: int, drop_last: bool) -> DataFrame:
    """df with batch_no by order (whole numbers); drop_last leaves out a batch that isn't full, as training does, else the
    last one is as long as it is, as evaluation does. Ties of the order are in no order."""
    ranked = df.withColumn("_b", F.floor(F.col(order) / ORDINALS_A_BUCKET))
    ahead = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = ranked.groupBy("_b").count().select("_b", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("_base"))
    place = F.col("_base") + F.row_number().over(Window.partitionBy("_b").orderBy(order)) - 1
    numbered = ranked.join(buckets, "_b").withColumn("batch_no", F.floor(place / size)).drop("_b", "_base")
    if not drop_last:
        return numbered
    whole = numbered.groupBy("batch_no").count().where(F.col("count") == size).select("batch_no")
    return numbered.join(whole, "batch_no", "left_semi")


def windows(tokens: Column, context: int) -> Column:
    """(x, y) of consecutive chunks of at most context tokens; chunks below 2 tokens are left out."""

    def of(t: Column) -> Column:
        starts = F.when(F.size(t) >= 2, F.sequence(F.lit(0), F.greatest(F.size(t) - 2, F.lit(0)), F.lit(context))).otherwise(F.array().cast("array<int>"))
        cut = F.filter(F.transform(starts, lambda i: F.slice(t, i + 1, context)), lambda c: F.size(c) >= 2)
        return F.transform(cut, lambda c: F.struct(F.slice(c, 1, F.size(c) - 1).alias("x"), F.slice(c, 2, F.size(c) - 1).alias("y")))

    return bind(tokens, of)


def last_tokens(tokens: Column, context: int) -> Column:
    return F.when(F.size(tokens) > context, F.slice(tokens, -context, context)).otherwise(tokens)
