"""Mixing sources to target weights as a curriculum that varies over training time.

Every source has a weight schedule over training time 0 to 1, linear between knots. Its integral, times the source's
target, is the source's cumulative demand for words; inverting it turns a document's place in its source's own shuffled
order into a training position. Documents are range-sorted by position. Sources repeat whole documents, at most MOST
times, and end as near their target as whole documents allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinderfold.llm.common import load, row_key, small, written

MOST = 3
WEIGHTS = (1, 2, 3)
SEED = "mix-1"
SWAPS = 2
WORD = r"[^\x20\x09-\x0D]+"
#: Knots (time, weight) of the schedules, dealt to the sources in turn: even, rising, falling, late hump.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (0.5, 0.5), (0.75, 2.0), (1.0, 1.0)))
#: First two hex digits' worth of buckets, squared: a source's running sum is taken in 65536 parts.
_BUCKET_DIGITS = 4


def integrate(knots: tuple[tuple[float, float], ...]) -> list[tuple[float, float, float, float, float, float]]:
    """Pieces (t0, t1, w0, w1, share before, share behind) of a schedule whose whole integral counts as 1."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False)]
    total, done, out = sum(areas), 0.0, []
    for (t0, w0), (t1, w1), area in zip(knots, knots[1:], areas, strict=False):
        out.append((t0, t1, w0 / total, w1 / total, done / total, (done + area) / total))
        done += area
    return out


def position(share: Column, schedule: Column, schedules: tuple = SCHEDULES) -> Column:
    """Training time at which a source's demand reaches a share (0 to 1) of its target; schedule: index into schedules."""
    out = F.lit(None).cast("double")
    for i, knots in reversed(list(enumerate(schedules))):
        inner = F.lit(float(knots[-1][0]))
        for t0, t1, w0, w1, before, behind in reversed(integrate(knots)):
            slope = (w1 - w0) / (t1 - t0)
            over = share - F.lit(before)
            t = F.lit(t0) + F.lit(2.0) * over / (F.lit(w0) + F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * over, F.lit(0.0))))
            inner = F.when(share < F.lit(behind), t).otherwise(inner)
        out = F.when(schedule == i, inner).otherwise(out)
    return out


def source_targets(sources: DataFrame, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, nth, target from (source, source_size), one row a source.

    Sources by code point, null last, weigh `weights` in turn and share the sum of all sizes; no target is above most
    times its source's size, and what is over is shared anew by weight until none is. All but the last division is in
    whole numbers. One task sorts the sources; there is one row for each.
    """
    nth = Window.orderBy(F.asc_nulls_last("source"))
    low = Window.orderBy("_ratio", "nth")
    rest, done = low.rowsBetween(0, Window.unboundedFollowing), low.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int")).cast("decimal(38,0)")
    s = sources.select("source", F.col("source_size").cast("decimal(20,0)").alias("_s")).withColumn("nth", (F.row_number().over(nth) - 1).cast("int"))
    s = s.withColumn("_w", weight).withColumn("_ratio", F.col("_s").cast("double") / F.col("_w").cast("double"))
    s = s.withColumn("_all", F.sum("_s").over(everything)).withColumn("_rest", F.sum("_w").over(rest)).withColumn("_done", F.coalesce(F.sum("_s").over(done), F.lit(0)))
    big = "decimal(38,0)"
    s = s.withColumn("_full", (most * F.col("_s") * F.col("_rest")).cast(big) <= (F.col("_w") * (F.col("_all") - most * F.col("_done"))).cast(big))
    s = s.withColumn("_left", F.col("_all") - most * F.coalesce(F.sum(F.when(F.col("_full"), F.col("_s"))).over(everything), F.lit(0)))
    s = s.withColumn("_open", F.sum(F.when(~F.col("_full"), F.col("_w"))).over(everything))
    shared = (F.col("_left") * F.col("_w")).cast("double") / F.col("_open").cast("double")
    return s.select("source", F.col("_s").cast("long").alias("source_size"), "nth", F.when(F.col("_full"), (most * F.col("_s")).cast("double")).otherwise(shared).alias("target"))


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the whole text; null: 0) and the row's key; other columns are not read."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), *row_key())


def mix(sized: DataFrame, most: int = MOST, weights: tuple[int, ...] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """doc_id, source, k1, k2, size, source_size, nth, target, before, times, taken of every row of sizes().

    A source's order is that of md5(seed and doc_id), ties by size and key. It passes target // source_size times whole;
    then documents up to the one whose middle is beyond the rest of the target; then SWAPS times the one document whose
    coming in or going out brings the sum nearest to the target changes sides. Sources of size 0 give 0. Running sums are taken per
    source and hash bucket, so a source with most of the rows is spread over many tasks.
    """
    sized = sized.withColumn("_o", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")))
    sized = sized.withColumn("_b", F.substring("_o", 1, _BUCKET_DIGITS))
    sources = written(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), most, weights), "sources", narrow=True)
    n_sources = sources.count()
    buckets = sized.groupBy("source", "_b").agg(F.sum("size").alias("_in"))
    buckets = buckets.join(sources, buckets["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    ahead = Window.partitionBy("nth").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("_base", F.coalesce(F.sum("_in").over(ahead), F.lit(0))).withColumnsRenamed({"source": "_src", "_b": "_bkt"})
    rows = sized.join(buckets, sized["source"].eqNullSafe(buckets["_src"]) & (F.col("_b") == F.col("_bkt")))
    within = Window.partitionBy("nth", "_b").orderBy("_o", "size", "k1", "k2")
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    rows = (
        rows.withColumn("before", F.col("_base") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("_rank", F.row_number().over(within))
        .withColumn("_full", full)
        .withColumn("_rest", F.col("target") - F.col("_full") * F.col("source_size"))
        .withColumn("_in", (2 * F.col("before") + F.col("size")) <= 2 * F.col("_rest"))
        .select("doc_id", "source", "k1", "k2", "size", "source_size", "nth", "target", "before", "_b", "_o", "_rank", "_full", "_rest", "_in")
    )
    rows = written(rows, "mix", narrow=True)
    for _ in range(SWAPS):
        rows = _swapped(rows, most, n_sources)
    times = F.col("_full") + F.col("_in").cast("int")
    return rows.withColumn("times", times).select("doc_id", "source", "k1", "k2", "size", "source_size", "nth", "target", "before", "times", (F.col("times") * F.col("size")).alias("taken"))


def _swapped(rows: DataFrame, most: int, n_sources: int) -> DataFrame:
    """rows with the one document of each source on the other side (_in) that brings its sum nearest to the target.

    One row a source is joined to them: by broadcast where sources are few enough.
    """
    off = rows.groupBy("nth").agg((F.max("_rest") - F.sum(F.when(F.col("_in"), F.col("size")).otherwise(0))).alias("_off")).select(F.col("nth").alias("_n"), "_off")
    gap = F.abs(F.when(F.col("_in"), F.col("_off") + F.col("size")).otherwise(F.col("_off") - F.col("size")))
    swap = (
        rows.join(small(off, n_sources), F.col("nth") == F.col("_n"))
        .where((gap < F.abs("_off")) & (F.col("_full") < most))
        .groupBy("nth")
        .agg(F.min(F.struct(gap.alias("gap"), F.col("_o").alias("o"), F.col("_rank").alias("rank"), F.col("_b").alias("b"))).alias("_swap"))
        .select(F.col("nth").alias("_n"), "_swap")
    )
    chosen = F.coalesce((F.col("_swap.b") == F.col("_b")) & (F.col("_swap.rank") == F.col("_rank")), F.lit(False))
    return rows.join(small(swap, n_sources), F.col("nth") == F.col("_n"), "left").withColumn("_in", F.col("_in") != chosen).select(*rows.columns)


def curriculum(mixed: DataFrame, schedules: tuple = SCHEDULES) -> DataFrame:
    """One row for each time a document is taken, with epoch (from 0) and position (0 to 1) in training.

    Demand for a source grows as the integral of its schedule; a document's turn comes where demand reaches the words
    that its source has given before it. Positions follow the target, so sources keep their schedule's pace.
    """
    demand = (F.col("epoch") * F.col("source_size") + F.col("before")) / F.greatest(F.col("target"), F.lit(1.0))
    turns = mixed.where(F.col("times") > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    return turns.withColumn("position", position(F.least(demand, F.lit(1.0)), F.col("nth") % len(schedules), schedules))


def in_sequence(turns: DataFrame) -> DataFrame:
    """turns of curriculum(), range-sorted by training position; ties go by key and epoch."""
    by = [c for c in ("position", "k1", "k2", "epoch") if c in turns.columns]
    return turns.repartitionByRange(*by).sortWithinPartitions(*by)


def in_training_order(docs: DataFrame, schedules: tuple = SCHEDULES) -> DataFrame:
    """docs' own columns, each row as often as the mix takes it, range-sorted by training position.

    Rows that are equal in doc_id and text count as copies of the first among them. Documents without words have no
    place in a mix by words and are kept once, at the place of the words before them.
    """
    turns = curriculum(mix(sizes(docs)).withColumn("times", F.when(F.col("size") == 0, 1).otherwise(F.col("times"))), schedules)
    turns = turns.select("k1", "k2", "position")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), *row_key()).dropDuplicates(["k1", "k2"])
    return in_sequence(keyed.join(turns, ["k1", "k2"])).select("row.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, source size, target, words taken and first training position of every document.

    Words and first position are read from the curriculum's range-sorted sequence, which is written. A document that is
    never taken stands where its source's demand would reach it.
    """
    mixed = mix(written(sizes(load(spark, sf_dir, "documents")), "sizes"))
    mixed = written(mixed.withColumn("row", F.monotonically_increasing_id()), "mixed", narrow=True)  # repeated rows have turns of their own
    turns = written(in_sequence(curriculum(mixed).select("row", "k1", "k2", "epoch", "size", "position")), "sequence")
    given = turns.groupBy("row").agg(F.sum("size").alias("_given"), F.min("position").alias("_first"))
    never = position(F.least(F.col("before") / F.greatest(F.col("target"), F.lit(1.0)), F.lit(1.0)), F.col("nth") % len(SCHEDULES))
    out = mixed.join(given, "row", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("_given", F.lit(0)).cast("long").alias("taken"), F.round(F.coalesce("_first", never), 6).alias("first_position"))


def _position_sql(share: str, schedule: str) -> str:
    cases = []
    for i, knots in enumerate(SCHEDULES):
        inner = "CASE"
        for t0, t1, w0, w1, before, behind in integrate(knots):
            slope = (w1 - w0) / (t1 - t0)
            over = f"({share} - {before!r}::DOUBLE)"
            inner += f" WHEN {share} < {behind!r}::DOUBLE THEN {t0!r}::DOUBLE + 2.0::DOUBLE * {over} / ({w0!r}::DOUBLE + sqrt(greatest({w0 * w0!r}::DOUBLE + {2 * slope!r}::DOUBLE * {over}, 0.0::DOUBLE)))"
        cases.append(f"WHEN {schedule} = {i} THEN {inner} ELSE {float(knots[-1][0])!r}::DOUBLE END")
    return f"CASE {' '.join(cases)} END"


_SWAP_SQL = "".join(
    f""", e{k} AS (
  SELECT *, max(r) OVER (PARTITION BY nth) - CAST(sum(CASE WHEN i THEN size ELSE 0 END) OVER (PARTITION BY nth) AS BIGINT) AS e FROM {f"s{k - 1}" if k > 1 else "chosen"}
), g{k} AS (
  SELECT *, abs(CASE WHEN i THEN e + size ELSE e - size END) AS gap FROM e{k}
), c{k} AS (
  SELECT *, gap < abs(e) AND f < 3 AS can FROM g{k}
), s{k} AS (
  SELECT * EXCLUDE (e, gap, can, i), i <> (can AND row_number() OVER (PARTITION BY nth ORDER BY CASE WHEN can THEN 0 ELSE 1 END, gap, o) = 1) AS i FROM c{k}
)"""
    for k in range(1, SWAPS + 1)
)

OP3_SQL = f"""
WITH base AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS o
  FROM documents
), src AS (
  SELECT source, CAST(sum(size) AS HUGEINT) AS s, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM base GROUP BY source
), w AS (
  SELECT *, CAST(nth % 3 + 1 AS HUGEINT) AS w, sum(s) OVER () AS total FROM src
), low AS (
  SELECT *, sum(w) OVER (ORDER BY CAST(s AS DOUBLE) / CAST(w AS DOUBLE), nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
         coalesce(sum(s) OVER (ORDER BY CAST(s AS DOUBLE) / CAST(w AS DOUBLE), nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done
  FROM w
), capped AS (SELECT *, 3 * s * rest <= w * (total - 3 * done) AS cap FROM low
), targets AS (
  SELECT source, CAST(s AS BIGINT) AS source_size, nth,
         CASE WHEN cap THEN CAST(3 * s AS DOUBLE)
              ELSE CAST((total - 3 * coalesce(sum(CASE WHEN cap THEN s END) OVER (), 0)) * w AS DOUBLE) / CAST(sum(CASE WHEN NOT cap THEN w END) OVER () AS DOUBLE) END AS target
  FROM capped
), placed AS (
  SELECT doc_id, size, source_size, target, nth, o,
         sum(size) OVER (PARTITION BY nth ORDER BY o, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before,
         CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS INTEGER) ELSE 0 END AS f
  FROM base JOIN targets ON base.source IS NOT DISTINCT FROM targets.source
), chosen AS (
  SELECT *, target - f * source_size AS r, 2 * before + size <= 2 * (target - f * source_size) AS i FROM placed
){_SWAP_SQL}
SELECT doc_id, size, source_size, target, CAST((f + CASE WHEN i THEN 1 ELSE 0 END) * size AS BIGINT) AS taken,
       round({_position_sql("least(before / greatest(target, 1.0), 1.0::DOUBLE)", "nth % 4")}, 6) AS first_position
FROM s{SWAPS}
"""
