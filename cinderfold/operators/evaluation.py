"""Metrics of model evaluation over scores that a scorer has put into columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderfold.functions.text import bind

#: Labels in the order that breaks ties. Fixed values.
SEVERITIES = ["Critical", "High", "Medium", "Low"]


def candidates(samples: DataFrame, labels: list[str]) -> DataFrame:
    """Each sample with every label and the label's place; labels are a literal list, so nothing is joined."""
    return samples.select("*", F.posexplode(F.array(*map(F.lit, labels))).alias("ord", "label"))


def mean_log_probability(positions: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean over a candidate's positions; no positions: minus infinity."""
    return positions.groupBy(*by).agg(F.coalesce(F.avg(value), F.lit(float("-inf"))).alias("score"))


def argmax_label(scored: DataFrame, by: str) -> DataFrame:
    """by, predicted: the best label; the first wins ties, and a score that isn't a number loses to all."""
    score = F.nanvl(F.col("score").cast("double"), F.lit(float("-inf")))
    return scored.groupBy(by).agg(F.max_by("label", F.struct(score, -F.col("ord"))).alias("predicted"))


def accuracy(results: DataFrame, by: str = "task") -> DataFrame:
    """correct, total and accuracy for each task and, with null, for all."""
    return results.rollup(by).agg(F.sum(F.col("correct").cast("long")).alias("correct"), F.count("*").alias("total")).withColumn("accuracy", F.round(F.col("correct") / F.col("total"), 6))


def details(results: DataFrame, order: str, by: str = "task") -> DataFrame:
    """accuracy() of each task with the list of its samples (order, predicted, expected, correct), in order."""
    rows = results.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(order, "predicted", "expected", "correct"))).alias("details"))
    own = F.aggregate("details", F.lit(0).cast("long"), lambda n, d: n + d["correct"].cast("long"))
    return rows.select(by, own.alias("correct"), F.size("details").cast("long").alias("total"), (own / F.size("details")).alias("accuracy"), "details")


def best_so_far(log: DataFrame, step: str = "step", loss: str = "val_loss", by: list[str] | None = None) -> DataFrame:
    """Rows with the least loss up to them in their run (by; one run if none is named); a later equal loss is no new best."""
    run = Window.partitionBy(*(by or [])).orderBy(step)
    before = run.rowsBetween(Window.unboundedPreceding, -1)
    log = log.withColumn("best", F.min(loss).over(run.rowsBetween(Window.unboundedPreceding, 0)))
    return log.withColumn("is_best", F.coalesce(F.col(loss) < F.min(loss).over(before), F.lit(True)))


def verdict(own: Column, baseline: Column) -> Column:
    """A lower perplexity is better, an equal one is not."""
    return F.when(own < baseline, "better").otherwise("not better")


def final_metric(value: Column, status: Column, order: Column) -> Column:
    """Aggregate: the last value marked complete, else the last."""
    return F.coalesce(F.max_by(value, F.when(status == "complete", order)), F.max_by(value, order))


def top_k_softmax(logits: DataFrame, by: str, k: int, logit: str = "logit") -> DataFrame:
    """The k largest logits of each group (all that tie for the last place stay) with rank and probability among them."""
    ranked = logits.withColumn("rank", F.rank().over(Window.partitionBy(by).orderBy(F.desc(logit)))).where(F.col("rank") <= k)
    group = Window.partitionBy(by)
    e = F.exp(F.col(logit) - F.max(logit).over(group))
    return ranked.withColumn("_e", e).withColumn("prob", F.col("_e") / F.sum("_e").over(group)).drop("_e")


def names_any(output: Column, *names: Column) -> Column:
    """Whether the lower-cased output holds any of the names; empty and null names don't count."""
    return bind(F.lower(F.coalesce(output, F.lit(""))), lambda low: reduce(lambda a, b: a | b, [F.coalesce(F.contains(low, F.nullif(F.lower(n), F.lit(""))), F.lit(False)) for n in names]))


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """bin (from 0) and n of equal-width bins over the values' range; the top edge belongs to the last."""
    bounds = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    place = F.least(F.floor(F.when(width > 0, (F.col(value) - F.col("_lo")) / width).otherwise(0)), F.lit(bins - 1)).cast("int")
    return df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(bounds)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))  # bounds is one row
