"""Incremental ingest with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cinderfold.operators import replay
from cinderfold.operators.corpus import first_wins
from cinderfold.operators.gate import GRAM, OVERLAP, grams

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ingest_stream(stream: DataFrame, sink: str, checkpoint: str, key: str, order: list[str]) -> None:
    """Take all that is there now into the Parquet sink: new keys only, what is there already wins.

    A batch that is run again finds its own keys in the sink and adds nothing.
    """

    def take(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = first_wins(batch, [key], order)
        if _exists(spark, sink):
            new = new.join(spark.read.parquet(sink).select(key), key, "left_anti")
        new.select(*batch.columns).write.mode("append").parquet(sink)

    stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


class _Gate(StatefulProcessor):
    """Holds the shingles of all accepted texts, one state row each."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "gram string", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for row in sorted((r for frame in rows for r in frame.itertuples(index=False)), key=lambda r: r.ord):
            own = list(row.grams)
            overlap = sum(self.seen.containsKey((g,)) for g in own) / max(1, len(own))
            if ok := overlap <= OVERLAP:
                for g in own:
                    self.seen.updateValue((g,), (GRAM,))
            yield pd.DataFrame({"ord": [row.ord], "accepted": [ok], "overlap": [overlap]})

    def close(self) -> None:
        pass


def gate_stream(stream: DataFrame, order: str, text: str) -> DataFrame:
    """ord, accepted, overlap of a stream of texts in sequence: one key, as each decision hangs on all before it.

    Each shingle is looked up in the state store, so this is for streams of few texts at a time; gate_into() is for many.
    """
    rows = stream.select(F.lit(0).alias("k"), F.col(order).cast("long").alias("ord"), grams(F.col(text)).alias("grams"))
    return rows.groupBy("k").transformWithStateInPandas(_Gate(), "ord long, accepted boolean, overlap double", "Append", "None")


def gate_into(stream: DataFrame, sink: str, checkpoint: str, order: str, text: str) -> DataFrame:
    """ord, accepted, overlap of all that is there now, taken into the sink: batch after batch, each in order.

    A batch is replayed in many tasks against the accepted texts of all batches before it, which the sink keeps beside the
    decisions. A batch that is run again replaces what it wrote.
    """

    def take(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        rows, n_bytes = replay.placed(batch, order, text)
        rows.select("at", "text").write.mode("overwrite").option("compression", "zstd").parquet(f"{sink}/texts/batch={n}")
        texts = rows.select("at", "text")
        if n:
            earlier = [spark.read.schema(f"{schema}, batch long").parquet(f"{sink}/{table}").where(F.col("batch") < n) for table, schema in (("texts", "at long, text string"), ("decided", decided))]
            prior = earlier[0].join(earlier[1].where("accepted").select("batch", "at"), ["batch", "at"]).select(F.lit(replay.PRIOR).alias("at"), "text")
            n_bytes += earlier[0].agg(F.sum(F.octet_length("text"))).first()[0] or 0
            texts = texts.unionByName(prior)
        done = replay.replayed(texts, n_bytes).select("at", replay.accepted().alias("accepted"), replay.overlap().alias("overlap"))
        rows.select("at", "ord").join(done, "at").write.mode("overwrite").parquet(f"{sink}/decided/batch={n}")

    decided = "at long, ord long, accepted boolean, overlap double"
    stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(decided).parquet(f"{sink}/decided/batch=*").select("ord", "accepted", "overlap")


def dedup_stream(stream: DataFrame, key: str, event_time: str, delay: str) -> DataFrame:
    """The first event of each key within the watermark's reach."""
    stream = stream.withColumn(event_time, F.col(event_time).cast("timestamp"))
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, event_time: str, by: str, value: str, size: str, delay: str) -> DataFrame:
    """Events and sum of values by tumbling window and key, closed by the watermark."""
    stream = stream.withColumn(event_time, F.col(event_time).cast("timestamp"))
    return stream.withWatermark(event_time, delay).groupBy(F.window(event_time, size), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")
