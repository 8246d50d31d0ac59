import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cinderfold.llm import common
from cinderfold.llm.common import drop_written, held, in_batches, row_key, small, written, written_alone
from cinderfold.sources.scratch import left


def sizes(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])


def test_batches_are_bounded_by_bytes(spark):
    rows = spark.range(6000, numPartitions=1).select(F.repeat(F.lit("x"), 4000).alias("t"))
    got = [r.n for r in in_batches(rows, sizes, "n long").collect()]
    assert len(got) > 4 and max(got) < 5 << 20


def test_a_session_may_name_another_size(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1m")
    try:
        in_batches(spark.range(1), sizes, "n long")
        assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "1m"
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)


def test_workers_hold_what_one_operator_keeps():
    made = []
    run = lambda batches: (held(("a", 1), lambda: made.append(1) or "state") for _ in batches)
    assert list(common._task(run, ("a", 1), [0, 0])) == ["state", "state"] and made == [1]
    assert list(common._task(run, ("a", 1), [0])) == ["state"] and made == [1]
    assert list(common._task(lambda batches: batches, None, [1])) == [1]
    assert common._HELD == {}


def test_written_tables(spark):
    before = left()
    df = spark.range(100, numPartitions=50).withColumn("x", F.lit(None).cast("string"))
    out = written(df, "t", narrow=True)
    assert out.dtypes == df.dtypes and out.count() == 100 and len(out.inputFiles()) <= 25
    drop_written(out)
    alone = written_alone(lambda: written(df, "inner").where("id < 5"), "outer")
    assert alone.count() == 5 and left() - before == {alone.scratch}
    drop_written(alone)
    assert left() == before


@pytest.mark.parametrize(("rows", "marked"), [(10, True), (common.BROADCAST_ROWS + 1, False)])
def test_only_few_rows_are_marked_for_broadcast(spark, rows, marked):
    plan = small(spark.range(1), rows)._jdf.queryExecution().logical().toString()
    assert ("broadcast" in plan) == marked


def test_row_keys(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (1, ""), (None, "a"), (2, "a")], "doc_id long, text string")
    assert [len(set(x)) for x in ([tuple(r) for r in rows.select(*row_key()).collect()],)] == [4]
