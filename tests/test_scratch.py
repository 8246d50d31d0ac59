from types import SimpleNamespace

import pytest

from cinderfold.sources import scratch


def session(master, named=None, checkpoints=None):
    context = SimpleNamespace(master=master, getConf=lambda: {"spark.checkpoint.dir": named} if named else {}, getCheckpointDir=lambda: checkpoints)
    return SimpleNamespace(sparkContext=context)


def test_the_named_folder_is_taken():
    assert scratch.shared_dir(session("spark://host", "s3a://bucket/checks/")) == "s3a://bucket/checks"


@pytest.mark.parametrize("master", ["spark://host", "yarn", "local-cluster[2,1,1024]"])
def test_no_local_folder_on_a_cluster(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_dir(session(master))


def test_paths_go_when_dropped(spark):
    path = scratch.scratch(spark, "test")
    spark.range(3).write.parquet(path)
    assert path in scratch.left() and spark.read.parquet(path).count() == 3
    scratch.drop(spark, path)
    assert path not in scratch.left()
    with pytest.raises(Exception, match="(?i)path"):
        spark.read.parquet(path)
