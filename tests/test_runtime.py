import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from inkgrove import runtime


def test_scratch_tables(spark):
    df = runtime.written(spark.range(10), "t")
    root = runtime.checkpoint_root(spark).removeprefix("file:").replace("//", "/")
    assert df.count() == 10 and any(n.startswith("t-") for n in os.listdir(root))
    assert runtime.drop_scratch(spark) >= 1 and not any(n.startswith("t-") for n in os.listdir(root))


def test_release_removes_what_a_result_was_computed_from(spark):
    root = runtime.checkpoint_root(spark).removeprefix("file:").replace("//", "/")
    kept = runtime.written(spark.range(3), "kept")
    first = runtime.written(spark.range(10), "first")
    result = runtime.written(first.groupBy((F.col("id") % 2).alias("k")).count(), "second").where("count > 0")
    assert result.count() == 2 and runtime.release(result, deep=True) == 2
    names = [n.split("-")[0] for n in os.listdir(root)]
    assert "first" not in names and "second" not in names and kept.count() == 3
    with runtime.scratch_scope(spark):
        assert runtime.written(spark.range(5), "inner").count() == 5
    assert not any(n.startswith("inner-") for n in os.listdir(root))
    runtime.release(kept)


def test_a_cluster_needs_a_shared_folder():
    none = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.checkpoint_root(session)


def test_spread(spark):
    assert runtime.spread(spark.range(100).coalesce(1)).rdd.getNumPartitions() == 4
    assert runtime.spread(spark.range(100).repartition(3)).rdd.getNumPartitions() == 3
    named = spark.range(100).coalesce(1).select(F.col("id").alias("ExchangeRate"))
    assert runtime.spread(named).rdd.getNumPartitions() == 4
    assert runtime.spread(spark.range(100).groupBy("id").count()).count() == 100
