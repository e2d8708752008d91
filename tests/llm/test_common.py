"""What the operators share."""

import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from siftworks.llm import common


@pytest.mark.parametrize("share", [1, 4, 1024])
def test_hot_keys_join_as_others_do(spark, monkeypatch, share):
    monkeypatch.setattr(common, "HOT_SHARE", share)
    rows = spark.range(400).select(F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 20).alias("k"), F.col("id").alias("r"))
    per_key = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("r").alias("top")).where("k IS NOT NULL")
    got = common.join_by_key(rows, per_key, "k", rows.count())
    assert got.columns == ["k", "r", "top"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(per_key.drop("n"), "k").collect()))


def test_scratch_is_shared_on_a_cluster_and_goes_when_it_is_read(spark):
    conf = SimpleNamespace(get=lambda *_: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.scratch_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))
    alone = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local[2]"))
    assert common.scratch_dir(alone) == common.scratch_dir(alone)
    held = common.materialize(spark.range(5), "test")
    path = held._siftworks_path
    assert path.startswith(f"{spark.conf.get('spark.checkpoint.dir')}/siftworks/{spark.sparkContext.applicationId}/") and held.count() == 5
    common.discard(held)
    assert not os.path.exists(path.removeprefix("file:"))


def test_names_that_are_not_taken(spark):
    df = spark.range(1).select(F.lit(1).alias("_M"), F.lit(1).alias("_m_"), F.lit(1).alias("x"))
    assert common.unused("_m", df) == "_m__" and common.unused("y", df) == "y"
