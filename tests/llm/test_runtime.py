import os

import pytest
from pyspark.sql import functions as F

from slotwise.llm import runtime


def test_written_tables_can_be_discarded(spark):
    runtime.discard(spark)
    at = runtime.shared_folder(spark)
    a, b = (runtime.materialize(spark.range(5), "kept") for _ in range(2))
    assert a.count() == b.count() == 5
    folders = [f for f in os.listdir(at) if f.startswith("kept-")]
    assert len(folders) == 2
    runtime.discard(spark, keep=1)
    assert len([f for f in os.listdir(at) if f.startswith("kept-")]) == 1 and b.count() == 5


def test_only_tables_of_late_are_discarded(spark):
    a = runtime.materialize(spark.range(1), "early")
    since = runtime.mark()
    runtime.materialize(spark.range(2), "late")
    c = runtime.materialize(spark.range(3), "late")
    runtime.discard(spark, since=since, keep=1)
    assert (a.count(), c.count()) == (1, 3)
    assert len([f for f in os.listdir(runtime.shared_folder(spark)) if f.startswith("late-")]) == 1


def test_hot_keys_join_like_others(spark):
    rows = spark.range(3000).selectExpr("case when id < 2000 then 7 else id end as k", "id")
    info = rows.groupBy("k").count().withColumn("x", F.col("k") * 2)
    got = runtime.join_hot(rows, info, ["k"], "count", 3000)
    assert got.count() == 3000 and got.where("x <> 2 * k").count() == 0


def test_the_filter_loses_nothing(spark):
    rows = spark.range(100_000)
    wanted = spark.range(0, 100_000, 97)
    assert runtime.possible(rows, wanted, "id").join(wanted, "id").count() == wanted.count()
    assert runtime.possible(rows, wanted, "id").count() < 1.1 * wanted.count()
    assert runtime.possible(rows, wanted.limit(0), "id").count() == 0


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as Some

    conf = Some(get=lambda *_: None)
    far = Some(conf=conf, sparkContext=Some(getConf=lambda: conf, master="spark://far:7077"))
    with pytest.raises(ValueError):
        runtime.shared_folder(far)
