"""Versions of a partitioned table: commits, pinned readers, writes that die."""

import os

import pytest
from pyspark.sql import functions as F

from benthos.sources.versioned import VersionedTable, spread_by_bytes


def files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def rows(spark, names, value):
    return spark.createDataFrame([(n, i, value) for n in names for i in range(50)], "split_name string, id int, v string")


def counted(df):
    return {(r.split_name, r.v): r["count"] for r in df.groupBy("split_name", "v").count().collect()}


def test_replacing_one_split_leaves_the_others_files(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t", "split_name")
    with pytest.raises(ValueError):
        t.read()
    assert t.replace(rows(spark, ["a", "b", "c d/é"], "one")) == 1
    before, pinned = files(tmp_path), t.read(1)
    assert t.replace(rows(spark, ["b", "7"], "two")) == 2
    assert {p: m for p, m in files(tmp_path).items() if p in before} == before
    assert counted(t.read()) == {("a", "one"): 50, ("b", "two"): 50, ("c d/é", "one"): 50, ("7", "two"): 50}
    assert counted(t.read(1)) == counted(pinned) == {("a", "one"): 50, ("b", "one"): 50, ("c d/é", "one"): 50}
    assert t.read().schema == rows(spark, ["a"], "x").schema and t.versions() == [1, 2]
    with pytest.raises(ValueError):
        t.replace(rows(spark, ["a"], "x").withColumn("more", F.lit(1)))
    assert t.clean(keep=1) == ["versions/1.json"]  # the first write's files still hold a and c
    assert counted(t.read())["a", "one"] == 50
    with pytest.raises(ValueError):
        t.read(1)


def test_a_write_that_dies_half_way_changes_nothing(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t", "split_name")
    t.replace(rows(spark, ["a", "b"], "one"))
    kept, now = files(tmp_path), counted(t.read())
    broken = rows(spark, ["a", "b"], "two").withColumn("v", F.when((F.col("split_name") == "b") & (F.col("id") == 49), F.raise_error(F.lit("lost"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        t.replace(broken)
    assert t.versions() == [1] and counted(t.read()) == now
    # one that dies after staging, before its version has a name
    spread_by_bytes(rows(spark, ["a"], "three"), ["split_name"]).write.partitionBy("split_name").parquet(f"file://{tmp_path}/t/data/attempt=dead")
    assert counted(t.read()) == now and "data/attempt=dead" in t.clean()
    assert files(tmp_path) == kept and t.replace(rows(spark, ["a"], "four")) == 2
    with pytest.raises(Exception, match="without a name"):
        t.replace(rows(spark, [None], "x"))


def test_two_writers_of_one_version(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t", "split_name")
    t.replace(rows(spark, ["a"], "one"))
    late = t.manifest()
    t.replace(rows(spark, ["a"], "two"))
    with pytest.raises(ValueError, match="meanwhile"):
        t._commit(late, rows(spark, ["a"], "three"), "attempt=none")
    assert counted(t.read()) == {("a", "two"): 50}


def test_files_follow_bytes(spark, tmp_path):
    df = spark.createDataFrame([("big", "x" * 100)] * 3000 + [("small", "y")], "k string, t string")  # equal rows
    spread_by_bytes(df, ["k"], file_bytes=40_000).write.partitionBy("k").parquet(f"file://{tmp_path}/p")
    per = {k: len([f for f in os.listdir(f"{tmp_path}/p/k={k}") if f.endswith(".parquet")]) for k in ("big", "small")}
    assert per["small"] == 1 and 4 <= per["big"] <= 10 and spark.read.parquet(f"file://{tmp_path}/p").count() == 3001
