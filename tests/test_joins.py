"""Outer joins with heavy keys equal Spark's own and stay balanced."""

import random

import pytest
from pyspark.sql import functions as F

from tablewarden.operators import joins


def sides(spark, heavy):
    pick = random.Random(len(heavy))
    left = [(pick.randrange(60), f"l{i}") for i in range(80)] + [(None, f"n{i}") for i in range(4)]
    right = [(f"r{i}", pick.randrange(30, 90)) for i in range(80)] + [("n", None), ("m", None)]
    if "right" in heavy:
        right += [(f"h{i}", 7) for i in range(200)]
    if "left" in heavy:
        left += [(80, f"g{i}") for i in range(200)]
    if "both" in heavy:
        left += [(55, f"b{i}") for i in range(60)]
        right += [(f"c{i}", 55) for i in range(60)]
    if "alone" in heavy:  # a heavy key that the other side lacks
        right += [(f"a{i}", 1000) for i in range(200)]
        left += [(2000, f"a{i}") for i in range(200)]
    if "null" in heavy:
        left += [(None, f"z{i}") for i in range(300)]
        right += [(f"z{i}", None) for i in range(300)]
    if "same" in heavy:  # equal rows
        right += [("same", 7)] * 100
        left += [(7, "same")] * 2
    a = spark.createDataFrame(left, "id int, a string").repartition(3)
    return a, spark.createDataFrame(right, "b string, ref int").repartition(3)


CASES = ["none", "right", "left", "both", "alone", "null", "same", "right left both alone null same"]


@pytest.mark.parametrize("how", ["left", "right", "full"])
@pytest.mark.parametrize("heavy", CASES)
def test_outer_join_equals_sparks_own(spark, how, heavy):
    a, b = sides(spark, heavy)
    got = joins.outer_join(a, b, "id", "ref", how)
    assert got.columns == ["id", "a", "b", "ref"]
    expected = a.join(b, F.col("id") == F.col("ref"), how)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, expected.collect()), key=str)


def test_heavy_keys_are_those_of_more_than_one_task(spark):
    a, b = sides(spark, "right null")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = joins.heavy_keys(b, "ref")
    assert set(found) == {7, None} and all(n > joins.SALTS_PER_TASK for n in found.values())
    assert sum(found.values()) <= joins.SALTS_PER_TASK * tasks + len(found)
    assert joins.heavy_keys(b.limit(0), "ref") == {}


def test_a_full_join_scans_and_shuffles_each_side_once(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a, b = sides(spark, "right left")
        a.write.parquet(str(tmp_path / "a"))
        b.write.parquet(str(tmp_path / "b"))
        a, b = spark.read.parquet(str(tmp_path / "a")), spark.read.parquet(str(tmp_path / "b"))
        plan = joins.outer_join(a, b, "id", "ref", "full")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("FileScan") == 2 and plan.count("Exchange hashpartitioning") == 2
