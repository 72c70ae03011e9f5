"""Operators that avoid global steps, against brute force on small data."""

import random

import pytest
from pyspark.sql import functions as F

from tablewarden.operators import integrity
from tablewarden.operators import joins, sequence
from tablewarden.operators.integrity import orphans, unique_violations
from tablewarden.session import scratch_path


def test_dense_ids_with_a_hot_arrival_time(spark):
    rnd = random.Random(3)
    rows = [(5 if i % 3 == 0 else rnd.randrange(100), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "arrived int, k int").repartition(7)
    got = {
        (r.arrived, r.k): r.n
        for r in sequence.assign_dense_ids(df, ["arrived", "k"], "n", base=10).collect()
    }
    assert got == {row: i + 11 for i, row in enumerate(sorted(rows))}


@pytest.mark.parametrize("bits", [1, 2, 4])
def test_neighbours_match_a_plain_loop(spark, monkeypatch, bits):
    monkeypatch.setattr(sequence, "CHUNK_BITS", bits)
    rnd = random.Random(bits)
    positions = sorted(rnd.sample(range(400), 120))
    rows = [(p, rnd.choice([None, rnd.randrange(9)])) for p in positions]
    df = spark.createDataFrame(rows, "position bigint, v int").repartition(5)
    got = [tuple(r) for r in sequence.neighbours_in_order(df, "position", ["v"]).orderBy("position").collect()]
    expected = [(p, v, rows[i - 1][1] if i else None) for i, (p, v) in enumerate(rows)]
    assert got == expected


@pytest.mark.parametrize("how", ["left", "right", "full"])
def test_outer_join_matches_the_plain_one(spark, how):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n"), (4, "d")], "id int, l string")
    right = spark.createDataFrame([(1, "x")] * 3 + [(9, "y"), (None, "z"), (2, "w")], "rid int, r string")
    got = joins.outer_join(left, right, "id", "rid", how).select("id", "l", "rid", "r")
    plain = left.join(right, F.col("id") == F.col("rid"), how)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, plain.collect()))


def test_count_matches(spark):
    left = spark.createDataFrame([(1,), (1,), (2,), (None,)], "a int")
    right = spark.createDataFrame([(1,), (1,), (1,), (3,), (None,)], "b int")
    assert joins.count_matches(left, right, "a", "b").first()["count"] == 6
    assert joins.count_matches(left.filter("a > 9"), right, "a", "b").first()["count"] == 0


def test_key_checks(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (None, "c")], "k int, v string")
    assert {(r.k, r.occurrences) for r in unique_violations(df, ["k"]).collect()} == {(1, 2), (None, 1)}
    parents = spark.createDataFrame([(1,)], "id int")
    assert [r.k for r in orphans(df, "k", parents, "id").collect()] == [2]


def test_scratch_is_in_the_shared_folder_and_new_each_time(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    first, second = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert first != second
    if root:
        assert first.startswith(root)


def test_no_hot_group_reaches_one_task_whole(spark):
    """Grouped checks combine before their only shuffle."""
    df = spark.range(100).select((F.col("id") % 2).alias("k"))
    plan = unique_violations(df, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("HashAggregate") == 2


def test_nulls_are_counted_per_column(spark):
    df = spark.createDataFrame([(1, None, None), (2, "a", None), (None, "b", "c")], "a int, b string, c string")
    got = sorted(map(tuple, integrity.null_violations(df, ["a", "b"]).collect()))
    assert got == [("a", 1), ("b", 1)]
    assert integrity.null_violations(df.limit(0), ["a", "c"]).count() == 0
    assert integrity.null_violations(df.filter("a = 2"), ["a", "b"]).count() == 0


def test_in_ranges_orders_the_whole_and_balances_it(spark, monkeypatch):
    monkeypatch.setattr(sequence, "ROWS_PER_RANGE", 500)
    ids = [None] * 3 + list(range(1900)) + [10**15, -(10**15)] + [700] * 95
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(5)
    out = sequence.in_ranges(df, "id")
    got = out.withColumn("part", F.spark_partition_id()).collect()
    assert [r.id for r in got] == sorted(ids, key=lambda i: (i is not None, i or 0))
    sizes = [sum(r.part == p for r in got) for p in range(out.rdd.getNumPartitions())]
    assert len(sizes) == 4 and max(sizes) < 800  # one far id does not spoil the ranges
    assert sequence.in_ranges(df.limit(0), "id").collect() == []
    doubles = spark.createDataFrame([(float(i % 7),) for i in range(2000)], "id double")
    assert [r.id for r in sequence.in_ranges(doubles, "id").collect()] == sorted(float(i % 7) for i in range(2000))
