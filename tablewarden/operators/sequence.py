"""Row order at scale: dense ids and previous-row lookups without a global window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.session import scratch_path

# A chunk of neighbours_in_order holds 2**16 positions. Two such levels leave at
# most one row per 2**32 positions for the single last step.
CHUNK_BITS = 16
ROWS_PER_RANGE = 1 << 16
SAMPLED_PER_RANGE = 1000


def _range_number(value: Column, bounds: list, first: int = 0) -> Column:
    """How many bounds are below ``value``, by halving."""
    if not bounds:
        return F.lit(first)
    at = len(bounds) // 2
    low = _range_number(value, bounds[:at], first)
    return F.when(value <= F.lit(bounds[at]), low).otherwise(_range_number(value, bounds[at + 1 :], first + at + 1))


def in_ranges(df: DataFrame, key: str) -> DataFrame:
    """``df`` in the order of a numeric ``key``: ranges that rise with the partition, sorted inside.

    There are as many ranges as the rows need, at most one per shuffle partition; nulls come first. The
    bounds come from a sample of the key alone, for which Catalyst leaves out all that other columns cost:
    a range partitioning of ``df`` would compute all of its rows for the sample, and then again.
    """
    keys = df.select(key)
    count = keys.count()
    ranges = max(1, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count // ROWS_PER_RANGE)))
    bounds = []
    if ranges > 1:
        sample = keys.sample(min(1.0, SAMPLED_PER_RANGE * ranges / count), seed=1)
        steps = [i / ranges for i in range(1, ranges)]
        bounds = sample.agg(F.percentile_approx(key, steps, 100 * SAMPLED_PER_RANGE)).first()[0] or []
    number = F.when(F.col(key).isNull(), 0).otherwise(_range_number(F.col(key), sorted(set(bounds))))
    return df.repartitionById(ranges, number).sortWithinPartitions(key)


def sorted_runs(df: DataFrame, order_by: list[str]) -> tuple[DataFrame, str]:
    """``df`` range-partitioned, sorted and written once, with ``_place`` from 0 in the total order.

    Also returns the folder of the runs, for callers that know when it is no longer read. Every later
    step sees the same runs even after an executor is lost. Only one count per run is ordered
    globally, and there are no more runs than shuffle partitions. ``order_by`` must end in a unique
    column; that also spreads rows that arrived at the same moment over many runs.
    """
    spark = df.sparkSession
    runs = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "runs")
    (
        df.repartitionByRange(runs, *order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("_row", F.monotonically_increasing_id())
        .write.parquet(path)
    )
    rows = spark.read.parquet(path).withColumn("_run", F.shiftright("_row", 33))
    counts = rows.groupBy("_run").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    in_run = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    placed = rows.join(F.broadcast(offsets), "_run").withColumn("_place", (F.col("_offset") + in_run).cast("bigint"))
    return placed.drop("_row", "_run", "_offset"), path


def assign_dense_ids(
    df: DataFrame, order_by: list[str], id_column: str, base: Column | int = 0
) -> DataFrame:
    """Add ``id_column`` = base + 1, 2, 3, ... in the given total order, by ``sorted_runs``."""
    rows, _ = sorted_runs(df, order_by)
    start = base if isinstance(base, Column) else F.lit(base)
    return rows.withColumn(id_column, (start + F.col("_place") + 1).cast("bigint")).drop("_place")


def neighbours_in_order(df: DataFrame, position: str, columns: list[str]) -> DataFrame:
    """Add ``prev_<column>``: the value in the row before, by ``position``.

    ``position`` is a non-negative, unique bigint. Rows are paired inside chunks
    of neighbouring positions. The first row of a chunk takes the last row of
    the chunk before it, which is found the same way one level up over one
    summary row per chunk; only the summaries of those groups meet in one place.
    """
    value = F.struct(*columns)
    chunked = df.withColumn("_chunk", F.shiftright(F.col(position), CHUNK_BITS))
    in_chunk = Window.partitionBy("_chunk").orderBy(position)
    paired = chunked.withColumn("_prev", F.lag(value).over(in_chunk))

    ends = chunked.groupBy("_chunk").agg(F.max_by(value, F.col(position)).alias("_last"))
    grouped = ends.withColumn("_group", F.shiftright("_chunk", CHUNK_BITS))
    in_group = Window.partitionBy("_group").orderBy("_chunk")
    inside = grouped.withColumn("_carry", F.lag("_last").over(in_group))
    group_ends = grouped.groupBy("_group").agg(F.max_by("_last", "_chunk").alias("_group_last"))
    carried = group_ends.withColumn(
        "_group_carry", F.lag("_group_last").over(Window.orderBy("_group"))
    ).select("_group", "_group_carry")
    carries = inside.join(carried, "_group").select(
        "_chunk", F.coalesce("_carry", "_group_carry").alias("_carry")
    )
    return _with_previous(paired.join(carries, "_chunk"), df.columns, columns)


def neighbours_in_files(df: DataFrame, columns: list[str]) -> DataFrame:
    """The same for lines read from files: order is line order within one file.

    Reads ``file``, ``split_start`` and ``line`` as ``sources.trail`` adds them.
    The scan's own splits are the chunks, so a chunk is never larger than
    ``spark.sql.files.maxPartitionBytes``; per file only one row per split is
    ordered.
    """
    value = F.struct(*columns)
    split = ["file", "split_start"]
    paired = df.withColumn("_prev", F.lag(value).over(Window.partitionBy(*split).orderBy("line")))
    ends = df.groupBy(*split).agg(F.max_by(value, F.col("line")).alias("_last"))
    in_file = Window.partitionBy("file").orderBy("split_start")
    carries = ends.select(*split, F.lag("_last").over(in_file).alias("_carry"))
    return _with_previous(paired.join(carries, split), df.columns, columns)


def _with_previous(paired: DataFrame, keep: list[str], columns: list[str]) -> DataFrame:
    """Split the previous row's struct into ``prev_*``; a chunk's first row uses the carry."""
    return paired.select(*keep, F.coalesce("_prev", "_carry").alias("_before")).select(
        *keep, *[F.col(f"_before.{c}").alias(f"prev_{c}") for c in columns]
    )
