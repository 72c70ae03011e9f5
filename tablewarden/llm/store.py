"""Tables written once into the shared folder, and running totals over partitions."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.session import scratch_path


ROW_GROUP_BYTES = 16 << 20


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` under ``spark.checkpoint.dir`` and return it as read back.

    Later steps then see the same rows and ids whatever executor is lost, and their plans start here.
    A writer holds one row group, so these are small.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep_bucketed(df: DataFrame, by: str, label: str, dealt: bool = False) -> DataFrame:
    """Like ``keep``, in as many buckets as the session has shuffle partitions, so that a join on ``by``
    reads the table in place.

    ``dealt`` shuffles the rows by ``by`` first, once, so each bucket is one file; without it every
    task writes a file per bucket it has rows of, which is right for few large rows. The table's name
    is only needed to reach its buckets and is dropped at once; its files stay.
    """
    spark = df.sparkSession
    name = f"tablewarden_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartition(buckets, by) if dealt else df
    writer = rows.write.bucketBy(buckets, by).option("path", scratch_path(spark, label))
    writer.option("parquet.block.size", ROW_GROUP_BYTES).format("parquet").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after its session was told to pass texts to Python in small Arrow batches.

    The default of 10,000 rows a batch is some tens of megabytes of texts, held several times over on both
    sides of every running task.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pass batches on; after the last one, give the memory that they took back to the system.

    Python workers are kept for later tasks, and what one task has freed would stay with its process.
    """
    pa.set_memory_pool(pa.system_memory_pool())  # whose memory can be given back
    try:
        yield from batches
    finally:
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim is not None:
            trim(0)


def partition_offsets(df: DataFrame, part: str, size: str) -> DataFrame:
    """``(part, _offset)``: the total ``size`` of all partitions numbered below.

    One row per partition of the table that was written, so it may be broadcast.
    """
    totals = df.groupBy(part).agg(F.sum(size).alias("_n"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
