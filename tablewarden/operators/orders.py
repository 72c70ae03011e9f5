"""The one permitted write: a batch of candidate orders, validated and appended.

Each candidate row stands for one insert statement, so a bad row never blocks
the others; rejects keep their reason.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden import vocab
from tablewarden.operators.joins import spread_join
from tablewarden.operators.sequence import sorted_runs
from tablewarden.sources.commit_log import create_numbered, create_once, newest_records, read_record, remove_folder

# Fixed value: column type of an order amount.
AMOUNT_TYPE = "decimal(10,2)"

# What counts as a number when an amount is given as text: no NaN, no Infinity, no type suffix.
_NUMBER = r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"

ACCEPTED = "OK"


def shape_reason() -> Column:
    """NULL, non-numeric or non-positive values do not fit the permitted shape.

    The amount is tested as written, before it is rounded: ``0.001`` is positive
    and is stored as ``0.00``. An amount may be whole or have decimals; a
    customer id must be whole.
    """
    customer = F.col("customer_id").try_cast("bigint")
    as_written = F.col("customer_id").try_cast("double")
    amount = F.col("amount").try_cast("double")
    numeric = F.trim(F.col("amount").cast("string")).rlike(_NUMBER)
    good = (customer > 0) & (as_written == customer) & (amount > 0) & numeric
    return F.when(~F.coalesce(good, F.lit(False)), F.lit(vocab.REASON_INSERT_SHAPE))


def type_reason() -> Column:
    """An amount that overflows its type fails when the statement runs."""
    return F.when(
        F.col("amount").try_cast(AMOUNT_TYPE).isNull(), F.lit(vocab.EXECUTION_FAILURE)
    )


def validate_shape_and_type(candidates: DataFrame) -> DataFrame:
    """Add ``status`` from the row alone: OK or the first reason against it."""
    return candidates.withColumn(
        "status", F.coalesce(shape_reason(), type_reason(), F.lit(ACCEPTED))
    )


def validate_orders(candidates: DataFrame, customers: DataFrame) -> DataFrame:
    """Add ``status`` and the typed values; an unknown customer fails execution.

    One left join on the id marks known customers. Candidates of one customer
    are spread by their own id; the customer side is one id column, and Catalyst
    broadcasts it only while its measured size allows that.
    """
    known = customers.select(F.col("id").alias("_known")).distinct()
    checked = validate_shape_and_type(candidates).withColumn(
        "_customer", F.col("customer_id").try_cast("bigint")
    )
    orphan = (F.col("status") == ACCEPTED) & F.col("_known").isNull()
    return (
        spread_join(checked, known, "_customer", "_known", ["id"], "left")
        .withColumn(
            "status", F.when(orphan, F.lit(vocab.EXECUTION_FAILURE)).otherwise(F.col("status"))
        )
        .drop("_known", "_customer")
    )


def accepted_orders(validated: DataFrame) -> DataFrame:
    return validated.filter(F.col("status") == ACCEPTED).select(
        F.col("id").alias("candidate_id"),
        F.col("customer_id").try_cast("bigint").alias("customer_id"),
        F.col("amount").try_cast(AMOUNT_TYPE).alias("amount"),
    )


def order_rejects(validated: DataFrame) -> DataFrame:
    return validated.filter(F.col("status") != ACCEPTED)


def append_orders(
    validated: DataFrame,
    existing: DataFrame,
    path: str,
    created_at: Column | None = None,
    batch: str | None = None,
) -> int:
    """Append the accepted rows with fresh ids; returns the number of rows written.

    Ids are in candidate order and continue after the last range of the ledger under ``path``; only
    while that is empty is the highest id of ``existing`` looked up. A batch reserves its range before it
    writes, and its rows have a folder of their own. So a batch of the same name that runs again, after a
    crash or twice, takes the same ids and replaces its own rows; with another number of accepted
    rows it is refused. Rejects are not written. Read the table with ``read_orders``.
    """
    spark = validated.sparkSession
    batch = batch or uuid.uuid4().hex
    moment = created_at if created_at is not None else F.current_timestamp().cast("timestamp_ntz")
    rows, runs = sorted_runs(accepted_orders(validated), ["candidate_id"])
    held = reserve_ids(spark, path, batch, rows.count(), existing)
    numbered = rows.select((F.col("_place") + held["first"]).alias("id"), "customer_id", "amount", moment.alias("created_at"))
    numbered.write.mode("overwrite").parquet(f"{path}/batch-{batch}")
    remove_folder(spark, runs)
    return held["count"]


def reserve_ids(spark: SparkSession, path: str, batch: str, count: int, existing: DataFrame) -> dict:
    """The ledger's record of a batch: its ``first`` id and their ``count``, taken now or before."""
    if not re.fullmatch(r"[A-Za-z0-9._-]+", batch):
        raise ValueError(f"not a batch name: {batch!r}")
    ledger, mark = f"{path}/_ledger", f"{path}/_batches/{batch}.json"
    held = read_record(spark, mark)
    while held is None:
        last = next(newest_records(spark, ledger), None)
        if last is None:
            highest = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
            last = {"number": -1, "first": highest + 1, "count": 0}
        if last.get("batch") == batch:  # reserved before a crash, not yet marked
            held = last
        else:
            record = {"batch": batch, "first": last["first"] + last["count"], "count": count}
            if create_numbered(spark, ledger, last["number"] + 1, record):
                held = record
        if held is not None:
            create_once(spark, mark, {"batch": batch, "first": held["first"], "count": held["count"]})
            held = read_record(spark, mark)
    if held["count"] != count:
        raise ValueError(f"batch {batch} had {held['count']} accepted rows when it took its ids, now {count}")
    return held


def read_orders(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all batches."""
    return spark.read.option("recursiveFileLookup", "true").parquet(path)
