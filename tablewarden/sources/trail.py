"""The audit trail on storage: JSON Lines files, append only, in a known order.

Every append takes the next number and writes its lines, sorted, under ``append-<number>``. So the whole
trail has one order: by append, by part file, by line. An append may carry a key; the key's number is
written down once, so the same append tried again writes the same place, or nothing if it is complete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.operators.audit import audit_lines
from tablewarden.operators.sequence import in_ranges
from tablewarden.sources.commit_log import append_record, create_once, exists, last_number, read_record

APPENDS, KEYS = "_appends", "_keys"


def append_folder(path: str, number: int) -> str:
    return f"{path}/append-{number:012d}"


def keyed_append(spark: SparkSession, path: str, key: str) -> str | None:
    """The folder of the append with that key, if it is complete."""
    known = read_record(spark, f"{path}/{KEYS}/{key}.json")
    folder = known and append_folder(path, known["append"])
    return folder if folder and exists(spark, f"{folder}/_SUCCESS") else None


def append_audit(records: DataFrame, path: str, key: str | None = None) -> None:
    """Append records as lines, ids rising over the files of the append.

    The lines are dealt into ranges of ids and sorted there. With a ``key``, an append that is complete is
    left as it is; it holds the few lines of one request.
    """
    spark = records.sparkSession
    if key is None:
        number = append_record(spark, f"{path}/{APPENDS}", {})
    else:
        if keyed_append(spark, path, key):
            return
        known = read_record(spark, f"{path}/{KEYS}/{key}.json")
        if known is None:
            number = append_record(spark, f"{path}/{APPENDS}", {"key": key})
            create_once(spark, f"{path}/{KEYS}/{key}.json", {"append": number})
            known = read_record(spark, f"{path}/{KEYS}/{key}.json")
        number = known["append"]
    lines = audit_lines(records)
    ordered = in_ranges(lines, "request_id") if key is None else lines.orderBy("request_id")
    ordered.select("value").write.mode("overwrite").text(append_folder(path, number))


def append_lines(lines: DataFrame, path: str) -> None:
    """Append lines that come from elsewhere, as they are."""
    number = append_record(lines.sparkSession, f"{path}/{APPENDS}", {})
    lines.select("value").write.text(append_folder(path, number))


def appends(spark: SparkSession, path: str) -> int:
    """How many numbers are taken."""
    return last_number(spark, f"{path}/{APPENDS}") + 1


def read_trail(spark: SparkSession, path: str) -> DataFrame:
    """Every line with its place: ``append``, ``file``, ``split_start`` and ``line``.

    ``line`` rises with line order inside one split of one file. ``append`` is -1 for files that no
    append wrote. Malformed lines are kept as they are.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    file = F.col("_metadata.file_path")
    number = F.regexp_extract(file, r"/append-([0-9]+)/[^/]*$", 1)
    return lines.select(
        "value",
        file.alias("file"),
        F.col("_metadata.file_block_start").alias("split_start"),
        F.monotonically_increasing_id().alias("line"),
        F.coalesce(number.try_cast("bigint"), F.lit(-1)).alias("append"),
    )


def stream_trail(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.option("recursiveFileLookup", "true").text(path)
