"""A store of released results with a commit log.

Data is written under a folder of its own first. ``log/<release_id>`` then gets numbered entries that are
never overwritten: ``STAGED`` names the folder and the request, ``PUBLISHED`` makes it the release's
content, and the newest published entry counts. Readers go through the log and never see data without
one, so publishing costs one small file, moves no data, and a crash between any two steps leaves the
content as it was before or as it is after. Results of one schema share a folder, so all of them can be
read as one table without naming each.
"""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tablewarden.functions.render import json_rows
from tablewarden.sources.commit_log import append_record, names, newest_records

STAGED, PUBLISHED = "STAGED", "PUBLISHED"
LOG_SCHEMA = (
    "release_id string, number bigint, state string, request string, folder string, format string, "
    "schema string, columns array<string>, row_count bigint, column_count int"
)


def _log(store: str, release_id: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", release_id):
        raise ValueError(f"not a release id: {release_id!r}")
    return f"{store}/log/{release_id}"


def _data(store: str, entry: dict) -> str:
    return f"{store}/data/{entry['schema']}/{entry['folder']}"


def stage(frame: DataFrame, store: str, release_id: str) -> dict:
    """Write the masked rows and return their entry, not yet in the log.

    Row counts come from the write itself. Parquet refuses duplicate column
    names, so such results are stored as positional JSON rows. Every attempt has
    its own folder: trying again never touches what is already published.
    """
    _log(store, release_id)
    seen = Observation()
    counted = frame.observe(seen, F.count(F.lit(1)).alias("rows"))
    folder = f"{release_id}-{uuid.uuid4().hex}"
    duplicates = len({c.lower() for c in frame.columns}) < len(frame.columns)
    entry = {
        "release_id": release_id,
        "folder": folder,
        "format": "json_rows" if duplicates else "parquet",
        "schema": "rows" if duplicates else hashlib.sha256(frame.schema.simpleString().encode()).hexdigest(),
        "columns": frame.columns,
        "column_count": len(frame.columns),
    }
    if duplicates:
        json_rows(counted).write.text(_data(store, entry))
    else:
        counted.write.parquet(_data(store, entry))
    return entry | {"row_count": seen.get["rows"]}


def log_entry(spark: SparkSession, store: str, entry: dict, state: str, request: str | None = None) -> int:
    """Add an entry to the log of its release; its number."""
    facts = {k: v for k, v in entry.items() if k not in ("number", "state", "request")}
    return append_record(spark, _log(store, entry["release_id"]), {**facts, "state": state, "request": request})


def publish(spark: SparkSession, store: str, entry: dict, request: str | None = None) -> None:
    """Make a staged result the content of its release."""
    log_entry(spark, store, entry, PUBLISHED, request)


def newest(
    spark: SparkSession, store: str, release_id: str, state: str, request: str | None = None
) -> dict | None:
    """The newest entry in that state, of that request if one is given."""
    for entry in newest_records(spark, _log(store, release_id)):
        if entry["state"] == state and (request is None or entry["request"] == request):
            return entry
    return None


def releases(spark: SparkSession, store: str) -> DataFrame:
    """The newest published entry of every release."""
    if not names(spark, f"{store}/log"):
        return spark.createDataFrame([], LOG_SCHEMA)
    log = spark.read.schema(LOG_SCHEMA).option("recursiveFileLookup", "true").json(f"{store}/log")
    order = Window.partitionBy("release_id").orderBy(F.desc("number"))
    published = log.filter(F.col("state") == PUBLISHED).withColumn("_newest", F.row_number().over(order))
    return published.filter("_newest = 1").drop("_newest")


def read_release(spark: SparkSession, store: str, release_id: str) -> DataFrame:
    """Rows of one published release; an unpublished one cannot be read."""
    entry = newest(spark, store, release_id, PUBLISHED)
    if entry is None:
        raise LookupError(f"no published release: {release_id}")
    path = _data(store, entry)
    if entry["format"] == "parquet":
        return spark.read.parquet(path)
    return spark.read.text(path).withColumnRenamed("value", "row")


def read_all(spark: SparkSession, store: str) -> DataFrame:
    """Rows of every published release of a store whose results share a schema.

    Rows find their entry by the folder in their file's path, so no list of folders is ever collected.
    Raises where that cannot be had whole: nothing is published, schemas differ, or a result has
    duplicate names and so is stored as positional rows; ``read_release`` reads such a one.
    """
    entries = releases(spark, store)
    positional = entries.filter("format <> 'parquet'").select("release_id").orderBy("release_id").head(5)
    if positional:
        raise ValueError(f"stored as positional rows, read them one by one: {[r[0] for r in positional]}")
    schemas = [r[0] for r in entries.select("schema").distinct().head(2)]
    if not schemas:
        raise LookupError(f"no published release in {store}")
    if len(schemas) > 1:
        raise ValueError("the releases of this store have several schemas")
    rows = spark.read.option("recursiveFileLookup", "true").parquet(f"{store}/data/{schemas[0]}")
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    kept = entries.select(F.col("folder").alias("_release_folder"))
    return rows.select("*", folder.alias("_release_folder")).join(kept, "_release_folder", "left_semi").drop("_release_folder")
