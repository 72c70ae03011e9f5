"""How many records of each outcome a trail has, kept up as it grows.

Appends that are complete are summarized once, a batch of them per call, and the result is stored beside
the trail: so a call reads the appends that are new since the last one, and the small summaries. An
append that was still being written is looked at again by the next call.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.operators.trail import trail_entries
from tablewarden.sources.commit_log import create_numbered, exists, last_number, newest_records
from tablewarden.sources.trail import APPENDS, append_folder

SUMMARIES, LOG = "_summaries", "_summary_log"
SCHEMA = "kind string, outcome string, records bigint"
AT_ONCE = 10_000


def _counts(lines: DataFrame) -> DataFrame:
    return trail_entries(lines).groupBy("kind", "outcome").agg(F.count(F.lit(1)).alias("records"))


def refresh(spark: SparkSession, path: str) -> int:
    """Summarize what is new; the number of appends that were read."""
    read = 0
    while True:
        last = next(newest_records(spark, f"{path}/{LOG}"), {"number": -1, "upto": -1, "open": []})
        newest = last_number(spark, f"{path}/{APPENDS}")
        upto = min(newest, last["upto"] + AT_ONCE)
        found = [n for n in [*last["open"], *range(last["upto"] + 1, upto + 1)]]
        done = [n for n in found if exists(spark, f"{append_folder(path, n)}/_SUCCESS")]
        if not done and upto == last["upto"]:
            return read
        folder = uuid.uuid4().hex if done else None
        if done:
            lines = spark.read.text([append_folder(path, n) for n in done])
            _counts(lines).coalesce(1).write.parquet(f"{path}/{SUMMARIES}/{folder}")
        waiting = sorted(set(found) - set(done))
        record = {"upto": upto, "open": waiting, "folder": folder}
        # Another writer may have been first: its record counts, and this folder is never listed.
        if create_numbered(spark, f"{path}/{LOG}", last["number"] + 1, record):
            read += len(done)


def outcome_summary(spark: SparkSession, path: str) -> DataFrame:
    """``kind, outcome, records`` of all complete appends; rejected lines have no outcome."""
    refresh(spark, path)
    folders = [r["folder"] for r in newest_records(spark, f"{path}/{LOG}") if r["folder"]]
    if not folders:
        return spark.createDataFrame([], SCHEMA)
    stored = spark.read.schema(SCHEMA).parquet(*[f"{path}/{SUMMARIES}/{f}" for f in folders])
    return stored.groupBy("kind", "outcome").agg(F.sum("records").alias("records"))
