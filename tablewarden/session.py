"""Session settings the jobs count on, and shared scratch space."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime settings only. Splitting skewed join partitions is what keeps one hot
# customer or statement from landing in a single task.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # The JVM leaves methods above this size uncompiled; Spark then splits the work
    # into smaller generated methods instead of one huge loop.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Of equal keys in one JSON object the last one counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Set the runtime settings above on an existing session."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "*", name: str = "tablewarden", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        # Without a stack trace per expression the driver makes half as many calls to build a plan.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only where a local session names none is a temporary folder used; the executors of a cluster would
    each write to their own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or local_scratch(spark.sparkContext.master)


def local_scratch(master: str) -> str:
    """The temporary folder of a session whose tasks run in the driver's own process."""
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "tablewarden-checkpoints")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder name per call, so two runs never share one."""
    return f"{scratch_root(spark).rstrip('/')}/tablewarden/{label}-{uuid.uuid4().hex}"
