"""Small records that are created once, whole, and never changed.

A record is a JSON file that appears under its name by a rename that refuses to replace anything, so of
two writers one wins and the other is told, and a reader sees a record whole or not at all. Numbered
records give an order: a later one supersedes an earlier one, which stays. This is the driver's
bookkeeping, one record per append or release; rows are written by Spark.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

PER_FOLDER = 10_000
DIGITS = 12


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def create_once(spark: SparkSession, path: str, record: dict) -> bool:
    """Write ``record`` at ``path``; False if there is one already."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, fs = _path(spark, path)
    if fs.exists(target):
        return False
    draft = hadoop.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(json.dumps(record, sort_keys=True).encode() + b"\n"))
    finally:
        out.close()
    options = spark._sc._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.NONE
    try:
        context = hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
        context.rename(fs.makeQualified(draft), fs.makeQualified(target), options)
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" not in error.java_exception.getClass().getName():
            raise
        fs.delete(draft, False)  # the loser's draft of this very call
        return False
    return True


def read_record(spark: SparkSession, path: str) -> dict | None:
    target, fs = _path(spark, path)
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return json.loads(text)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, hidden ones left out; none if there is no such folder."""
    target, fs = _path(spark, folder)
    if not fs.exists(target):
        return []
    found = [status.getPath().getName() for status in fs.listStatus(target)]
    return sorted(name for name in found if not name.startswith("."))


def exists(spark: SparkSession, path: str) -> bool:
    target, fs = _path(spark, path)
    return fs.exists(target)


def _numbered(folder: str, number: int) -> str:
    return f"{folder}/{number // PER_FOLDER:0{DIGITS}d}/{number:0{DIGITS}d}.json"


def last_number(spark: SparkSession, folder: str) -> int:
    """The highest number in use, -1 if none is; two short listings."""
    for part in reversed(names(spark, folder)):
        inside = names(spark, f"{folder}/{part}")
        if inside:
            return int(inside[-1].removesuffix(".json"))
    return -1


def create_numbered(spark: SparkSession, folder: str, number: int, record: dict) -> bool:
    """Write ``record`` under that number; False if it is taken."""
    return create_once(spark, _numbered(folder, number), {**record, "number": number})


def append_record(spark: SparkSession, folder: str, record: dict) -> int:
    """Write ``record`` under the next free number of ``folder``."""
    number = last_number(spark, folder) + 1
    while not create_numbered(spark, folder, number, record):
        number += 1
    return number


def newest_records(spark: SparkSession, folder: str):
    """Records of a numbered folder, newest first."""
    for part in reversed(names(spark, folder)):
        for name in reversed(names(spark, f"{folder}/{part}")):
            record = read_record(spark, f"{folder}/{part}/{name}")
            if record is not None:
                yield record


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder of the caller's own that nothing reads any more."""
    target, fs = _path(spark, path)
    fs.delete(target, True)
