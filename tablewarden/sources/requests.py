"""Raw request logs: JSON Lines of ``request_no``, ``content_type`` and ``body``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

REQUEST_SCHEMA = "request_no bigint, content_type string, body string"


def write_requests(requests: DataFrame, path: str) -> None:
    requests.select("request_no", "content_type", "body").write.mode("append").json(path)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REQUEST_SCHEMA).json(path)


def stream_requests(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(REQUEST_SCHEMA).json(path)
