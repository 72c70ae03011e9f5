"""Reading the base tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def scan_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def stream_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The same table as a file stream.

    The last letter is a glob, so that a table stored as one file and a table
    stored as a directory of part files both work as a stream source.
    """
    schema = scan_table(spark, directory, name).schema
    return spark.readStream.schema(schema).parquet(f"{directory}/{name}.parque[t]")
