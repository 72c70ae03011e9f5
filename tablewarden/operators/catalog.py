"""Column catalogs: neutral types of columns, and which of them are PII."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden import vocab
from tablewarden.functions.render import neutral_type, neutral_type_of_number
from tablewarden.operators.classify import lookup_in_table

CATALOG_SCHEMA = "table_name string, ordinal int, column_name string, neutral_type string"
MAPPING_SCHEMA = "column_name string, category string"


def column_catalog(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Columns of known tables; built from schemas the driver has, no data is read."""
    rows = [
        (table, ordinal, field.name, neutral_type(field.dataType))
        for table, df in tables.items()
        for ordinal, field in enumerate(df.schema.fields)
    ]
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


def result_catalog(results: DataFrame) -> DataFrame:
    """One row per column of every statement's result.

    Reads ``statement_id`` and ``result_types array<struct<name,type_number>>``.
    """
    return results.select(
        "statement_id", F.posexplode_outer("result_types").alias("ordinal", "_column")
    ).filter("ordinal IS NOT NULL").select(
        "statement_id",
        "ordinal",
        F.col("_column.name").alias("column_name"),
        neutral_type_of_number(F.col("_column.type_number")).alias("neutral_type"),
    )


def mapping_table(spark: SparkSession, pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    return spark.createDataFrame(pairs or vocab.DEFAULT_MAPPING, MAPPING_SCHEMA)


def pii_catalog(columns: DataFrame, mapping: DataFrame) -> DataFrame:
    """Each distinct column name and type with its class and how often it occurs.

    Names are counted before the lookup, so a name that most results share costs
    one row.
    """
    counted = columns.groupBy("column_name", "neutral_type").agg(
        F.count("*").alias("occurrences")
    )
    return lookup_in_table(counted, "column_name", mapping)
