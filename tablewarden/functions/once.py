"""Columns that are computed once, however often they are filtered on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns behind a one-row generator.

    Spark pushes a filter below the projection that computes its column and so
    computes that column twice, nested ones many times over. It does not push a
    filter below the generator that made the column.
    """
    made = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select("*", F.inline_outer(F.array(made)))
