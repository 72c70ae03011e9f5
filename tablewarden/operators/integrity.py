"""Key constraints and the "a mask changes its value" invariant, as set checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.masks import mask_as
from tablewarden.operators.classify import Mapping


def unique_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once, or are NULL.

    Counted before the shuffle, so a value that fills a third of the table
    crosses it as one row per task.
    """
    found = df.groupBy(*keys).agg(F.count("*").alias("occurrences"))
    any_null = F.lit(False)
    for key in keys:
        any_null = any_null | F.col(key).isNull()
    return found.filter((F.col("occurrences") > 1) | any_null)


def orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose key has no parent row; a NULL key is no orphan."""
    parents = parent.select(F.col(parent_key).alias("_parent"))
    return child.filter(F.col(child_key).isNotNull()).join(
        parents, F.col(child_key) == F.col("_parent"), "left_anti"
    )


def never_unchanged(df: DataFrame, mapping: Mapping | None = None) -> DataFrame:
    """Per mapped column: non-empty values, and how many equal their own mask.

    A value that is spelled like its own mask (``***``) is the one way to a
    count above zero.
    """
    mapping = mapping or Mapping()
    mapped = [(c, mapping.category_of(c)) for c in df.columns if mapping.category_of(c)]
    cells = F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("column_name"),
                    F.col(name).alias("value"),
                    mask_as(category, F.col(name)).alias("masked"),
                )
                for name, category in mapped
            ]
        )
    )
    return (
        df.select(cells)
        .filter("value <> ''")
        .groupBy("column_name")
        .agg(
            F.count("*").alias("checked"),
            F.count_if(F.col("value") == F.col("masked")).alias("unchanged"),
        )
    )


def null_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column_name, nulls`` of the columns that must not hold NULL and do; one pass, one row per task."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    listed = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in columns])
    return counted.select(F.explode(listed).alias("_c")).select("_c.*").filter("nulls > 0")
