"""Masking of whole tables and of positional text rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewarden import vocab
from tablewarden.functions.masks import mask_as, mask_by_category
from tablewarden.functions.render import as_text, by_position
from tablewarden.operators.classify import Classification
from tablewarden.operators.joins import spread_join
from tablewarden.refusals import InternalFailure, MaskingRefused


def mask_preflight(column_count: int, classes: Classification) -> None:
    """Check the metadata before a plan is built; raises instead of releasing.

    Order: width, then category contract, then the flag, then attribution.
    """
    if len(classes.columns) != column_count:
        raise InternalFailure(vocab.STRUCTURAL_MISMATCH)
    if any((c.data_class == vocab.PII) != (c.category is not None) for c in classes.columns):
        raise InternalFailure(vocab.INVALID_CLASSIFICATION)
    unattributed = any(c.data_class == vocab.UNATTRIBUTED for c in classes.columns)
    if classes.fully_attributed == unattributed:
        raise InternalFailure(vocab.INVALID_CLASSIFICATION)
    if unattributed:
        raise MaskingRefused(vocab.UNATTRIBUTED_COLUMN, column_count)


def mask_table(df: DataFrame, classes: Classification) -> DataFrame:
    """Mask the PII ordinals; every other column keeps its value and type.

    One projection, no shuffle. Columns go by ordinal, so duplicate names are
    fine. A PII column that is not text is rendered as text first.
    """
    mask_preflight(len(df.columns), classes)
    positional = by_position(df)
    columns = []
    for i, (field, cls) in enumerate(zip(df.schema.fields, classes.columns)):
        value = F.col(f"_{i}")
        if cls.data_class == vocab.PII:
            if not isinstance(field.dataType, T.StringType):
                value = as_text(value, field.dataType)
            value = mask_as(cls.category, value)
        columns.append(value.alias(field.name))
    return positional.select(*columns)


def _preflighted(rows: DataFrame, classified: DataFrame) -> DataFrame:
    """Classified statements with ``masking_failure``, NULL when rows may be masked.

    ``rows(statement_id, row_no, cells)`` is reduced to its widths per statement
    before the shuffle, so a statement with very many rows stays one small group.
    """
    widths = rows.groupBy("statement_id").agg(
        F.min(F.array_size("cells")).alias("_narrowest"), F.max(F.array_size("cells")).alias("_widest")
    )
    width = F.array_size("column_classes")
    broken_contract = F.exists(
        "column_classes",
        lambda c: (c["data_class"] == vocab.PII) != c["category"].isNotNull(),
    )
    unattributed = F.exists("column_classes", lambda c: c["data_class"] == vocab.UNATTRIBUTED)
    reason = (
        F.when(
            (width != F.array_size("result_columns"))
            | (F.col("_narrowest") != width)
            | (F.col("_widest") != width),
            F.lit(vocab.STRUCTURAL_MISMATCH),
        )
        .when(broken_contract, F.lit(vocab.INVALID_CLASSIFICATION))
        .when(F.col("fully_attributed") == unattributed, F.lit(vocab.INVALID_CLASSIFICATION))
        .when(unattributed, F.lit(vocab.UNATTRIBUTED_COLUMN))
    )
    return classified.join(widths, "statement_id", "left").withColumn("masking_failure", reason)


def positional_refusals(rows: DataFrame, classified: DataFrame) -> DataFrame:
    """Statements whose rows or classes fail the preflight, with the reason."""
    return (
        _preflighted(rows, classified)
        .filter(F.col("masking_failure").isNotNull())
        .select("statement_id", "masking_failure")
    )


def mask_positional_rows(rows: DataFrame, classified: DataFrame) -> DataFrame:
    """Mask ``cells array<string>`` by the classes of each row's statement.

    Rows of refused statements are absent; a statement is released whole or not
    at all. Only the rows side can be skewed; its rows are spread by row number.
    """
    released = (
        _preflighted(rows, classified)
        .filter(F.col("masking_failure").isNull())
        .select(
            F.col("statement_id").alias("_released"),
            F.transform("column_classes", lambda c: c["category"]).alias("_categories"),
        )
    )
    joined = spread_join(rows, released, "statement_id", "_released", ["row_no"])
    return joined.select(
        "statement_id",
        "row_no",
        F.zip_with("cells", "_categories", lambda v, c: mask_by_category(c, v)).alias("cells"),
    )
