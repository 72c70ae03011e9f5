"""Typed values -> result text, and the neutral type of a Spark type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Order matters only in that the first matching family wins.
NEUTRAL_TYPES = [
    ("Text", (T.StringType, T.CharType, T.VarcharType)),
    ("Integer", (T.ByteType, T.ShortType, T.IntegerType, T.LongType)),
    ("Float", (T.FloatType, T.DoubleType)),
    ("Numeric", (T.DecimalType,)),
    ("Boolean", (T.BooleanType,)),
    ("Timestamp", (T.TimestampType, T.TimestampNTZType)),
    ("Date", (T.DateType,)),
]


def neutral_type(data_type: T.DataType) -> str:
    """Unlisted types are ``Other``, never a guess."""
    for name, family in NEUTRAL_TYPES:
        if isinstance(data_type, family):
            return name
    return "Other"


def as_text(value: Column, data_type: T.DataType) -> Column:
    """One cell as text; NULL stays NULL and is never the empty text.

    A whole float loses its ``.0``; binary is spelled as ``\\x`` and hex digits.
    """
    if isinstance(data_type, T.BooleanType):
        return F.when(value, F.lit("t")).when(~value, F.lit("f"))
    if isinstance(data_type, T.FractionalType) and not isinstance(data_type, T.DecimalType):
        return F.regexp_replace(value.cast("string"), r"\.0\z", "")
    if isinstance(data_type, T.BinaryType):
        return F.concat(F.lit("\\x"), F.lower(F.hex(value)))
    if isinstance(data_type, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.to_json(value)
    return value.cast("string")


def by_position(df: DataFrame) -> DataFrame:
    """Rename columns to ``_0, _1, ...`` so duplicate names can be told apart."""
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))])


def render_text(df: DataFrame) -> DataFrame:
    """Every column as text, names and order unchanged."""
    positional = by_position(df)
    return positional.select(
        *[
            as_text(F.col(f"_{i}"), field.dataType).alias(field.name)
            for i, field in enumerate(df.schema.fields)
        ]
    )


def json_rows(df: DataFrame) -> DataFrame:
    """One positional JSON array per row; NULL is ``null`` and ``''`` stays ``""``.

    Duplicate column names survive because the array has no names. The header
    (column names, row count) is a side record, see ``sources.release``.
    """
    positional = by_position(df)
    cells = [
        as_text(F.col(f"_{i}"), field.dataType) for i, field in enumerate(df.schema.fields)
    ]
    return positional.select(F.to_json(F.array(*cells)).alias("row"))


# Database type numbers of each neutral type.
TYPE_NUMBERS = {
    "Text": [25, 1043, 1042],
    "Integer": [20, 21, 23],
    "Float": [700, 701],
    "Numeric": [1700],
    "Boolean": [16],
    "Timestamp": [1114, 1184],
    "Date": [1082],
}


def neutral_type_of_number(number: Column) -> Column:
    """Neutral type of a result column's database type number; unlisted is ``Other``."""
    chain = F.when(number.isNull(), F.lit("Other"))
    for name, numbers in TYPE_NUMBERS.items():
        chain = chain.when(number.isin(numbers), F.lit(name))
    return chain.otherwise(F.lit("Other"))
