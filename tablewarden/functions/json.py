"""Strict JSON objects as variants.

Spark's JSON functions stop after the first complete value and ignore what
follows it. Reading the text once inside an array and once inside an object
shows any such rest: nothing can close both brackets.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def json_object(text: Column) -> Column:
    """The text as a variant when it is one JSON object and nothing else, or NULL.

    With ``spark.sql.variant.allowDuplicateKeys`` the last of equal keys wins.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    boxed = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    alone = F.array_size(F.try_variant_get(listed, "$", "array<variant>")) == 1
    # Filtering a one-element array tests the value without parsing it again.
    value = F.array(F.try_variant_get(boxed, "$.v", "variant"))
    objects = F.filter(value, lambda v: F.startswith(_kind(v), F.lit("OBJECT")))
    return F.when(alone, F.get(objects, F.lit(0)))


def is_json_object(text: Column) -> Column:
    return json_object(text).isNotNull()


def is_json_text(value: Column) -> Column:
    """True when a variant holds a string."""
    return F.coalesce(_kind(value) == "STRING", F.lit(False))
