"""String rules as native Column expressions.

Every regular expression is anchored with ``\\A`` and ``\\z``: Java's ``$``
also matches before a trailing newline.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewarden import vocab


def ascii_lower(value: Column) -> Column:
    """Lower A-Z only. ``lower()`` would also fold letters such as U+212A."""
    return F.translate(value, ascii_uppercase, ascii_lowercase)


def strip_qualifier(name: Column) -> Column:
    """``c.email`` -> ``email``: the text after the last dot."""
    return F.substring_index(name, ".", -1)


def qualified_name(schema: Column, name: Column) -> Column:
    """``schema.name``, or the bare name when there is no schema."""
    return F.when(F.coalesce(schema, F.lit("")) == "", name).otherwise(
        F.concat_ws(".", schema, name)
    )


def is_blank(text: Column) -> Column:
    """Only space, tab, LF, CR, FF or VT; NULL counts as blank."""
    return F.coalesce(text.rlike(r"\A[ \t\n\r\f\x0B]*\z"), F.lit(True))


# No identifier can hold a NUL character, so joined names stay apart.
_NUL = "\x00"

# What makes a name a system table, and what a valid name looks like.
_SYSTEM_NAME = r"(?:pg_catalog\.|information_schema\.|[^.\x00]*\.pg_|pg_[^.\x00]*(?:\x00|\z))"
_PLAIN_NAME = rf"[A-Za-z_][A-Za-z0-9_$]{{0,{vocab.MAX_TABLE_NAME_BYTES - 1}}}"


def any_system_table(names: Column) -> Column:
    """A catalog schema, or a table part that starts with ``pg_``, in any ASCII case.

    A name splits at its first dot; an unqualified name is all table part. The
    list is tested as one text, which keeps the check inside generated code. A
    NULL name counts as a hit.
    """
    joined = F.array_join(names, _NUL, null_replacement="pg_")
    return joined.rlike(rf"(?i)(?:\A|\x00){_SYSTEM_NAME}")


def all_valid_table_names(names: Column) -> Column:
    """Every name is a plain unqualified ASCII identifier of at most 63 bytes."""
    joined = F.array_join(names, _NUL, null_replacement="?")
    return joined.rlike(rf"\A{_PLAIN_NAME}(?:\x00{_PLAIN_NAME})*\z")


def valid_table_name(name: Column) -> Column:
    return name.rlike(rf"\A{_PLAIN_NAME}\z")


def statement_class(statement_type: Column) -> Column:
    """SELECT, DML, DDL or UNKNOWN; anything unlisted, NULL included, is UNKNOWN."""
    return (
        F.when(statement_type == "SELECT", F.lit("SELECT"))
        .when(statement_type.isin(vocab.DML_TYPES), F.lit("DML"))
        .when(statement_type.isin(vocab.DDL_TYPES), F.lit("DDL"))
        .otherwise(F.lit("UNKNOWN"))
    )


def format_utc_timestamp(epoch_ms: Column) -> Column:
    """Epoch milliseconds -> ``YYYY-MM-DDTHH:MM:SS.mmmZ``.

    Built from a zone-free timestamp, so the session time zone has no part in it.
    """
    ms = epoch_ms.cast("bigint")
    millis = F.pmod(ms, F.lit(1000))
    seconds = ((ms - millis) / F.lit(1000)).cast("bigint")
    moment = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), seconds
    )
    return F.concat(
        F.translate(moment.cast("string"), " ", "T"),
        F.lit("."),
        F.lpad(millis.cast("string"), 3, "0"),
        F.lit("Z"),
    )


def utc_timestamp_shape(text: Column) -> Column:
    """True when the text has the 24-character shape written above."""
    return text.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{3}Z\z")


def text_array(csv: Column) -> Column:
    """Comma list -> array; the empty text is the empty array, not ``['']``."""
    return F.when(csv == "", F.array().cast("array<string>")).otherwise(F.split(csv, ","))
