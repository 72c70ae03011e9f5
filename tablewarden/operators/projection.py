"""What a select list is made of, and what that says about attribution.

A projection spec lists the entries of one guarded read. Each entry sets exactly
one fact: a plain column, a star, a canonical ``COUNT(*)``, or "computed". The
same facts exist in bulk form for tables of select-list entries.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.text import ascii_lower


@dataclass(frozen=True)
class Col:
    """A plain column such as ``email`` or ``c.email``."""

    source: str
    alias: str | None = None


@dataclass(frozen=True)
class Star:
    """``*``, or ``t.*`` with a qualifier."""

    qualifier: str | None = None


@dataclass(frozen=True)
class CountStar:
    """Ungrouped ``COUNT(*)``, the only computed entry that may be released."""

    alias: str = "count"


@dataclass(frozen=True)
class Computed:
    """Any other expression: functions, arithmetic, literals, window calls."""

    expression: Column
    alias: str | None = None


Entry = Col | Star | CountStar | Computed


@dataclass(frozen=True)
class Shape:
    """Facts of one select list."""

    projection_columns: list[str] = field(default_factory=list)
    has_wildcard: bool = False
    has_count_star: bool = False
    has_computed: bool = False
    has_group_by: bool = False

    @property
    def positional(self) -> bool:
        others = self.has_wildcard or self.has_count_star or self.has_computed
        return bool(self.projection_columns) and not others

    @property
    def wildcard_only(self) -> bool:
        others = self.projection_columns or self.has_count_star or self.has_computed
        return self.has_wildcard and not others

    @property
    def count_star_only(self) -> bool:
        others = self.projection_columns or self.has_wildcard or self.has_computed
        return self.has_count_star and not others and not self.has_group_by


def shape_of(spec: Iterable[Entry], grouped: bool = False) -> Shape:
    entries = list(spec)
    return Shape(
        projection_columns=[e.source for e in entries if isinstance(e, Col)],
        has_wildcard=any(isinstance(e, Star) for e in entries),
        has_count_star=any(isinstance(e, CountStar) for e in entries),
        has_computed=any(isinstance(e, Computed) for e in entries),
        has_group_by=grouped,
    )


# Bulk form: one array of entries per statement.
ENTRY_TYPE = (
    "struct<kind:string,name:string,arguments:array<string>,"
    "is_distinct:boolean,is_windowed:boolean>"
)
KIND_COLUMN = "COLUMN"
KIND_STAR = "STAR"
KIND_FUNCTION = "FUNCTION"


def is_count_star(entry: Column) -> Column:
    """Canonical ``COUNT(*)``: any case, not distinct, no window, the star alone.

    A NULL flag counts as set, so a gap in the facts never turns into a safe count.
    """
    call = (entry["kind"] == KIND_FUNCTION) & (ascii_lower(entry["name"]) == "count")
    plain = ~F.coalesce(entry["is_distinct"], F.lit(True)) & ~F.coalesce(
        entry["is_windowed"], F.lit(True)
    )
    return F.coalesce(call & plain & (entry["arguments"] == F.array(F.lit("*"))), F.lit(False))


# The aggregate functions that a select list may call.
AGGREGATES = ["count", "min", "max", "sum", "avg"]


def _function(entry: Column) -> Column:
    """The folded name of a function called without a window, NULL for any other entry."""
    plain = ~F.coalesce(entry["is_windowed"], F.lit(False))
    return F.when((entry["kind"] == KIND_FUNCTION) & plain, ascii_lower(entry["name"]))


def is_aggregate(entry: Column, names: list[str] = AGGREGATES) -> Column:
    return F.coalesce(_function(entry).isin(names), F.lit(False))


def is_count_variant(entry: Column) -> Column:
    """A ``COUNT`` other than the canonical one."""
    return is_aggregate(entry, ["count"]) & ~is_count_star(entry)


def is_windowed(entry: Column) -> Column:
    return F.coalesce(entry["is_windowed"], F.lit(False))


def reads_a_row(entry: Column) -> Column:
    """A column, a star or a window call: an entry that has a value per row."""
    return F.coalesce(entry["kind"].isin(KIND_COLUMN, KIND_STAR), F.lit(False)) | is_windowed(entry)


def with_list_refusal(statements: DataFrame, entries: str = "entries") -> DataFrame:
    """Add ``refusal``: what becomes of a select list, judged by its entries alone; NULL if it may be released.

    ``QUERY_FAILED`` where, without grouping, an aggregate stands beside a value per row: no engine runs
    that. Otherwise ``MASKING_REFUSED`` for what cannot be attributed: any computed entry, a count beside
    anything else, a count of groups, and an empty list.
    """
    items = F.col(entries)
    grouped = F.coalesce("has_group_by", F.lit(True))
    mixed = ~grouped & F.exists(items, lambda e: is_aggregate(e)) & F.exists(items, reads_a_row)
    plain = F.coalesce(
        F.forall(items, lambda e: F.coalesce(e["kind"].isin(KIND_COLUMN, KIND_STAR), F.lit(False)) & ~is_windowed(e)),
        F.lit(False),
    )
    stars = F.exists(items, lambda e: F.coalesce(e["kind"] == KIND_STAR, F.lit(False)))
    columns = F.exists(items, lambda e: F.coalesce(e["kind"] == KIND_COLUMN, F.lit(False)))
    listed = (F.size(items) > 0) & plain & ~(stars & columns)
    counted = (F.size(items) > 0) & ~grouped & F.coalesce(F.forall(items, is_count_star), F.lit(False))
    return statements.withColumn(
        "refusal",
        F.when(F.coalesce(mixed, F.lit(False)), F.lit("QUERY_FAILED")).when(
            ~F.coalesce(listed | counted, F.lit(False)), F.lit("MASKING_REFUSED")
        ),
    )


def with_projection_facts(statements: DataFrame, entries: str = "entries") -> DataFrame:
    """Add the projection facts of every statement; narrow, no shuffle."""
    items = F.col(entries)

    def is_column(e: Column) -> Column:
        return F.coalesce(e["kind"] == KIND_COLUMN, F.lit(False))

    def is_star(e: Column) -> Column:
        return F.coalesce(e["kind"] == KIND_STAR, F.lit(False))

    def is_other(e: Column) -> Column:
        return ~is_column(e) & ~is_star(e) & ~is_count_star(e)

    return statements.select(
        "*",
        F.transform(F.filter(items, is_column), lambda e: e["name"]).alias("projection_columns"),
        F.exists(items, is_star).alias("has_wildcard_projection"),
        F.exists(items, is_other).alias("has_computed_projection"),
        F.exists(items, is_count_star).alias("has_safe_count_star_projection"),
    )
