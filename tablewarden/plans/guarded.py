"""Guarded read: decide, classify and mask one result before any job runs."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewarden import vocab
from tablewarden.operators.classify import Classification, Mapping, classify_schema, fold
from tablewarden.operators.masking import mask_table
from tablewarden.operators.projection import Col, Computed, CountStar, Entry, Star, shape_of
from tablewarden.plans.lineage import Origin, origins, tables_of
from tablewarden.refusals import MaskingRefused, PolicyRejected, QueryFailed

# Catalog schemas and prefix no guarded read may touch.
SYSTEM_SCHEMAS = ["pg_catalog", "information_schema"]
SYSTEM_PREFIX = "pg_"


@dataclass(frozen=True)
class GuardedResult:
    frame: DataFrame
    classes: Classification
    tables: list[str]


def _is_system_table(name: str) -> bool:
    schema, dot, table = fold(name).partition(".")
    if not dot:
        schema, table = "", schema
    return schema in SYSTEM_SCHEMAS or table.startswith(SYSTEM_PREFIX)


def _expression(entry: Entry) -> Column:
    match entry:
        case Col(source, alias):
            return F.col(source).alias(alias or source.rsplit(".", 1)[-1])
        case Star(qualifier):
            return F.col(f"{qualifier}.*" if qualifier else "*")
        case CountStar(alias):
            return F.count("*").alias(alias)
        case Computed(expression, alias):
            return expression.alias(alias) if alias else expression
    raise TypeError(f"not a projection entry: {entry!r}")


def _raw_result(
    relation: DataFrame,
    spec: Sequence[Entry],
    group_by: Sequence[str] | None,
    having: Column | None,
    distinct: bool,
    order_by: Sequence[Column | str],
    limit: int | None,
) -> DataFrame:
    """The unmasked result. Filters, grouping and order all see raw values."""
    selected = [_expression(e) for e in spec]
    if group_by is not None:
        counts = [_expression(e) for e in spec if isinstance(e, CountStar)]
        keep = F.lit(True) if having is None else having
        grouped = relation.groupBy(*group_by).agg(keep.alias("_having"), *counts)
        plain = [F.col(e.alias) if isinstance(e, CountStar) else _expression(e) for e in spec]
        raw = grouped.filter("_having")
        raw = raw.orderBy(*order_by) if order_by and not distinct else raw
        raw = raw.select(*plain)
        if distinct:
            raw = raw.distinct()
            raw = raw.orderBy(*order_by) if order_by else raw
    elif any(isinstance(e, CountStar) for e in spec):
        # Mixed with plain columns this fails in analysis, as in any SQL engine.
        raw = relation.agg(*selected) if all(
            isinstance(e, (CountStar, Computed)) for e in spec
        ) else relation.select(*selected)
    else:
        # Sorted before the projection, so ORDER BY may use columns not selected.
        raw = (relation.orderBy(*order_by) if order_by and not distinct else relation).select(
            *selected
        )
        if distinct:
            raw = raw.distinct()
            raw = raw.orderBy(*order_by) if order_by else raw
    return raw if limit is None else raw.limit(limit)


def _spelled_otherwise(relation: DataFrame, spec: Sequence[Entry]) -> bool:
    """A plain entry that resolved although no column has its name up to ASCII case.

    Quotes and Unicode case rules make Spark find a column that the mapping, which goes by the spelled
    name, would not.
    """
    known = {fold(c) for c in relation.columns}
    return any(fold(e.source.rsplit(".", 1)[-1]) not in known for e in spec if isinstance(e, Col))


def _field_names(kind: T.DataType) -> Iterator[str]:
    """Names of all fields inside a nested type."""
    match kind:
        case T.StructType(fields=fields):
            for f in fields:
                yield f.name
                yield from _field_names(f.dataType)
        case T.ArrayType(elementType=inner):
            yield from _field_names(inner)
        case T.MapType(keyType=key, valueType=value):
            yield from _field_names(key)
            yield from _field_names(value)


def _derived(
    relation: DataFrame, spec: Sequence[Entry], names: Sequence[str], mapping: Mapping
) -> bool:
    """Whether some selected column must not be judged by its name.

    That is one that no table column gives unchanged, one whose table column is of another category
    than its name says, and one with a nested field of a category.
    """
    chosen = relation.select(*[_expression(Col(e.source) if isinstance(e, Col) else e) for e in spec])

    def hidden(name: str, kind: T.DataType, found: frozenset[Origin] | None) -> bool:
        if found is None or any(mapping.category_of(n) for n in _field_names(kind)):
            return True
        parts = {mapping.category_of(part) for origin in found for part in origin.path}
        return bool(parts - {None, mapping.category_of(name)})

    kinds = [f.dataType for f in chosen.schema.fields]
    return any(map(hidden, names, kinds, origins(chosen)))


def guard(
    relation: DataFrame,
    spec: Iterable[Entry],
    mapping: Mapping | None = None,
    *,
    tables: Sequence[str] = (),
    group_by: Sequence[str] | None = None,
    having: Column | None = None,
    distinct: bool = False,
    order_by: Sequence[Column | str] = (),
    limit: int | None = None,
) -> GuardedResult:
    """Mask the result of a projection over ``relation``, or refuse.

    ``relation`` is base tables put together with filters, joins and unions. Every
    selected column is followed down the analysed plan to a table's column; one
    that was computed on the way, that hides a PII column under another name or
    that nests one is refused. The tables' names are read off the plan, for
    policy and audit; ``tables`` adds names that the plan does not show.

    Refusals come from metadata only and no job has started by then:
    ``PolicyRejected``, then ``QueryFailed`` when Spark cannot resolve the query,
    then ``MaskingRefused`` when a column cannot be attributed.
    """
    spec = list(spec)
    shape = shape_of(spec, grouped=group_by is not None)
    mapping = mapping or Mapping()
    tables = list(dict.fromkeys([*tables, *tables_of(relation)]))
    if any(_is_system_table(t) for t in tables):
        raise PolicyRejected(vocab.REASON_SYSTEM_TABLE)
    if having is not None and group_by is None:
        raise QueryFailed("HAVING needs GROUP BY")
    if shape.has_wildcard and shape.projection_columns:
        raise PolicyRejected(vocab.REASON_UNATTRIBUTABLE)
    try:
        raw = _raw_result(relation, spec, group_by, having, distinct, order_by, limit)
        names = raw.columns
    except AnalysisException as error:
        raise QueryFailed("the query was rejected") from error
    if _spelled_otherwise(relation, spec):
        raise MaskingRefused(vocab.UNATTRIBUTED_COLUMN, len(names))
    classes = classify_schema(shape, names, mapping)
    plain = [e.source.rsplit(".", 1)[-1] for e in spec if isinstance(e, Col)]
    if (shape.positional or shape.wildcard_only) and _derived(relation, spec, plain or names, mapping):
        raise MaskingRefused(vocab.UNATTRIBUTED_COLUMN, len(names))
    return GuardedResult(mask_table(raw, classes), classes, tables)


def guarded_read(
    relation: DataFrame, spec: Iterable[Entry], mapping: Mapping | None = None, **options
) -> DataFrame:
    """``guard`` for callers that only want the masked rows."""
    return guard(relation, spec, mapping, **options).frame
