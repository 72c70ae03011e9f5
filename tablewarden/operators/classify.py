"""Column classification from metadata alone.

``classify_schema`` answers for one result on the driver without starting a job;
``classify_bulk`` answers for a whole table of statements in one narrow
projection. Both fail closed: a shape that cannot be attributed leaves every
column Unattributed.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden import vocab
from tablewarden.functions.text import ascii_lower, strip_qualifier
from tablewarden.operators.joins import hashable, spread_join
from tablewarden.operators.projection import Shape

_ASCII_FOLD = {upper: upper + 32 for upper in range(ord("A"), ord("Z") + 1)}


def fold(name: str) -> str:
    """ASCII-only lowering of a driver-side name."""
    return name.translate(_ASCII_FOLD)


class Mapping:
    """Column name -> category, matched without regard to ASCII case.

    A user mapping replaces the defaults. Two names equal after folding are a
    configuration error.
    """

    def __init__(self, pairs: Iterable[tuple[str, str]] = vocab.DEFAULT_MAPPING):
        self.categories: dict[str, str] = {}
        for name, category in pairs:
            key = fold(name)
            if key in self.categories:
                raise ValueError(f"mapping names collide when case is ignored: '{key}'")
            self.categories[key] = category

    def category_of(self, name: str) -> str | None:
        return self.categories.get(fold(name))

    def lookup(self, key: Column) -> Column:
        """Category of an already folded name, NULL on a miss.

        One set membership test per category, so cost does not grow with the
        number of mapped names and no join is needed.
        """
        found = F.lit(None).cast("string")
        for category in sorted(set(self.categories.values())):
            names = [k for k, v in self.categories.items() if v == category]
            found = F.when(key.isin(names), F.lit(category)).otherwise(found)
        return found


@dataclass(frozen=True)
class ColumnClass:
    data_class: str = vocab.UNATTRIBUTED
    category: str | None = None


@dataclass(frozen=True)
class Classification:
    columns: list[ColumnClass]
    fully_attributed: bool

    def count_of(self, category: str) -> int:
        return sum(c.category == category for c in self.columns)


def classify_schema(
    shape: Shape, result_names: list[str], mapping: Mapping | None = None
) -> Classification:
    """Classes of one result's columns, by ordinal."""
    mapping = mapping or Mapping()
    if shape.positional and len(shape.projection_columns) == len(result_names):
        names = [source.rsplit(".", 1)[-1] for source in shape.projection_columns]
    elif shape.wildcard_only:
        names = result_names
    elif shape.count_star_only:
        return Classification([ColumnClass(vocab.NOT_PII) for _ in result_names], True)
    else:
        return Classification([ColumnClass() for _ in result_names], not result_names)
    found = [mapping.category_of(name) for name in names]
    return Classification(
        [ColumnClass(vocab.PII if c else vocab.NOT_PII, c) for c in found], True
    )


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _absent(name: str) -> Column:
    """True only when the flag is known to be false."""
    return ~F.coalesce(F.col(name), F.lit(True))


def with_attribution_mode(facts: DataFrame) -> DataFrame:
    """Add ``attribution``: POSITIONAL, WILDCARD, COUNT_STAR or NULL (refuse).

    Reads ``status``, ``statement_type``, the projection facts and
    ``result_columns array<string>``.
    """
    analyzable = (F.col("status") == vocab.OK) & (F.col("statement_type") == "SELECT")
    listed = F.array_size("projection_columns")
    computed_free = _absent("has_computed_projection")
    positional = (
        computed_free
        & _absent("has_wildcard_projection")
        & _absent("has_safe_count_star_projection")
        & (listed > 0)
        & (listed == F.array_size("result_columns"))
    )
    wildcard = (
        computed_free
        & _flag("has_wildcard_projection")
        & _absent("has_safe_count_star_projection")
        & (listed == 0)
    )
    count_star = (
        computed_free
        & _flag("has_safe_count_star_projection")
        & _absent("has_wildcard_projection")
        & _absent("has_group_by")
        & (listed == 0)
    )
    return facts.withColumn(
        "attribution",
        F.when(
            analyzable,
            F.when(positional, F.lit("POSITIONAL"))
            .when(wildcard, F.lit("WILDCARD"))
            .when(count_star, F.lit("COUNT_STAR")),
        ),
    )


def classify_bulk(facts: DataFrame, mapping: Mapping | None = None) -> DataFrame:
    """Add ``column_classes`` and ``fully_attributed`` to every statement.

    Works on the arrays in place: one projection, no explode, no join, no
    shuffle. Use ``explode_classes`` for one row per column. Arrays are passed
    from one higher-order function to the next as arguments, never captured in a
    lambda, so each is built once per statement.
    """
    mapping = mapping or Mapping()
    mode = F.col("attribution")
    names = F.col("result_columns")
    # The name each column is judged by; a count is judged by none.
    judged_by = (
        F.when(mode == "POSITIONAL", F.transform("projection_columns", strip_qualifier))
        .when(mode == "WILDCARD", names)
        .otherwise(F.transform(names, lambda _: F.lit(None).cast("string")))
    )
    categories = F.transform(F.transform(judged_by, ascii_lower), mapping.lookup)

    def class_of(name: Column, data_class: Column, category: Column, ordinal: Column) -> Column:
        return F.struct(
            ordinal.alias("ordinal"),
            name.alias("column_name"),
            data_class.alias("data_class"),
            category.alias("category"),
        )

    unattributed = F.transform(
        names,
        lambda name, i: class_of(
            name, F.lit(vocab.UNATTRIBUTED), F.lit(None).cast("string"), i
        ),
    )
    paired = F.zip_with(
        names, categories, lambda n, c: F.struct(n.alias("name"), c.alias("category"))
    )
    attributed = F.transform(
        paired,
        lambda pair, i: class_of(
            pair["name"],
            F.when(pair["category"].isNotNull(), F.lit(vocab.PII)).otherwise(F.lit(vocab.NOT_PII)),
            pair["category"],
            i,
        ),
    )
    return with_attribution_mode(facts).select(
        "*",
        F.when(mode.isNull(), unattributed).otherwise(attributed).alias("column_classes"),
        F.coalesce(
            (mode.isNotNull() & F.col("result_columns").isNotNull()) | (F.array_size(names) == 0), F.lit(False)
        ).alias(
            "fully_attributed"
        ),
    )


def explode_classes(classified: DataFrame) -> DataFrame:
    """One row per statement and result column.

    The outer form, because for the plain one Spark adds a non-empty filter that
    repeats the whole classification.
    """
    return classified.select("statement_id", F.inline_outer("column_classes")).filter(
        "ordinal IS NOT NULL"
    )


def with_pii_counts(classified: DataFrame) -> DataFrame:
    """Add per-category column counts; the array holds them, so nothing is grouped."""

    def count_of(category: str) -> Column:
        hits = F.filter("column_classes", lambda c: c["category"] == category)
        return F.array_size(hits).cast("bigint")

    return classified.select(
        "*",
        count_of(vocab.EMAIL).alias("pii_email_columns"),
        count_of(vocab.PHONE).alias("pii_phone_columns"),
        count_of(vocab.CREDIT_CARD).alias("pii_credit_card_columns"),
    )


def lookup_in_table(names: DataFrame, name_column: str, mapping: DataFrame) -> DataFrame:
    """Categories from a mapping *table* (``column_name``, ``category``).

    Names that collide when case is ignored make the job fail: neither category
    would be right. Catalyst picks the join from the table's measured size. A
    third of all columns may be called ``id``: beyond a broadcast their rows are
    spread over copies of the mapping.
    """
    collision = F.raise_error(F.concat(F.lit("mapping names collide: "), F.col("_key")))
    keyed = (
        mapping.filter("column_name IS NOT NULL")
        .groupBy(ascii_lower(F.col("column_name")).alias("_key"))
        .agg(F.count("*").alias("_entries"), F.min("category").alias("category"))
        .select("_key", F.when(F.col("_entries") == 1, F.col("category")).otherwise(collision).alias("category"))
    )
    key = ascii_lower(strip_qualifier(F.col(name_column)))
    joined = spread_join(
        names.withColumn("_name_key", key), keyed, "_name_key", "_key", hashable(names), "left"
    )
    return joined.withColumn(
        "data_class",
        F.when(F.col("category").isNotNull(), F.lit(vocab.PII)).otherwise(F.lit(vocab.NOT_PII)),
    ).drop("_name_key", "_key")


def mapping_collisions(mapping: DataFrame) -> DataFrame:
    """Names that collide when case is ignored; must be empty for a usable mapping."""
    return (
        mapping.groupBy(ascii_lower(F.col("column_name")).alias("mapping_key"))
        .agg(F.count("*").alias("entries"))
        .filter("entries > 1")
    )
