"""Guarded reads: what is masked, what is refused, and that refusing starts no job."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tablewarden import vocab
from tablewarden.functions.render import json_rows
from tablewarden.operators.catalog import column_catalog, mapping_table, pii_catalog
from tablewarden.operators.classify import (
    Classification,
    ColumnClass,
    Mapping,
    classify_schema,
)
from tablewarden.operators.masking import mask_preflight, mask_table
from tablewarden.operators.projection import Col, Computed, CountStar, Star, shape_of
from tablewarden.plans.guarded import guard, guarded_read
from tablewarden.refusals import InternalFailure, MaskingRefused, PolicyRejected, QueryFailed

# One row per rule of the masks: shown in part, too short, malformed, empty, absent.
CUSTOMERS = [
    (21, "Uma", "uma@one.example", None, "3700-0000-0000-002"),
    (22, "Vic", None, "0161 496 0000", ""),
    (23, "Wen", "w@two.example", "440", "12"),
    (24, None, "", "(020) 7946-0958", "4000 0000 0000 9995"),
    (25, "Yan", "nobody", "", None),
    (26, "Zoe", "zoe@@one.example", "555-01-99", "x1y2z3w4v5u6t7"),
]


@pytest.fixture(scope="module")
def customers(spark):
    return spark.createDataFrame(
        CUSTOMERS, "id int, name string, email string, phone string, credit_card string"
    ).alias("c")


@pytest.fixture(scope="module")
def orders(spark):
    return spark.createDataFrame(
        [(i, 21 + i % 4, 3.5 * i) for i in range(1, 8) if i % 4 != 2],
        "id int, customer_id int, amount double",
    ).alias("o")


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_wildcard_masks_by_result_name(customers):
    got = rows(guarded_read(customers, [Star()], order_by=["id"]))
    assert got == [
        (21, "Uma", "u***@one.example", None, "****0002"),
        (22, "Vic", None, "***0000", ""),
        (23, "Wen", "w***@two.example", "***", "***"),
        (24, None, "", "***0958", "****9995"),
        (25, "Yan", "***", "", None),
        (26, "Zoe", "***", "***0199", "***"),
    ]


def test_alias_does_not_hide_the_source_or_fake_one(customers):
    df = guarded_read(customers, [Col("c.EMAIL", "x"), Col("name", "email")], order_by=["id"])
    assert df.columns == ["x", "email"]
    assert rows(df)[0] == ("u***@one.example", "Uma")


def test_duplicate_columns_keep_names_and_are_both_masked(customers):
    df = guarded_read(customers, [Col("email"), Col("email")], order_by=["id"], limit=1)
    assert df.columns == ["email", "email"]
    assert [r.row for r in json_rows(df).collect()] == ['["u***@one.example","u***@one.example"]']


def test_join_and_qualified_wildcard(customers, orders):
    joined = customers.join(orders, F.col("c.id") == F.col("o.customer_id"))
    got = rows(guarded_read(joined, [Col("c.email"), Col("o.amount")], order_by=["amount"]))
    assert got == [(None, 3.5), ("", 10.5), ("u***@one.example", 14.0), (None, 17.5), ("", 24.5)]
    assert rows(guarded_read(joined, [Star("c")], order_by=["o.id"], limit=1))[0][3] == "***0000"


def test_filter_and_order_see_raw_values(customers):
    picked = customers.filter("email = 'w@two.example'")
    assert rows(guarded_read(picked, [Col("email")])) == [("w***@two.example",)]
    got = rows(guarded_read(customers, [Col("phone")], order_by=[F.desc("email")], limit=2))
    assert got == [("***0199",), ("***",)]


def test_count_star_is_never_masked_whatever_its_alias(customers):
    df = guarded_read(customers, [CountStar("email"), CountStar()])
    assert df.columns == ["email", "count"] and rows(df) == [(6, 6)]


def test_group_by_of_plain_columns_and_having(customers, orders):
    got = guarded_read(
        orders, [Col("customer_id")], group_by=["customer_id"], having=F.count("*") > 1
    )
    assert sorted(rows(got)) == [(22,), (24,)]
    assert rows(guarded_read(customers, [Col("email")], distinct=True, order_by=["email"]))[:3] == [
        (None,), ("",), ("***",),
    ]


def test_zero_rows_keep_the_columns(customers):
    df = guarded_read(customers.filter("id < 0"), [Star()])
    assert df.columns == ["id", "name", "email", "phone", "credit_card"] and rows(df) == []


REFUSED_BY_SHAPE = {
    "function": lambda: [Computed(F.upper("email"))],
    "literal": lambda: [Computed(F.lit(1))],
    "column and function": lambda: [Col("id"), Computed(F.upper("email"))],
    "wildcard and function": lambda: [Star(), Computed(F.upper("email"), "x")],
    "count of a literal": lambda: [Computed(F.count(F.lit(1)))],
    "count of a column": lambda: [Computed(F.count("email"))],
    "count distinct": lambda: [Computed(F.count_distinct("email"))],
    "windowed count": lambda: [Computed(F.count("*").over(Window.partitionBy("id")))],
    "count plus one": lambda: [Computed(F.count("*") + 1)],
    "count and count of a column": lambda: [CountStar(), Computed(F.count("email"))],
    "minimum": lambda: [Computed(F.min("email"))],
    "maximum": lambda: [Computed(F.max("credit_card"))],
    "sum": lambda: [Computed(F.sum("id"))],
    "average": lambda: [Computed(F.avg("id"))],
}


@pytest.mark.parametrize("name", REFUSED_BY_SHAPE)
def test_unattributable_shapes_are_refused(customers, name):
    with pytest.raises(MaskingRefused) as refused:
        guarded_read(customers, REFUSED_BY_SHAPE[name]())
    assert refused.value.reason == vocab.UNATTRIBUTED_COLUMN
    assert refused.value.client_code == "masking_refused"


def test_grouped_count_is_refused(customers):
    with pytest.raises(MaskingRefused):
        guarded_read(customers, [CountStar()], group_by=["email"])
    with pytest.raises(MaskingRefused):
        guarded_read(customers, [Col("email"), CountStar()], group_by=["email"])


def test_bare_column_next_to_a_count_fails_in_analysis(customers):
    for spec in ([CountStar(), Col("email")], [CountStar(), Star()]):
        with pytest.raises(QueryFailed):
            guarded_read(customers, spec)


def test_unknown_column_fails_in_analysis(customers):
    with pytest.raises(QueryFailed):
        guarded_read(customers, [Col("no_such_column")])


def test_policy_comes_before_everything(customers):
    with pytest.raises(PolicyRejected) as mixed:
        guarded_read(customers, [Star(), Col("credit_card", "x")])
    assert mixed.value.reason == vocab.REASON_UNATTRIBUTABLE
    for table in ("pg_authid", "PG_CATALOG.x", "public.pg_x", "information_schema.tables"):
        with pytest.raises(PolicyRejected) as system:
            guarded_read(customers, [Star()], tables=["customers", table])
        assert system.value.reason == vocab.REASON_SYSTEM_TABLE
    guard(customers, [Star()], tables=["pgcustomers", "mypg_table"])


def test_refusal_starts_no_job(spark, customers):
    spark.sparkContext.setJobGroup("refusals", "none may start")
    for spec in REFUSED_BY_SHAPE.values():
        with pytest.raises(MaskingRefused):
            guarded_read(customers, spec())
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("refusals")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_custom_mapping_replaces_the_defaults(customers):
    mapping = Mapping([("NAME", vocab.EMAIL), ("id", vocab.PHONE)])
    got = rows(guarded_read(customers, [Col("id"), Col("name"), Col("email")], mapping, order_by=["id"]))
    assert got[0] == ("***", "***", "uma@one.example")


def test_mapping_collision_is_refused():
    with pytest.raises(ValueError):
        Mapping([("email", vocab.EMAIL), ("EMAIL", vocab.PHONE)])
    Mapping([("k", vocab.EMAIL), ("K", vocab.PHONE)])


def test_preflight_order():
    pii, plain = ColumnClass(vocab.PII, vocab.EMAIL), ColumnClass(vocab.NOT_PII)
    cases = [
        (Classification([plain], True), 2, InternalFailure, vocab.STRUCTURAL_MISMATCH),
        (Classification([ColumnClass(vocab.PII)], True), 1, InternalFailure, vocab.INVALID_CLASSIFICATION),
        (Classification([ColumnClass(vocab.NOT_PII, vocab.EMAIL)], True), 1, InternalFailure, vocab.INVALID_CLASSIFICATION),
        (Classification([pii], False), 1, InternalFailure, vocab.INVALID_CLASSIFICATION),
        (Classification([ColumnClass()], True), 1, InternalFailure, vocab.INVALID_CLASSIFICATION),
        (Classification([pii, ColumnClass()], False), 2, MaskingRefused, vocab.UNATTRIBUTED_COLUMN),
    ]
    for classes, width, error, reason in cases:
        with pytest.raises(error) as raised:
            mask_preflight(width, classes)
        assert raised.value.reason == reason
    mask_preflight(0, Classification([], True))


def test_pii_looking_value_in_a_plain_column_is_kept(spark):
    df = spark.createDataFrame([("k@l.example", "k@l.example")], "note string, email string")
    classes = classify_schema(shape_of([Star()]), df.columns)
    assert rows(mask_table(df, classes)) == [("k@l.example", "k***@l.example")]


def test_count_mismatch_classifies_nothing():
    shape = shape_of([Col("email"), Col("id")])
    classes = classify_schema(shape, ["email"])
    assert not classes.fully_attributed
    assert [c.data_class for c in classes.columns] == [vocab.UNATTRIBUTED]
    assert classify_schema(shape, []).fully_attributed


def test_catalog_of_known_tables(spark, customers, orders):
    columns = column_catalog(spark, {"customers": customers, "orders": orders})
    report = {
        (r.column_name, r.neutral_type): (r.category, r.occurrences)
        for r in pii_catalog(columns, mapping_table(spark)).collect()
    }
    assert report[("email", "Text")] == (vocab.EMAIL, 1)
    assert report[("id", "Integer")] == (None, 2)
    assert report[("amount", "Float")] == (None, 1)


@pytest.mark.parametrize("source", ["`email`", "c.`email`", "`c`.`email`"])
def test_quoted_names_are_refused(customers, source):
    with pytest.raises(MaskingRefused):
        guard(customers, [Col(source, "x")])


def test_names_equal_only_by_unicode_case_are_refused(spark):
    df = spark.createDataFrame([("secret",)], "token string")
    with pytest.raises((MaskingRefused, QueryFailed)):
        guard(df, [Col("to\u212aen")], Mapping([("token", vocab.EMAIL)]))


def test_having_needs_group_by(customers):
    with pytest.raises(QueryFailed):
        guard(customers, [Col("name")], having=F.count("*") > 5)


def test_distinct_counts_with_group_by(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "name string, n int")
    got = guarded_read(df, [Col("name")], group_by=["name", "n"], distinct=True)
    assert [r.name for r in got.collect()] == ["a"]
