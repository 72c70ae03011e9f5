"""Golden values of the masking rules and of text rendering."""

import datetime
import decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewarden import vocab
from tablewarden.functions.masks import mask_as, mask_by_category
from tablewarden.functions.render import json_rows, neutral_type, render_text
from tablewarden.operators.integrity import never_unchanged



def mask_cases():
    """Inputs built from the rules: places and numbers of ``@``, and digit counts around the limits."""
    for local, domain in (("q", "d"), ("longer.name+tag", "mail.invalid"), ("Q9", "x\ny")):
        yield vocab.EMAIL, f"{local}@{domain}", f"{local[0]}***@{domain}"
    for first in ("é", "ß", "漢", "\U0001f40d"):
        yield vocab.EMAIL, f"{first}z@mail.invalid", "***@mail.invalid"
    for ats in (0, 2, 3):
        yield vocab.EMAIL, "@".join(["part"] * (ats + 1)) if ats else "part", "***"
    yield from ((vocab.EMAIL, text, "***") for text in ("@", "@d", "q@", "q@@d"))
    for count in range(1, 12):
        digits = "".join(str((7 * i + 3) % 10) for i in range(count))
        shown = f"***{digits[-4:]}" if count >= 7 else "***"
        for spelled in (digits, "-".join(digits), f"tel ({digits[:2]}) {digits[2:]}"):
            yield vocab.PHONE, spelled, shown
    yield vocab.PHONE, "none", "***"
    yield vocab.PHONE, "".join(chr(0x966 + i) for i in range(9)), "***"
    for count in range(10, 18):
        digits = "".join(str((3 * i + 2) % 10) for i in range(count))
        shown = f"****{digits[-4:]}" if count >= 12 else "***"
        for spelled in (digits, " ".join(digits), digits[:5] + "-" + digits[5:]):
            yield vocab.CREDIT_CARD, spelled, shown
        for stray in ("y", "\t", "\n", "."):
            yield vocab.CREDIT_CARD, digits[:3] + stray + digits[3:], "***"
        yield vocab.CREDIT_CARD, digits + "\n", "***"
    yield vocab.CREDIT_CARD, " - ", "***"
    yield "PII.Unknown", "whatever", "***"
    for category in (vocab.EMAIL, vocab.PHONE, vocab.CREDIT_CARD, "PII.Unknown"):
        yield from ((category, empty, empty) for empty in (None, ""))


GOLDEN = list(mask_cases())


def test_golden_values_by_plan_and_by_row(spark):
    df = spark.createDataFrame(GOLDEN, "category string, value string, expected string")
    by_row = df.select("*", mask_by_category(F.col("category"), F.col("value")).alias("got"))
    assert by_row.filter(~F.col("got").eqNullSafe(F.col("expected"))).collect() == []
    for category in {g[0] for g in GOLDEN}:
        part = df.filter(F.col("category") == category)
        got = part.select("value", "expected", mask_as(category, F.col("value")).alias("got"))
        assert got.filter(~F.col("got").eqNullSafe(F.col("expected"))).collect() == []


def test_null_category_keeps_the_value(spark):
    df = spark.createDataFrame([("a@b.c",)], "v string")
    assert df.select(mask_by_category(F.lit(None).cast("string"), F.col("v"))).first()[0] == "a@b.c"


def test_masking_is_one_codegen_projection(spark):
    df = spark.range(4).select(F.col("id").cast("string").alias("email"))
    plan = df.select(mask_as(vocab.EMAIL, F.col("email")))._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert "Exchange" not in text and "*(1) Project" in text


def test_never_unchanged_counts_only_the_fixed_point(spark):
    rows = [("a@b.c", "***"), ("", "0501234567"), (None, None)]
    df = spark.createDataFrame(rows, "email string, phone string")
    got = {r.column_name: (r.checked, r.unchanged) for r in never_unchanged(df).collect()}
    assert got == {"email": (1, 0), "phone": (2, 1)}


def test_render_text_keeps_null_apart_from_empty(spark):
    moment = datetime.datetime(2026, 7, 1, 10, 0, 0)
    df = spark.createDataFrame(
        [(1, decimal.Decimal("250.00"), True, moment, "", None), (2, None, False, None, None, "x")],
        "i int, n decimal(10,2), b boolean, t timestamp_ntz, s string, u string",
    )
    got = [tuple(r) for r in render_text(df).orderBy("i").collect()]
    assert got == [
        ("1", "250.00", "t", "2026-07-01 10:00:00", "", None),
        ("2", None, "f", None, None, "x"),
    ]
    lines = [r.row for r in json_rows(df.select("i", "s", "u", "s")).orderBy("row").collect()]
    assert lines == ['["1","",null,""]', '["2",null,"x",null]']


@pytest.mark.parametrize(
    "data_type, expected",
    [
        (T.StringType(), "Text"),
        (T.LongType(), "Integer"),
        (T.DoubleType(), "Float"),
        (T.DecimalType(10, 2), "Numeric"),
        (T.BooleanType(), "Boolean"),
        (T.TimestampNTZType(), "Timestamp"),
        (T.DateType(), "Date"),
        (T.ArrayType(T.StringType()), "Other"),
        (T.BinaryType(), "Other"),
    ],
)
def test_neutral_types(data_type, expected):
    assert neutral_type(data_type) == expected


def test_whole_floats_and_binary_as_text(spark):
    rows = [(1.0, 2.5, bytearray(b"\xff\x00")), (-3.0, float("inf"), bytearray(b"")), (None, None, None)]
    got = [tuple(r) for r in render_text(spark.createDataFrame(rows, "a double, b float, c binary")).collect()]
    assert got == [("1", "2.5", "\\xff00"), ("-3", "Infinity", "\\x"), (None, None, None)]
