"""Analysis, policy rules in order, outcomes and client codes."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tablewarden import vocab
from tablewarden.functions.text import (
    ascii_lower,
    format_utc_timestamp,
    is_blank,
    strip_qualifier,
    utc_timestamp_shape,
)
from tablewarden.operators.classify import lookup_in_table
from tablewarden.operators.policy import (
    RAW_STATEMENT_TYPE,
    normalize_facts,
    policy_decision,
    request_outcome,
)

FACT_SCHEMA = (
    "statement_id bigint, status string, statement_type string, statement_count int, "
    "tables array<string>, projection_columns array<string>, has_wildcard_projection boolean, "
    "affected_columns array<string>, insert_source string, insert_value_kinds array<string>, "
    "unsupported_features array<string>"
)
DEFAULTS = {
    "status": "OK",
    "statement_type": "SELECT",
    "statement_count": 1,
    "tables": ["customers"],
    "projection_columns": ["id"],
    "has_wildcard_projection": False,
    "affected_columns": [],
    "insert_source": "NONE",
    "insert_value_kinds": [],
    "unsupported_features": [],
}
INSERT = {
    "statement_type": "INSERT",
    "tables": ["orders"],
    "projection_columns": [],
    "affected_columns": ["customer_id", "amount"],
    "insert_source": "VALUES",
    "insert_value_kinds": [vocab.POSITIVE_INTEGER, vocab.POSITIVE_DECIMAL],
}


def decide(spark, *changes):
    names = [p.split()[0] for p in FACT_SCHEMA.split(", ")][1:]
    rows = [(i, *[{**DEFAULTS, **c}[n] for n in names]) for i, c in enumerate(changes)]
    df = policy_decision(spark.createDataFrame(rows, FACT_SCHEMA))
    return [r.reason for r in df.orderBy("statement_id").collect()]


def test_rules_in_order(spark):
    cases = [
        ({"status": "EMPTY_INPUT"}, "EMPTY_INPUT"),
        ({"status": "PARSE_ERROR"}, "UNPARSEABLE_SQL"),
        ({"status": "MULTIPLE_STATEMENTS"}, "MULTIPLE_STATEMENTS"),
        ({"statement_count": 2}, "MULTIPLE_STATEMENTS"),
        ({"statement_count": 0}, "MULTIPLE_STATEMENTS"),
        ({"statement_type": "UNKNOWN"}, "UNSUPPORTED_STATEMENT_TYPE"),
        ({"statement_type": "CREATE"}, "DDL_NOT_ALLOWED"),
        ({"statement_type": "ALTER"}, "DDL_NOT_ALLOWED"),
        ({"statement_type": "DROP"}, "DDL_NOT_ALLOWED"),
        ({"statement_type": "UPDATE"}, "DML_NOT_ALLOWED"),
        ({"statement_type": "DELETE", "tables": ["pg_authid"]}, "DML_NOT_ALLOWED"),
        ({"unsupported_features": ["WITH/CTE"], "tables": ["pg_x"]}, "UNSUPPORTED_SQL_FEATURE"),
        ({"tables": ["customers", "PG_AUTHID"], "has_wildcard_projection": True}, "SYSTEM_TABLE_ACCESS"),
        ({"tables": ["pg_catalog.pg_class"]}, "SYSTEM_TABLE_ACCESS"),
        ({"tables": ["Information_Schema.tables"]}, "SYSTEM_TABLE_ACCESS"),
        ({"tables": ["public.pg_x"]}, "SYSTEM_TABLE_ACCESS"),
        ({"tables": ["a.b.pg_x"]}, "NONE"),
        ({"tables": ["pgcustomers", "mypg_table", "pg", "x.pgcat"]}, "NONE"),
        ({"tables": ["information_schema"]}, "NONE"),
        ({"tables": ["Kpg_x"]}, "NONE"),
        ({"has_wildcard_projection": True}, "UNATTRIBUTABLE_PROJECTION"),
        ({"has_wildcard_projection": True, "projection_columns": []}, "NONE"),
        ({"tables": []}, "NONE"),
        ({}, "NONE"),
    ]
    assert decide(spark, *[c for c, _ in cases]) == [e for _, e in cases]


def test_missing_facts_reject(spark):
    cases = [
        ({"status": None}, "UNPARSEABLE_SQL"),
        ({"status": "SOMETHING"}, "UNPARSEABLE_SQL"),
        ({"statement_count": None}, "MULTIPLE_STATEMENTS"),
        ({"statement_type": None}, "UNSUPPORTED_STATEMENT_TYPE"),
        ({"unsupported_features": None}, "UNSUPPORTED_SQL_FEATURE"),
        ({"tables": None}, "SYSTEM_TABLE_ACCESS"),
        ({"tables": ["a", None]}, "SYSTEM_TABLE_ACCESS"),
        ({"has_wildcard_projection": None}, "UNATTRIBUTABLE_PROJECTION"),
    ]
    assert decide(spark, *[c for c, _ in cases]) == [e for _, e in cases]


def test_the_one_permitted_insert(spark):
    target, shape = "INSERT_TARGET_NOT_ALLOWED", "UNSUPPORTED_INSERT_SHAPE"
    integer, decimal = vocab.POSITIVE_INTEGER, vocab.POSITIVE_DECIMAL
    cases = [
        ({}, "NONE"),
        ({"insert_value_kinds": [integer, integer]}, "NONE"),
        ({"tables": ["public.orders"]}, target),
        ({"tables": ["Orders"]}, target),
        ({"tables": ["orders", "customers"]}, target),
        ({"tables": []}, target),
        ({"tables": None}, target),
        ({"insert_source": "SELECT"}, shape),
        ({"insert_source": None}, shape),
        ({"affected_columns": ["amount", "customer_id"]}, shape),
        ({"affected_columns": ["Customer_id", "amount"]}, shape),
        ({"affected_columns": ["customer_id"]}, shape),
        ({"insert_value_kinds": [decimal, integer]}, shape),
        ({"insert_value_kinds": [integer, vocab.NON_POSITIVE]}, shape),
        ({"insert_value_kinds": [integer, decimal, integer]}, shape),
        ({"insert_value_kinds": [integer, None]}, shape),
        ({"unsupported_features": ["INSERT without column list"]}, shape),
    ]
    assert decide(spark, *[{**INSERT, **c} for c, _ in cases]) == [e for _, e in cases]


def test_normalized_facts(spark):
    one = {
        "type": "SELECT",
        "tables": [{"schema": "", "name": "b"}, {"schema": "s", "name": "a"}, {"schema": None, "name": "b"}],
        "projection_columns": ["x"],
        "has_wildcard_projection": True,
        "has_computed_projection": False,
        "has_safe_count_star_projection": False,
        "has_group_by": True,
        "affected_columns": [],
        "insert_source": "NONE",
        "insert_value_kinds": [],
        "unsupported_features": ["f"],
    }
    schema = (
        "statement_id bigint, sql string, parse_success boolean, parse_error string, "
        f"statements array<{RAW_STATEMENT_TYPE}>"
    )
    rows = [
        (0, " \t\n\r\f\x0b", True, "", [one]),
        (1, " ", True, "", [one]),
        (2, "x", False, "", [one]),
        (3, "x", False, "bad at 3", []),
        (4, "x", True, "", []),
        (5, "x", True, "", [one, one]),
        (6, "x", True, "", [one]),
        (7, None, True, "", [one]),
        (8, "x", None, None, None),
    ]
    got = {
        r.statement_id: (r.status, r.error_reason, r.statement_count, r.statement_type, list(r.tables))
        for r in normalize_facts(spark.createDataFrame(rows, schema)).collect()
    }
    full = ("OK", None, 1, "SELECT", ["b", "s.a"])
    assert got == {
        0: ("EMPTY_INPUT", None, 0, "UNKNOWN", []),
        1: full,
        2: ("PARSE_ERROR", "parser reported failure", 1, "UNKNOWN", []),
        3: ("PARSE_ERROR", "bad at 3", 0, "UNKNOWN", []),
        4: ("PARSE_ERROR", "parser returned success with no statements", 0, "UNKNOWN", []),
        5: ("MULTIPLE_STATEMENTS", None, 2, "UNKNOWN", []),
        6: full,
        7: ("EMPTY_INPUT", None, 0, "UNKNOWN", []),
        8: ("PARSE_ERROR", "parser reported failure", 0, "UNKNOWN", []),
    }


def test_outcomes_and_codes(spark):
    schema = (
        "i int, allowed boolean, reason string, statement_type string, exec_status string, "
        "row_count bigint, affected_rows bigint, masking_failure string"
    )
    cases = [
        ((False, "EMPTY_INPUT", "UNKNOWN", None, None, None, None), ("POLICY_REJECTED", "empty_sql", 400)),
        ((False, "UNPARSEABLE_SQL", "UNKNOWN", None, None, None, None), ("PARSING_FAILURE", "invalid_sql", 400)),
        ((False, "DDL_NOT_ALLOWED", "DROP", "OK", 1, 1, None), ("POLICY_REJECTED", "policy_rejected", 403)),
        ((None, None, "SELECT", "OK", 1, None, None), ("POLICY_REJECTED", "policy_rejected", 403)),
        ((True, "NONE", "SELECT", "CONNECTION_FAILURE", None, None, None), ("DATABASE_FAILURE", "database_unavailable", 503)),
        ((True, "NONE", "INSERT", "EXECUTION_FAILURE", None, None, None), ("DATABASE_FAILURE", "query_failed", 400)),
        ((True, "NONE", "SELECT", None, 1, None, None), ("INTERNAL_FAILURE", "internal_error", 500)),
        ((True, "NONE", "INSERT", "OK", None, 1, "UNATTRIBUTED_COLUMN"), ("SUCCESS", None, 200)),
        ((True, "NONE", "INSERT", "OK", None, 2, None), ("INTERNAL_FAILURE", "internal_error", 500)),
        ((True, "NONE", "INSERT", "OK", None, -1, None), ("INTERNAL_FAILURE", "internal_error", 500)),
        ((True, "NONE", "SELECT", "OK", -1, None, None), ("INTERNAL_FAILURE", "internal_error", 500)),
        ((True, "NONE", "SELECT", "OK", 0, None, None), ("SUCCESS", None, 200)),
        ((True, "NONE", "SELECT", "OK", 1, None, "UNATTRIBUTED_COLUMN"), ("MASKING_REFUSED", "masking_refused", 422)),
        ((True, "NONE", "SELECT", "OK", 1, None, "STRUCTURAL_MISMATCH"), ("INTERNAL_FAILURE", "internal_error", 500)),
    ]
    df = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], schema)
    got = [
        (r.outcome, r.client_code, r.http_status) for r in request_outcome(df).orderBy("i").collect()
    ]
    assert got == [e for _, e in cases]


def test_text_helpers(spark):
    df = spark.createDataFrame([("KEY.É.Name",)], "v string")
    assert df.select(ascii_lower(F.col("v"))).first()[0] == "Key.É.name"
    assert df.select(strip_qualifier(F.col("v"))).first()[0] == "Name"
    assert not df.select(is_blank(F.col("v"))).first()[0]


def test_timestamps_ignore_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([(0,), (1785664800000,), (1785664800007,)], "ms bigint")
        text = format_utc_timestamp(F.col("ms"))
        got = [tuple(r) for r in df.select(text, utc_timestamp_shape(text)).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == [
        ("1970-01-01T00:00:00.000Z", True),
        ("2026-08-02T10:00:00.000Z", True),
        ("2026-08-02T10:00:00.007Z", True),
    ]


def test_missing_facts_reject_without_ansi_too(spark):
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        test_missing_facts_reject(spark)
        test_the_one_permitted_insert(spark)
        test_normalized_facts(spark)
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")


def test_system_tables_split_at_the_first_dot(spark):
    from tablewarden.functions.text import any_system_table

    names = {"pg_foo.bar": False, "pg_foo": True, "s.PG_x": True, "s.t.pg_x": False, "Pg_Catalog.x": True, "xpg_y": False,
             "information_schema.t": True, "information_schema": False}
    df = spark.createDataFrame([([n], want) for n, want in names.items()], "t array<string>, want boolean")
    assert df.filter(any_system_table(F.col("t")) != F.col("want")).collect() == []
    both = spark.createDataFrame([(["pg_foo.bar", "pg_z"],)], "t array<string>")
    assert both.filter(any_system_table(F.col("t"))).count() == 1


def test_colliding_mapping_names_fail(spark):
    names = spark.createDataFrame([("c.Email",), ("x",), (None,)], "name string")
    good = spark.createDataFrame([("EMAIL", "PII.Email"), (None, "PII.Phone"), (None, "PII.Email")], "column_name string, category string")
    found = {r.name: r.category for r in lookup_in_table(names, "name", good).collect()}
    assert found == {"c.Email": "PII.Email", "x": None, None: None}
    bad = spark.createDataFrame([("Email", "PII.Email"), ("email", "PII.Phone")], "column_name string, category string")
    with pytest.raises(PySparkException, match="mapping names collide"):
        lookup_in_table(names, "name", bad).collect()
