"""Audit records: exact lines, closed schema, order, coverage."""

import json

import pytest
from pyspark.sql import functions as F

from tablewarden import vocab
from tablewarden.operators import audit
from tablewarden.plans.release import outcome_record
from tablewarden.sources.trail import append_audit, read_trail

READ = {
    "outcome": vocab.SUCCESS,
    "statement_type": "SELECT",
    "row_count": 0,
    "column_count": 2,
    "pii_email_columns": 1,
    "pii_phone_columns": 0,
    "pii_credit_card_columns": 0,
    "tables": ["customers", "orders"],
}


def line(spark, **fields):
    record = outcome_record(spark, request_id=7, timestamp_ms=0, **fields)
    return audit.audit_lines(record).first()["value"]


def violations(spark, *values):
    df = spark.createDataFrame(list(enumerate(values)), "position bigint, value string")
    found = {i: set() for i in range(len(values))}
    for r in audit.audit_validate(df).collect():
        found[r.position].add(r.violation)
    return [found[i] for i in range(len(values))]


SHAPES = [
    (READ, set(audit.READ_SUCCESS_KEYS) | {"referenced_tables"}),
    ({"outcome": vocab.SUCCESS, "statement_type": "INSERT", "affected_rows": 1, "row_count": 9}, set(audit.WRITE_SUCCESS_KEYS)),
    ({"outcome": vocab.POLICY_REJECTED, "statement_type": "DROP", "reason": "DDL_NOT_ALLOWED", "statement_count": 1, "tables": ["a b"]},
     set(audit.POLICY_REJECTED_KEYS) | {"referenced_tables_omitted"}),
    ({"outcome": vocab.DATABASE_FAILURE, "statement_type": "INSERT", "category": "EXECUTION_FAILURE"}, set(audit.DATABASE_FAILURE_KEYS)),
    ({"outcome": vocab.MASKING_REFUSED, "statement_type": "SELECT", "column_count": 1, "pii_email_columns": 0}, set(audit.MASKING_REFUSED_KEYS)),
    ({"outcome": vocab.PARSING_FAILURE, "statement_type": "UNKNOWN", "tables": ["t"]}, set()),
    ({"outcome": vocab.INTERNAL_FAILURE, "statement_type": "SELECT", "tables": ["t"], "row_count": 3}, set()),
]


@pytest.mark.parametrize("fields, extra", SHAPES, ids=[s[0]["outcome"] for s in SHAPES])
def test_exact_keys_sorted_and_valid(spark, fields, extra):
    text = line(spark, **fields)
    keys = list(json.loads(text))
    assert set(keys) == {"timestamp", "request_id", "outcome"} | extra
    assert keys == sorted(keys)
    # Both ways of validating agree: as written, and parsed because of the space.
    assert violations(spark, text, text.replace(":", ": ", 1)) == [set(), set()]
    df = spark.createDataFrame([(text,)], "value string")
    assert df.select(F.col("value").rlike(audit.line_pattern())).first()[0]


def test_zero_counts_are_kept(spark):
    assert json.loads(line(spark, **READ))["row_count"] == 0
    assert '"timestamp":"1970-01-01T00:00:00.000Z"' in line(spark, **READ)


ILLEGAL = [
    {"outcome": vocab.SUCCESS, "statement_type": "UPDATE"},
    {"outcome": vocab.SUCCESS, "statement_type": None},
    {"outcome": vocab.MASKING_REFUSED, "statement_type": "INSERT"},
    {"outcome": vocab.DATABASE_FAILURE, "statement_type": "DROP"},
    {"outcome": vocab.POLICY_REJECTED, "statement_type": "SELECT", "reason": "NONE"},
    {"outcome": vocab.POLICY_REJECTED, "statement_type": "SELECT", "reason": "UNPARSEABLE_SQL"},
    {"outcome": vocab.POLICY_REJECTED, "statement_type": "SELECT", "reason": None},
    {"outcome": vocab.POLICY_REJECTED, "statement_type": "GRANT a TO b", "reason": "DDL_NOT_ALLOWED", "statement_count": 1},
    {"outcome": vocab.POLICY_REJECTED, "statement_type": None, "reason": "DDL_NOT_ALLOWED", "statement_count": 1},
    {"outcome": vocab.POLICY_REJECTED, "statement_type": "DROP", "reason": "DDL_NOT_ALLOWED"},
    {"outcome": vocab.DATABASE_FAILURE, "statement_type": "SELECT", "category": "password=abc"},
    {"outcome": vocab.DATABASE_FAILURE, "statement_type": "SELECT"},
    {"outcome": vocab.SUCCESS, "statement_type": "SELECT", "row_count": 1},
    {"outcome": vocab.SUCCESS, "statement_type": "INSERT"},
    {"outcome": vocab.MASKING_REFUSED, "statement_type": "SELECT"},
    {"outcome": "OTHER", "statement_type": "SELECT"},
    {"outcome": None, "statement_type": "SELECT"},
]


@pytest.mark.parametrize("fields", ILLEGAL)
def test_illegal_combinations_become_internal_failures(spark, fields):
    got = json.loads(line(spark, tables=["t"], **fields))
    assert got == {"outcome": "INTERNAL_FAILURE", "request_id": 7, "timestamp": "1970-01-01T00:00:00.000Z"}


def test_table_metadata_states(spark):
    # Built from the rule: at most 8 plain unqualified names of at most 63 ASCII letters, digits, _ and $.
    plain = ["x", "_y", "Z9$", "n" * 63]
    wrong = ["", None, "n" * 64, "9x", "$x", "s.x", "s.t.x", "x y", "x-y", "`x`", "\u00fcx", "x\n", "x\t"]
    cases = [([], "ABSENT"), (None, "ABSENT"), (plain * 2, "PRESENT"), (plain * 2 + ["x"], "OMITTED")]
    cases += [([name], "PRESENT") for name in plain]
    cases += [([name], "OMITTED") for name in wrong] + [(["x", name], "OMITTED") for name in wrong]
    df = spark.createDataFrame(list(enumerate(c[0] for c in cases)), "i int, t array<string>")
    state = audit.table_metadata_state(F.col("t"))
    got = [r[0] for r in df.orderBy("i").select(state).collect()]
    assert got == [c[1] for c in cases]


def test_violations(spark):
    base = json.loads(line(spark, **READ))

    def changed(drop=(), **put):
        return json.dumps({k: v for k, v in {**base, **put}.items() if k not in drop})

    cases = [
        (changed(), set()),
        ("{bad", {"NOT_A_JSON_OBJECT"}),
        ("[1]", {"NOT_A_JSON_OBJECT"}),
        ("", {"NOT_A_JSON_OBJECT"}),
        (changed() + "x", {"NOT_A_JSON_OBJECT"}),
        (changed(sql="SELECT 1"), {"UNEXPECTED_KEY", "FORBIDDEN_KEY", "FREE_FORM_STRING"}),
        (changed(extra=1), {"UNEXPECTED_KEY"}),
        (changed(drop=["row_count"]), {"MISSING_KEY"}),
        (changed(drop=["outcome"]), {"MISSING_OUTCOME", "MISSING_KEY", "UNEXPECTED_KEY"}),
        (changed(outcome=3), {"MISSING_OUTCOME", "UNEXPECTED_KEY"}),
        (changed(outcome="NOPE"), {"BAD_OUTCOME", "UNEXPECTED_KEY"}),
        (changed(statement_type="MERGE"), {"BAD_STATEMENT_TYPE"}),
        (changed(timestamp="2026-01-01 00:00:00"), {"BAD_TIMESTAMP"}),
        (changed(request_id="7"), {"FREE_FORM_STRING"}),
        (changed(referenced_tables=["a.b"]), {"BAD_TABLE_LIST"}),
        (changed(referenced_tables=[1]), {"BAD_TABLE_LIST"}),
        (changed(referenced_tables="a"), {"BAD_TABLE_LIST", "FREE_FORM_STRING"}),
        (changed(referenced_tables=["a"] * 9), {"BAD_TABLE_LIST"}),
        (changed(referenced_tables_omitted=True), {"BOTH_TABLE_KEYS"}),
        (changed(drop=["referenced_tables"], referenced_tables_omitted=False), {"BAD_OMITTED_FLAG"}),
        (
            json.dumps({"timestamp": base["timestamp"], "request_id": 1, "outcome": "POLICY_REJECTED",
                        "reason": "INSERT_TARGET_NOT_ALLOWED", "statement_type": "INSERT", "statement_count": 1}),
            set(),
        ),
        (
            json.dumps({"timestamp": base["timestamp"], "request_id": 1, "outcome": "POLICY_REJECTED",
                        "reason": "NONE", "statement_type": "INSERT", "statement_count": 1}),
            {"BAD_REASON"},
        ),
        (
            json.dumps({"timestamp": base["timestamp"], "request_id": 1, "outcome": "DATABASE_FAILURE",
                        "category": "TIMEOUT", "statement_type": "SELECT"}),
            {"BAD_CATEGORY"},
        ),
    ]
    assert violations(spark, *[c[0] for c in cases]) == [c[1] for c in cases]


def test_trail_keeps_malformed_lines_and_order_is_checked_per_file(spark, tmp_path):
    path = str(tmp_path / "trail")
    records = None
    for i in (3, 1, 2):
        one = outcome_record(spark, request_id=i, timestamp_ms=i * 1000, outcome=vocab.PARSING_FAILURE)
        records = one if records is None else records.union(one)
    append_audit(records.coalesce(1), path)
    spark.createDataFrame([("{broken",)], "value string").write.mode("append").text(path)
    lines = read_trail(spark, path)
    assert [r.value for r in audit.trail_rejects(lines).collect()] == ["{broken"]
    parsed = audit.parse_trail(lines)
    assert sorted(r.request_id for r in parsed.collect()) == [1, 2, 3]
    assert audit.audit_order_check(parsed, position=None).collect() == []


def test_order_violations_within_a_file(spark, tmp_path):
    path = str(tmp_path / "t.jsonl")
    moments = [(1, 5), (2, 4), (2, 6), (1, 7), (9, 7)]
    with open(path, "w") as out:
        for i, second in moments:
            out.write(json.dumps({"outcome": "PARSING_FAILURE", "request_id": i, "timestamp": f"2026-01-01T00:00:0{second}.000Z"}) + "\n")
    parsed = audit.parse_trail(read_trail(spark, path))
    found = audit.audit_order_check(parsed, position=None).orderBy("line", "violation").collect()
    assert [(r.request_id, r.prev_request_id, r.violation) for r in found] == [
        (2, 1, "TIME_FALLS"),
        (2, 2, "REQUEST_ID_NOT_RISING"),
        (1, 2, "REQUEST_ID_NOT_RISING"),
    ]
    assert sorted(r.request_id for r in audit.duplicate_request_ids(parsed).collect()) == [1, 2]


def test_completeness(spark):
    ids = spark.createDataFrame([(1,), (2,), (3,)], "request_id bigint")
    told = spark.createDataFrame([(1,), (3,), (3,), (4,)], "request_id bigint")
    got = {r.request_id: (r.requests, r.records) for r in audit.audit_completeness(ids, told).collect()}
    assert got == {2: (1, 0), 3: (1, 2), 4: (0, 1)}


def test_leak_scan(spark):
    df = spark.createDataFrame([(1, "a'b WHERE"), (2, "clean")], "position int, value string")
    got = audit.audit_leak_scan(df, ["'", "WHERE", "zzq"]).collect()
    assert sorted(tuple(r) for r in got) == [(1, "'"), (1, "WHERE")]
