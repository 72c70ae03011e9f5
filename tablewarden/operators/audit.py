"""The audit trail: build lines, validate them, summarize, check order and coverage.

A trail record is one flat struct. Fields that do not apply are NULL and vanish
from the JSON line; a zero is a real value and stays.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden import vocab
from tablewarden.functions.json import is_json_object, json_object
from tablewarden.functions.text import (
    all_valid_table_names,
    format_utc_timestamp,
    utc_timestamp_shape,
    valid_table_name,
)
from tablewarden.operators.sequence import neighbours_in_files, neighbours_in_order

# JSON keys and types, in the order they are written.
AUDIT_FIELDS = [
    ("affected_rows", "bigint"),
    ("category", "string"),
    ("column_count", "bigint"),
    ("outcome", "string"),
    ("pii_credit_card_columns", "bigint"),
    ("pii_email_columns", "bigint"),
    ("pii_phone_columns", "bigint"),
    ("reason", "string"),
    ("referenced_tables", "array<string>"),
    ("referenced_tables_omitted", "boolean"),
    ("request_id", "bigint"),
    ("row_count", "bigint"),
    ("statement_count", "bigint"),
    ("statement_type", "string"),
    ("timestamp", "string"),
]
AUDIT_SCHEMA = ", ".join(f"`{name}` {to}" for name, to in AUDIT_FIELDS)

# Keys each record shape carries beyond the three of every line.
ENVELOPE_KEYS = ["timestamp", "request_id", "outcome"]
READ_SUCCESS_KEYS = [
    "statement_type",
    "row_count",
    "column_count",
    "pii_email_columns",
    "pii_phone_columns",
    "pii_credit_card_columns",
]
WRITE_SUCCESS_KEYS = ["statement_type", "affected_rows"]
POLICY_REJECTED_KEYS = ["reason", "statement_type", "statement_count"]
DATABASE_FAILURE_KEYS = ["category", "statement_type"]
MASKING_REFUSED_KEYS = ["statement_type", "column_count"]
TABLE_KEYS = ["referenced_tables", "referenced_tables_omitted"]

# Keys that must never appear in a line.
FORBIDDEN_KEYS = [
    "sql",
    "query",
    "raw_sql",
    "values",
    "rows",
    "columns",
    "column_names",
    "aliases",
    "error_message",
    "exception",
    "path",
    "user_id",
    "database_url",
    "stack_trace",
    "sqlstate",
    "message",
    "error",
    "table",
    "tables",
    "schema",
]

CLOSED_VOCABULARY = {
    "outcome": vocab.OUTCOMES,
    "statement_type": vocab.STATEMENT_TYPES,
    "reason": vocab.AUDITABLE_REASONS,
    "category": [vocab.CONNECTION_FAILURE, vocab.EXECUTION_FAILURE],
}


PII_COUNTS = ["pii_email_columns", "pii_phone_columns", "pii_credit_card_columns"]


def table_metadata_state(tables: Column) -> Column:
    """ABSENT (no list), OMITTED (a name or the count is not acceptable) or PRESENT."""
    return (
        F.when(F.coalesce(F.array_size(tables), F.lit(0)) == 0, F.lit("ABSENT"))
        .when(F.array_size(tables) > vocab.MAX_AUDITED_TABLES, F.lit("OMITTED"))
        .when(F.coalesce(all_valid_table_names(tables), F.lit(False)), F.lit("PRESENT"))
        .otherwise(F.lit("OMITTED"))
    )


def contract_violation() -> Column:
    """Why a row must not become a record of its outcome, NULL when it may.

    Texts must come from the closed vocabularies and counts must be there, so no
    free text and no incomplete record reaches the trail.
    """
    outcome = F.coalesce(F.col("outcome"), F.lit(""))
    kind = F.coalesce(F.col("statement_type"), F.lit(""))
    reason = F.coalesce(F.col("reason"), F.lit(""))
    category = F.coalesce(F.col("category"), F.lit(""))
    read = (outcome == vocab.SUCCESS) & (kind == "SELECT")
    write = (outcome == vocab.SUCCESS) & (kind == "INSERT")
    rejected = outcome == vocab.POLICY_REJECTED

    def lacks(*counts: str) -> Column:
        missing = [~F.coalesce(F.col(name) >= 0, F.lit(False)) for name in counts]
        return functools.reduce(operator.or_, missing)

    return (
        F.when(~outcome.isin(vocab.OUTCOMES), F.lit("UNKNOWN_OUTCOME"))
        .when(
            outcome.isin(vocab.SUCCESS, vocab.DATABASE_FAILURE) & ~kind.isin("SELECT", "INSERT"),
            F.lit("NEEDS_SELECT_OR_INSERT"),
        )
        .when((outcome == vocab.MASKING_REFUSED) & (kind != "SELECT"), F.lit("NEEDS_SELECT"))
        .when(
            rejected & ~reason.isin(vocab.AUDITABLE_REASONS),
            F.lit("NEEDS_A_REAL_REASON"),
        )
        .when(rejected & ~kind.isin(vocab.STATEMENT_TYPES), F.lit("NEEDS_A_LISTED_TYPE"))
        .when(
            (outcome == vocab.DATABASE_FAILURE) & ~category.isin(CLOSED_VOCABULARY["category"]),
            F.lit("NEEDS_A_LISTED_CATEGORY"),
        )
        .when(
            (read & lacks("row_count", "column_count", *PII_COUNTS))
            | (write & lacks("affected_rows"))
            | (rejected & lacks("statement_count"))
            | ((outcome == vocab.MASKING_REFUSED) & lacks("column_count")),
            F.lit("NEEDS_COUNTS"),
        )
    )


# The first and last millisecond that a record's time can spell, years 0000 to 9999.
FIRST_MS, LAST_MS = -62_167_219_200_000, 253_402_300_799_999


def recordable() -> Column:
    """True for a row that has what every line needs: an id and a time that it can spell."""
    known = (F.col("request_id") >= 0) & F.col("timestamp_ms").between(FIRST_MS, LAST_MS)
    return F.coalesce(known, F.lit(False))


def audit_unrecordable(outcomes: DataFrame) -> DataFrame:
    """The rows that ``audit_build`` makes no record of; their sender has to be found and mended."""
    return outcomes.filter(~recordable())


def audit_build(outcomes: DataFrame) -> DataFrame:
    """Request outcomes -> flat audit records.

    A row without a usable id or time has no record, since no valid line could
    hold it: ``audit_unrecordable`` returns those rows.

    Reads ``request_id``, ``timestamp_ms``, ``outcome``, ``statement_type``,
    ``statement_count``, ``reason``, ``category``, ``row_count``,
    ``column_count``, ``affected_rows``, the three ``pii_*`` counts and
    ``tables``. A row that breaks the contract of its outcome is recorded as an
    internal failure, which carries the envelope only.
    """
    settled = outcomes.filter(recordable()).withColumn(
        "_outcome",
        F.when(contract_violation().isNotNull(), F.lit(vocab.INTERNAL_FAILURE)).otherwise(
            F.col("outcome")
        ),
    ).withColumn(
        "_tables",
        F.when(
            ~F.col("_outcome").isin(vocab.PARSING_FAILURE, vocab.INTERNAL_FAILURE), F.col("tables")
        ),
    ).withColumn("_table_state", table_metadata_state(F.col("_tables")))

    outcome, kind = F.col("_outcome"), F.col("statement_type")
    read = (outcome == vocab.SUCCESS) & (kind == "SELECT")
    write = (outcome == vocab.SUCCESS) & (kind == "INSERT")
    rejected = outcome == vocab.POLICY_REJECTED
    failed = outcome == vocab.DATABASE_FAILURE
    refused = outcome == vocab.MASKING_REFUSED

    values = {
        "timestamp": format_utc_timestamp(F.col("timestamp_ms")),
        "request_id": F.col("request_id"),
        "outcome": outcome,
        "statement_type": F.when(read | write | rejected | failed | refused, kind),
        "row_count": F.when(read, F.col("row_count")),
        "column_count": F.when(read | refused, F.col("column_count")),
        "pii_email_columns": F.when(read, F.col("pii_email_columns")),
        "pii_phone_columns": F.when(read, F.col("pii_phone_columns")),
        "pii_credit_card_columns": F.when(read, F.col("pii_credit_card_columns")),
        "affected_rows": F.when(write, F.col("affected_rows")),
        "reason": F.when(rejected, F.col("reason")),
        "statement_count": F.when(rejected, F.col("statement_count")),
        "category": F.when(failed, F.col("category")),
        "referenced_tables": F.when(F.col("_table_state") == "PRESENT", F.col("_tables")),
        "referenced_tables_omitted": F.when(F.col("_table_state") == "OMITTED", F.lit(True)),
    }
    return settled.select(*[values[name].cast(to).alias(name) for name, to in AUDIT_FIELDS])


def audit_lines(records: DataFrame) -> DataFrame:
    """Records -> JSON lines with sorted keys; NULL fields are left out."""
    fields = [F.col(name) for name, _ in AUDIT_FIELDS]
    return records.select(
        "request_id", F.to_json(F.struct(*fields), {"ignoreNullFields": "true"}).alias("value")
    )


def parse_trail(lines: DataFrame) -> DataFrame:
    """Typed records of the well-formed lines; other columns of ``lines`` are kept."""
    keep = [c for c in lines.columns if c != "value"]
    good = lines.filter(is_json_object(F.col("value")))
    return good.select(*keep, F.from_json("value", AUDIT_SCHEMA).alias("_r")).select(
        *keep, "_r.*"
    )


def trail_rejects(lines: DataFrame) -> DataFrame:
    """Lines that are not a JSON object."""
    return lines.filter(~is_json_object(F.col("value")))


def _text_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def expected_keys(outcome: Column, statement_type: Column) -> Column:
    """Exact key set of a record shape, table metadata aside."""
    shapes = [
        ((outcome == vocab.SUCCESS) & (statement_type == "INSERT"), WRITE_SUCCESS_KEYS),
        (outcome == vocab.SUCCESS, READ_SUCCESS_KEYS),
        (outcome == vocab.POLICY_REJECTED, POLICY_REJECTED_KEYS),
        (outcome == vocab.DATABASE_FAILURE, DATABASE_FAILURE_KEYS),
        (outcome == vocab.MASKING_REFUSED, MASKING_REFUSED_KEYS),
    ]
    keys = _text_array(ENVELOPE_KEYS)
    chain = None
    for condition, extra in shapes:
        value = _text_array(ENVELOPE_KEYS + extra)
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    return chain.otherwise(keys)


def line_pattern() -> str:
    """A pattern for lines spelled just as ``audit_lines`` writes them.

    Such a line is valid by construction: one alternative per record shape, with
    the fields of that shape in sorted order and values of their type.
    """
    number = "(?:0|[1-9][0-9]*)"
    name = rf"[A-Za-z_][A-Za-z0-9_$]{{0,{vocab.MAX_TABLE_NAME_BYTES - 1}}}"
    names = rf'"{name}"(?:,"{name}"){{0,{vocab.MAX_AUDITED_TABLES - 1}}}'
    tables = rf'(?:"referenced_tables":\[{names}\],|"referenced_tables_omitted":true,)?'
    moment = r'"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{3}Z"'
    shapes = [
        (vocab.SUCCESS, ["INSERT"], WRITE_SUCCESS_KEYS),
        (
            vocab.SUCCESS,
            [t for t in vocab.STATEMENT_TYPES if t != "INSERT"],
            READ_SUCCESS_KEYS,
        ),
        (vocab.POLICY_REJECTED, vocab.STATEMENT_TYPES, POLICY_REJECTED_KEYS),
        (vocab.DATABASE_FAILURE, vocab.STATEMENT_TYPES, DATABASE_FAILURE_KEYS),
        (vocab.MASKING_REFUSED, vocab.STATEMENT_TYPES, MASKING_REFUSED_KEYS),
        (vocab.PARSING_FAILURE, [], []),
        (vocab.INTERNAL_FAILURE, [], []),
    ]

    def one_of(values: list[str]) -> str:
        return '"(?:' + "|".join(values) + ')"'

    alternatives = []
    for outcome, types, extra in shapes:
        values = dict.fromkeys(extra, number) | {
            "request_id": number,
            "outcome": f'"{outcome}"',
            "timestamp": moment,
            "statement_type": one_of(types),
            "reason": one_of(CLOSED_VOCABULARY["reason"]),
            "category": one_of(CLOSED_VOCABULARY["category"]),
        }
        present = set(ENVELOPE_KEYS + extra)
        parts = []
        for field, _ in AUDIT_FIELDS:
            if field in present:
                parts.append(f'"{field}":{values[field]}' + ("" if field == "timestamp" else ","))
            elif field == "referenced_tables":
                parts.append(tables)
        alternatives.append("".join(parts))
    return r"\A\{(?:" + "|".join(alternatives) + r")\}\z"


def with_line_violations(lines: DataFrame) -> DataFrame:
    """Add ``violations array<string>``: everything wrong with each line.

    Lines spelled as the writer spells them are known to be valid; only others
    are parsed and checked field by field.
    """
    typed = lines.withColumn("_as_written", F.col("value").rlike(line_pattern())).withColumn(
        "_fields",
        F.when(
            ~F.col("_as_written"),
            F.try_variant_get(json_object(F.col("value")), "$", "map<string,variant>"),
        ),
    ).withColumn(
        "_kinds", F.transform_values("_fields", lambda _, v: F.schema_of_variant(v))
    )

    def text(key: str) -> Column:
        return F.try_variant_get(F.try_element_at("_fields", F.lit(key)), "$", "string")

    def kind(key: str) -> Column:
        return F.try_element_at(F.col("_kinds"), F.lit(key))

    keys = F.map_keys("_fields")
    schema_keys = F.array_except(keys, _text_array(TABLE_KEYS))
    expected = expected_keys(text("outcome"), F.coalesce(text("statement_type"), F.lit("")))
    known_text_keys = list(CLOSED_VOCABULARY) + ["timestamp"]
    names = F.try_variant_get(
        F.try_element_at("_fields", F.lit("referenced_tables")), "$", "array<variant>"
    )
    bad_name = F.exists(
        names,
        lambda n: (F.schema_of_variant(n) != "STRING")
        | ~valid_table_name(F.try_variant_get(n, "$", "string")),
    )
    is_object = F.col("_fields").isNotNull()

    def found(code: str, condition: Column) -> Column:
        return F.when(F.coalesce(condition, F.lit(False)), F.lit(code))

    def outside(key: str) -> Column:
        return (kind(key) == "STRING") & ~text(key).isin(CLOSED_VOCABULARY[key])

    checks = [
        F.when(~is_object, F.lit("NOT_A_JSON_OBJECT")),
        found("MISSING_OUTCOME", is_object & F.coalesce(kind("outcome") != "STRING", F.lit(True))),
        found("MISSING_KEY", F.array_size(F.array_except(expected, schema_keys)) > 0),
        found("UNEXPECTED_KEY", F.array_size(F.array_except(schema_keys, expected)) > 0),
        found("FORBIDDEN_KEY", F.arrays_overlap(keys, _text_array(FORBIDDEN_KEYS))),
        found(
            "BOTH_TABLE_KEYS",
            kind("referenced_tables").isNotNull() & kind("referenced_tables_omitted").isNotNull(),
        ),
        found(
            "BAD_OMITTED_FLAG",
            kind("referenced_tables_omitted").isNotNull()
            & ~F.coalesce(
                (kind("referenced_tables_omitted") == "BOOLEAN")
                & (text("referenced_tables_omitted") == "true"),
                F.lit(False),
            ),
        ),
        found(
            "BAD_TABLE_LIST",
            kind("referenced_tables").isNotNull()
            & (
                ~F.startswith(kind("referenced_tables"), F.lit("ARRAY"))
                | (F.array_size(names) > vocab.MAX_AUDITED_TABLES)
                | bad_name
            ),
        ),
        found(
            "BAD_TIMESTAMP",
            (kind("timestamp") == "STRING") & ~utc_timestamp_shape(text("timestamp")),
        ),
        found(
            "FREE_FORM_STRING",
            F.exists(
                F.map_entries("_kinds"),
                lambda e: (e["value"] == "STRING") & ~e["key"].isin(known_text_keys),
            ),
        ),
    ] + [found(f"BAD_{key.upper()}", outside(key)) for key in CLOSED_VOCABULARY]
    violations = F.when(F.col("_as_written"), F.array().cast("array<string>")).otherwise(
        F.array_compact(F.array(*checks))
    )
    return typed.withColumn("violations", violations).drop("_as_written", "_fields", "_kinds")


def audit_validate(lines: DataFrame, position: str = "position") -> DataFrame:
    """One row per violation of the closed schema; a clean trail gives none.

    The outer explode keeps Spark from adding a non-empty filter, which would
    repeat every check.
    """
    return (
        with_line_violations(lines)
        .select(position, F.explode_outer("violations").alias("violation"))
        .filter("violation IS NOT NULL")
    )


def audit_leak_scan(lines: DataFrame, canaries: list[str], position: str = "position") -> DataFrame:
    """Lines that contain one of the given strings, one row per hit.

    The canaries are a constant of the plan, so each line is read once and no
    pairs are formed.
    """
    hits = F.filter(_text_array(canaries), lambda c: F.contains(F.col("value"), c))
    return lines.select(position, F.explode_outer(hits).alias("canary")).filter(
        "canary IS NOT NULL"
    )


def audit_outcome_summary(records: DataFrame) -> DataFrame:
    return records.groupBy("outcome").agg(F.count("*").alias("records"))


def audit_completeness(request_ids: DataFrame, records: DataFrame) -> DataFrame:
    """Requests without exactly one record, and records without a request.

    Both sides are counted in one grouped pass with map-side combine; a request
    id that fills a third of the trail collapses before the shuffle.
    """
    asked = request_ids.select("request_id", F.lit(1).alias("_asked"), F.lit(0).alias("_told"))
    told = records.select("request_id", F.lit(0).alias("_asked"), F.lit(1).alias("_told"))
    return (
        asked.unionByName(told)
        .groupBy("request_id")
        .agg(F.sum("_asked").alias("requests"), F.sum("_told").alias("records"))
        .filter("requests <> 1 OR records <> 1")
    )


def audit_order_check(records: DataFrame, position: str | None = "position") -> DataFrame:
    """Neighbouring records whose ids do not rise or whose time falls.

    Order is that of the ``position`` column; with ``position=None`` it is line
    order within each file of a trail.
    """
    compared = ["request_id", "timestamp"]
    if position is None:
        paired, where = neighbours_in_files(records, compared), ["file", "split_start", "line"]
    else:
        paired, where = neighbours_in_order(records, position, compared), [position]
    violation = F.array_compact(
        F.array(
            F.when(F.col("request_id") <= F.col("prev_request_id"), F.lit("REQUEST_ID_NOT_RISING")),
            F.when(F.col("timestamp") < F.col("prev_timestamp"), F.lit("TIME_FALLS")),
        )
    )
    return paired.select(
        *where, "request_id", "prev_request_id", F.explode_outer(violation).alias("violation")
    ).filter("violation IS NOT NULL")


def duplicate_request_ids(records: DataFrame) -> DataFrame:
    return (
        records.groupBy("request_id").agg(F.count("*").alias("records")).filter("records > 1")
    )
