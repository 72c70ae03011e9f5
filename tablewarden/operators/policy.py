"""Statement facts -> analysis status, policy decision and request outcome.

Each step is one first-match chain over the columns of a row, so a table or
stream of any size passes through without a shuffle. A missing fact rejects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden import vocab
from tablewarden.functions.text import (
    any_system_table,
    is_blank,
    qualified_name,
    statement_class,
)

RAW_STATEMENT_TYPE = (
    "struct<type:string,tables:array<struct<schema:string,name:string>>,"
    "projection_columns:array<string>,has_wildcard_projection:boolean,"
    "has_computed_projection:boolean,has_safe_count_star_projection:boolean,"
    "has_group_by:boolean,affected_columns:array<string>,insert_source:string,"
    "insert_value_kinds:array<string>,unsupported_features:array<string>>"
)


def dedupe_tables(tables: Column) -> Column:
    """Qualified names, each once, in the order they were first seen."""
    return F.array_distinct(
        F.transform(tables, lambda t: qualified_name(t["schema"], t["name"]))
    )


def listed_type(statement_type: Column) -> Column:
    """The type where it is in the closed vocabulary, UNKNOWN for everything else and NULL."""
    return F.when(statement_type.isin(vocab.STATEMENT_TYPES), statement_type).otherwise(F.lit("UNKNOWN"))


def normalize_facts(raw: DataFrame) -> DataFrame:
    """Raw parser facts -> one analyzed row per statement.

    Blank text wins over everything, then a parser failure, then the number of
    statements. Only a single parsed statement passes its facts on; every other
    row keeps the rejecting defaults.
    """
    parsed = F.coalesce(F.col("parse_success"), F.lit(False))
    found = F.coalesce(F.array_size("statements"), F.lit(0))
    status = (
        F.when(is_blank(F.col("sql")), F.lit(vocab.EMPTY_INPUT))
        .when(~parsed | (found == 0), F.lit(vocab.PARSE_ERROR))
        .when(found > 1, F.lit(vocab.MULTIPLE_STATEMENTS))
        .otherwise(F.lit(vocab.OK))
    )
    parser_text = F.coalesce(F.col("parse_error"), F.lit(""))
    error = F.when(
        F.col("status") == vocab.PARSE_ERROR,
        F.when(parsed, F.lit("parser returned success with no statements"))
        .when(parser_text == "", F.lit("parser reported failure"))
        .otherwise(parser_text),
    )
    ok = F.col("status") == vocab.OK
    only = F.get(F.col("statements"), 0)

    def names(value: Column) -> Column:
        return F.when(ok, value).otherwise(F.array().cast("array<string>"))

    def flag(name: str) -> Column:
        return F.when(ok, only[name]).otherwise(F.lit(False)).alias(name)

    return raw.withColumn("status", status).select(
        "statement_id",
        "status",
        error.alias("error_reason"),
        F.when(F.col("status") == vocab.EMPTY_INPUT, 0).otherwise(found).alias("statement_count"),
        F.when(ok, listed_type(only["type"])).otherwise(F.lit("UNKNOWN")).alias("statement_type"),
        names(dedupe_tables(only["tables"])).alias("tables"),
        names(only["projection_columns"]).alias("projection_columns"),
        flag("has_wildcard_projection"),
        flag("has_computed_projection"),
        flag("has_safe_count_star_projection"),
        flag("has_group_by"),
        names(only["affected_columns"]).alias("affected_columns"),
        F.when(ok, only["insert_source"]).otherwise(F.lit(vocab.INSERT_NONE)).alias("insert_source"),
        names(only["insert_value_kinds"]).alias("insert_value_kinds"),
        names(only["unsupported_features"]).alias("unsupported_features"),
    )


def _text_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def insert_rejection() -> Column:
    """Reason an INSERT is refused, NULL when it has the one permitted shape.

    Names compare exactly, case included: for a write, refusing too much is safe.
    """
    target = F.col("tables") == _text_array([vocab.INSERT_TABLE])
    accepted_kinds = [
        [vocab.POSITIVE_INTEGER, vocab.POSITIVE_INTEGER],
        [vocab.POSITIVE_INTEGER, vocab.POSITIVE_DECIMAL],
    ]
    kinds = F.lit(False)
    for pair in accepted_kinds:
        kinds = kinds | (F.col("insert_value_kinds") == _text_array(pair))
    shape = (
        (F.array_size("unsupported_features") == 0)
        & (F.col("insert_source") == vocab.INSERT_VALUES)
        & (F.col("affected_columns") == _text_array(vocab.INSERT_COLUMNS))
        & kinds
    )
    return F.when(~F.coalesce(target, F.lit(False)), F.lit(vocab.REASON_INSERT_TARGET)).when(
        ~F.coalesce(shape, F.lit(False)), F.lit(vocab.REASON_INSERT_SHAPE)
    )


def rejection_reason() -> Column:
    """The ordered rules; the first that matches decides, NONE means allowed."""
    status = F.col("status")
    kind = statement_class(F.col("statement_type"))
    incomplete = F.coalesce(F.array_size("unsupported_features") > 0, F.lit(True))
    system_table = F.coalesce(any_system_table(F.col("tables")), F.lit(True))
    mixed_star = F.coalesce(F.col("has_wildcard_projection"), F.lit(True)) & F.coalesce(
        F.array_size("projection_columns") > 0, F.lit(True)
    )
    return (
        F.when(status == vocab.EMPTY_INPUT, F.lit(vocab.EMPTY_INPUT))
        .when(status.isNull() | (status == vocab.PARSE_ERROR), F.lit(vocab.REASON_UNPARSEABLE))
        .when(status == vocab.MULTIPLE_STATEMENTS, F.lit(vocab.MULTIPLE_STATEMENTS))
        .when(status != vocab.OK, F.lit(vocab.REASON_UNPARSEABLE))
        .when(
            F.coalesce(F.col("statement_count") != 1, F.lit(True)),
            F.lit(vocab.MULTIPLE_STATEMENTS),
        )
        .when(kind == "UNKNOWN", F.lit(vocab.REASON_UNSUPPORTED_TYPE))
        .when(kind == "DDL", F.lit(vocab.REASON_DDL))
        .when((kind == "DML") & (F.col("statement_type") != "INSERT"), F.lit(vocab.REASON_DML))
        .when(kind == "DML", F.coalesce(insert_rejection(), F.lit(vocab.REASON_NONE)))
        .when(incomplete, F.lit(vocab.REASON_UNSUPPORTED_FEATURE))
        .when(system_table, F.lit(vocab.REASON_SYSTEM_TABLE))
        .when(mixed_star, F.lit(vocab.REASON_UNATTRIBUTABLE))
        .otherwise(F.lit(vocab.REASON_NONE))
    )


def policy_decision(facts: DataFrame) -> DataFrame:
    """Add ``reason`` and ``allowed`` to every statement; an unlisted type becomes UNKNOWN."""
    return (
        facts.withColumn("reason", rejection_reason())
        .withColumn("allowed", F.col("reason") == vocab.REASON_NONE)
        .withColumn("statement_type", listed_type(F.col("statement_type")))
    )


def client_code(outcome: Column, reason: Column, category: Column) -> Column:
    """What the caller is told; every denial but two looks the same from outside."""
    return (
        F.when(outcome == vocab.PARSING_FAILURE, F.lit("invalid_sql"))
        .when((outcome == vocab.POLICY_REJECTED) & (reason == vocab.EMPTY_INPUT), F.lit("empty_sql"))
        .when(outcome == vocab.POLICY_REJECTED, F.lit("policy_rejected"))
        .when(
            (outcome == vocab.DATABASE_FAILURE) & (category == vocab.CONNECTION_FAILURE),
            F.lit("database_unavailable"),
        )
        .when(outcome == vocab.DATABASE_FAILURE, F.lit("query_failed"))
        .when(outcome == vocab.MASKING_REFUSED, F.lit("masking_refused"))
        .when(outcome == vocab.SUCCESS, F.lit(None).cast("string"))
        .otherwise(F.lit("internal_error"))
    )


def http_status(code: Column) -> Column:
    """Status of a client code; no code means success."""
    status = F.when(code.isNull(), F.lit(200))
    for value in sorted(set(vocab.HTTP_STATUS.values())):
        names = [k for k, v in vocab.HTTP_STATUS.items() if v == value]
        status = status.when(code.isin(names), F.lit(value))
    return status.otherwise(F.lit(500))


def request_outcome(statements: DataFrame) -> DataFrame:
    """Add ``outcome``, ``category``, ``client_code`` and ``http_status``.

    Reads the decision (``allowed``, ``reason``), the execution columns
    (``exec_status``, ``row_count``, ``affected_rows``) and ``masking_failure``,
    NULL when masking succeeded. A negative count, an insert that did not change
    exactly one row or an unknown execution status is an internal failure.
    """
    allowed = F.coalesce(F.col("allowed"), F.lit(False))
    status = F.col("exec_status")
    is_insert = F.col("statement_type") == "INSERT"
    insert_ok = F.coalesce(F.col("affected_rows") == 1, F.lit(False))
    rows_ok = F.coalesce(F.col("row_count") >= 0, F.lit(False))
    failure = F.col("masking_failure")
    outcome = (
        F.when(
            ~allowed & (F.col("reason") == vocab.REASON_UNPARSEABLE), F.lit(vocab.PARSING_FAILURE)
        )
        .when(~allowed, F.lit(vocab.POLICY_REJECTED))
        .when(
            status.isin(vocab.CONNECTION_FAILURE, vocab.EXECUTION_FAILURE),
            F.lit(vocab.DATABASE_FAILURE),
        )
        .when(status.isNull() | (status != vocab.OK), F.lit(vocab.INTERNAL_FAILURE))
        .when(is_insert & insert_ok, F.lit(vocab.SUCCESS))
        .when(is_insert | ~rows_ok, F.lit(vocab.INTERNAL_FAILURE))
        .when(failure == vocab.UNATTRIBUTED_COLUMN, F.lit(vocab.MASKING_REFUSED))
        .when(failure.isNotNull(), F.lit(vocab.INTERNAL_FAILURE))
        .otherwise(F.lit(vocab.SUCCESS))
    )
    category = F.when(F.col("outcome") == vocab.DATABASE_FAILURE, status)
    return (
        statements.withColumn("outcome", outcome)
        .withColumn("category", category)
        .withColumn("client_code", client_code(F.col("outcome"), F.col("reason"), F.col("category")))
        .withColumn("http_status", http_status(F.col("client_code")))
    )


def batch_outcome_report(outcomes: DataFrame) -> DataFrame:
    """How often each outcome, reason and client code occurred."""
    return outcomes.groupBy("outcome", "reason", "client_code").agg(
        F.count("*").alias("statements")
    )
