"""Audited release: data becomes visible only after its audit record is stored."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from tablewarden import vocab
from tablewarden.operators.audit import audit_build
from tablewarden.operators.classify import Mapping
from tablewarden.operators.projection import Entry
from tablewarden.plans.guarded import GuardedResult, guard
from tablewarden.plans.lineage import tables_of
from tablewarden.refusals import (
    InternalFailure,
    MaskingRefused,
    PolicyRejected,
    QueryFailed,
    Refusal,
)
from tablewarden.sources import releases
from tablewarden.sources.trail import append_audit, keyed_append

# Input columns of audit_build, for records made on the driver.
OUTCOME_SCHEMA = (
    "request_id bigint, timestamp_ms bigint, outcome string, statement_type string, "
    "statement_count bigint, reason string, category string, row_count bigint, "
    "column_count bigint, affected_rows bigint, pii_email_columns bigint, "
    "pii_phone_columns bigint, pii_credit_card_columns bigint, tables array<string>"
)

Append = Callable[[DataFrame, str, str], None]


def line_key(request_id: int) -> str:
    """The key under which a request's only audit line is appended."""
    return f"request-{request_id}"


def outcome_record(spark: SparkSession, **fields) -> DataFrame:
    """One audit record for one request."""
    names = [part.split()[0] for part in OUTCOME_SCHEMA.split(", ")]
    row = tuple(fields.get(name) for name in names)
    return audit_build(spark.createDataFrame([row], OUTCOME_SCHEMA))


def settled_line(spark: SparkSession, audit_path: str, key: str) -> dict | None:
    """The record that a complete append with that key holds."""
    folder = keyed_append(spark, audit_path, key)
    return folder and json.loads(spark.read.text(folder).first()[0])


def release_after_audit(
    result: GuardedResult,
    store: str,
    audit_path: str,
    *,
    release_id: str,
    request_id: int,
    timestamp_ms: int,
    append: Append = append_audit,
) -> dict:
    """Stage the rows, log them, append the audit record, then publish.

    When the record cannot be stored nothing is published and the caller gets an
    internal error; the staged rows stay invisible.

    The call may be repeated after a crash at any point: a request has one audit
    line, and the rows it speaks of are those that get published. If the line is
    there and tells of a success, the rows staged for it are published unless
    they are already; if it tells of a refusal, the request stays refused.
    """
    spark = result.frame.sparkSession
    request = {"request_id": request_id, "timestamp_ms": timestamp_ms, "statement_type": "SELECT"}
    key = line_key(request_id)
    line = settled_line(spark, audit_path, key)
    if line is not None:
        return _settled(spark, store, release_id, key, line)
    try:
        entry = releases.stage(result.frame, store, release_id)
        releases.log_entry(spark, store, entry, releases.STAGED, key)
    except Exception as error:
        ran = isinstance(error, (PySparkException, Py4JJavaError))
        refusal = (
            QueryFailed("the query failed while it ran")
            if ran
            else InternalFailure("the result could not be stored")
        )
        audit_refusal(
            spark, refusal, audit_path, tables=result.tables, append=append, **request
        )
        raise refusal from error
    try:
        append(success_record(spark, entry, result, **request), audit_path, key)
    except Exception as error:
        raise InternalFailure("release could not be audited") from error
    releases.publish(spark, store, entry, key)
    return entry


def _settled(spark: SparkSession, store: str, release_id: str, key: str, line: dict) -> dict:
    """Finish a request whose audit line exists."""
    if line["outcome"] != vocab.SUCCESS:
        raise InternalFailure(f"the request was settled as {line['outcome']}")
    done = releases.newest(spark, store, release_id, releases.PUBLISHED, key)
    if done is not None:
        return done
    staged = releases.newest(spark, store, release_id, releases.STAGED, key)
    if staged is None:
        raise InternalFailure("the request was settled for another release")
    releases.publish(spark, store, staged, key)
    return staged


def success_record(spark: SparkSession, entry: dict, result: GuardedResult, **request) -> DataFrame:
    return outcome_record(
        spark,
        **request,
        outcome=vocab.SUCCESS,
        row_count=entry["row_count"],
        column_count=entry["column_count"],
        pii_email_columns=result.classes.count_of(vocab.EMAIL),
        pii_phone_columns=result.classes.count_of(vocab.PHONE),
        pii_credit_card_columns=result.classes.count_of(vocab.CREDIT_CARD),
        tables=result.tables,
    )


def guarded_release(
    relation: DataFrame,
    spec: Iterable[Entry],
    store: str,
    audit_path: str,
    *,
    release_id: str,
    request_id: int,
    timestamp_ms: int,
    mapping: Mapping | None = None,
    append: Append = append_audit,
    **options,
) -> dict:
    """One request from question to release: whatever happens, it leaves exactly one audit line.

    Refusals of the guard are recorded and raised again; ``options`` are those of ``guard``.
    """
    spark = relation.sparkSession
    request = {"request_id": request_id, "timestamp_ms": timestamp_ms}
    try:
        result = guard(relation, spec, mapping, **options)
    except Refusal as refusal:
        tables = list(dict.fromkeys([*options.get("tables", ()), *tables_of(relation)]))
        audit_refusal(spark, refusal, audit_path, tables=tables, append=append, **request)
        raise
    return release_after_audit(result, store, audit_path, release_id=release_id, append=append, **request)


def audit_refusal(
    spark: SparkSession,
    refusal: Refusal,
    audit_path: str,
    *,
    request_id: int,
    timestamp_ms: int,
    statement_type: str = "SELECT",
    tables: list[str] | None = None,
    key: str | None = None,
    append: Append = append_audit,
) -> bool:
    """Record a refusal. A failing trail never replaces the refusal itself."""
    fields = {"statement_type": statement_type, "tables": tables}
    match refusal:
        case PolicyRejected(reason=reason):
            fields |= {"outcome": vocab.POLICY_REJECTED, "reason": reason, "statement_count": 1}
        case QueryFailed():
            fields |= {"outcome": vocab.DATABASE_FAILURE, "category": vocab.EXECUTION_FAILURE}
        case MaskingRefused(column_count=width):
            fields |= {"outcome": vocab.MASKING_REFUSED, "column_count": width}
        case _:
            fields |= {"outcome": vocab.INTERNAL_FAILURE}
    record = outcome_record(spark, request_id=request_id, timestamp_ms=timestamp_ms, **fields)
    try:
        append(record, audit_path, line_key(request_id) if key is None else key)
    except Exception:
        return False
    return True
