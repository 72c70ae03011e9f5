"""From statement facts to settled requests and audit records, set at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden import vocab
from tablewarden.operators.audit import audit_build
from tablewarden.operators.classify import Mapping, classify_bulk, with_pii_counts
from tablewarden.operators.policy import policy_decision, request_outcome


def settle(
    facts: DataFrame,
    executions: DataFrame,
    mapping: Mapping | None = None,
    refusals: DataFrame | None = None,
) -> DataFrame:
    """Decision, classification and outcome of every statement.

    ``executions`` has at most one row per statement, so the join has no skew;
    a statement without one is an internal failure if it was allowed.
    ``refusals(statement_id, masking_failure)`` adds preflight failures of rows
    that were really masked; without it, attribution alone decides.
    """
    decided = with_pii_counts(classify_bulk(policy_decision(facts), mapping))
    joined = decided.join(executions, "statement_id", "left")
    unattributed = F.when(~F.col("fully_attributed"), F.lit(vocab.UNATTRIBUTED_COLUMN))
    if refusals is None:
        failed = joined.withColumn("masking_failure", unattributed)
    else:
        failed = joined.join(refusals, "statement_id", "left").withColumn(
            "masking_failure", F.coalesce("masking_failure", unattributed)
        )
    return request_outcome(
        failed.withColumn("column_count", F.array_size("result_columns").cast("bigint"))
    )


def audit_records(settled: DataFrame, times: DataFrame) -> DataFrame:
    """Audit records of settled statements, with their arrival times."""
    timed = settled.join(times, "statement_id")
    return audit_build(timed.withColumn("request_id", F.col("statement_id") + 1))
