"""Stream forms of the batch jobs.

All are stateless and use the same expressions as the batch jobs, so a stream
run to its end gives the batch result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tablewarden.operators.audit import audit_validate
from tablewarden.operators.policy import policy_decision
from tablewarden.operators.triage import triage
from tablewarden.plans.guarded import guard, guarded_read
from tablewarden.plans.lineage import tables_of
from tablewarden.plans.release import guarded_release, line_key, settled_line
from tablewarden.refusals import InternalFailure, MaskingRefused, PolicyRejected, QueryFailed


def _to_files(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_mask(stream: DataFrame, spec, path: str, checkpoint: str, mapping=None):
    """Guarded projection of a stream into a file sink; refuses before it starts."""
    return _to_files(guarded_read(stream, spec, mapping), path, checkpoint)


def stream_triage(stream: DataFrame, path: str, checkpoint: str):
    """Raw requests -> accepted SQL or a transport reject."""
    return _to_files(triage(stream), path, checkpoint)


def stream_policy(stream: DataFrame, path: str, checkpoint: str):
    """Statement facts -> policy decisions."""
    return _to_files(policy_decision(stream), path, checkpoint)


def stream_audit_validate(stream: DataFrame, path: str, checkpoint: str, position: str | None = None):
    """Violations of a trail as it grows.

    Without a ``position`` a line is named by its hash: a line that leaked is never copied.
    """
    if position is None:
        position = "line_sha256"
        stream = stream.withColumn(position, F.sha2("value", 256))
    return _to_files(audit_validate(stream, position), path, checkpoint)


def stream_release_after_audit(
    stream: DataFrame,
    spec,
    store: str,
    audit_path: str,
    checkpoint: str,
    *,
    timestamp_ms: Callable[[int], int],
    first_request: int = 1,
    mapping=None,
    tables: Sequence[str] = (),
) -> StreamingQuery:
    """Per micro-batch: stage the masked rows, store the audit record, publish.

    A batch is a request of its own, numbered from ``first_request``; its data folder, audit line and log
    entries are keyed by that number, so a replayed batch adds nothing. A batch that is refused or
    fails leaves its record, and the stream goes on with the next one. ``timestamp_ms(batch_id)`` is the
    time of the record.
    """
    guard(stream, spec, mapping, tables=tables)

    def release(batch: DataFrame, batch_id: int) -> None:
        request = {"request_id": first_request + batch_id, "timestamp_ms": timestamp_ms(batch_id)}
        # The plan of a batch is cut off from the stream's: its tables are those named here.
        names = list(dict.fromkeys([*tables, *tables_of(stream)]))
        try:
            guarded_release(
                batch, spec, store, audit_path, release_id=f"batch-{batch_id}", mapping=mapping, tables=names, **request
            )
        except (PolicyRejected, QueryFailed, MaskingRefused):
            return  # recorded
        except InternalFailure:
            if settled_line(batch.sparkSession, audit_path, line_key(request["request_id"])) is None:
                raise  # nothing could be recorded: the batch has to run again

    return (
        stream.writeStream.foreachBatch(release)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
