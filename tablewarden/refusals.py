"""Why a guarded read, release or append did not hand out data."""

from __future__ import annotations


class Refusal(Exception):
    """Base of every refusal; ``client_code`` is all a caller may be told."""

    client_code = "internal_error"


class PolicyRejected(Refusal):
    client_code = "policy_rejected"

    def __init__(self, reason: str):
        super().__init__(reason)
        self.reason = reason


class QueryFailed(Refusal):
    """Spark rejected the query, at analysis or while it ran."""

    client_code = "query_failed"


class MaskingRefused(Refusal):
    client_code = "masking_refused"

    def __init__(self, reason: str, column_count: int):
        super().__init__(reason)
        self.reason = reason
        self.column_count = column_count


class InternalFailure(Refusal):
    """A broken contract between steps, or a release that could not be audited."""

    def __init__(self, reason: str):
        super().__init__(reason)
        self.reason = reason
