"""Closed vocabularies shared by every job.

All names below are fixed values: they appear in audit lines and client
responses, so they must be spelled exactly like this.
"""

# Statement types and their classes.
STATEMENT_TYPES = ["SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "ALTER", "DROP", "UNKNOWN"]
DML_TYPES = ["INSERT", "UPDATE", "DELETE"]
DDL_TYPES = ["CREATE", "ALTER", "DROP"]

# Analysis status.
OK = "OK"
EMPTY_INPUT = "EMPTY_INPUT"
PARSE_ERROR = "PARSE_ERROR"
MULTIPLE_STATEMENTS = "MULTIPLE_STATEMENTS"

# Policy reasons.
REASON_NONE = "NONE"
REASON_NOT_EVALUATED = "NOT_EVALUATED"
REASON_UNPARSEABLE = "UNPARSEABLE_SQL"
REASON_UNSUPPORTED_TYPE = "UNSUPPORTED_STATEMENT_TYPE"
REASON_UNSUPPORTED_FEATURE = "UNSUPPORTED_SQL_FEATURE"
REASON_DDL = "DDL_NOT_ALLOWED"
REASON_DML = "DML_NOT_ALLOWED"
REASON_SYSTEM_TABLE = "SYSTEM_TABLE_ACCESS"
REASON_UNATTRIBUTABLE = "UNATTRIBUTABLE_PROJECTION"
REASON_INSERT_TARGET = "INSERT_TARGET_NOT_ALLOWED"
REASON_INSERT_SHAPE = "UNSUPPORTED_INSERT_SHAPE"

# The reasons a POLICY_REJECTED audit record may carry.
AUDITABLE_REASONS = [
    "EMPTY_INPUT",
    "MULTIPLE_STATEMENTS",
    "UNSUPPORTED_STATEMENT_TYPE",
    "UNSUPPORTED_SQL_FEATURE",
    "DDL_NOT_ALLOWED",
    "DML_NOT_ALLOWED",
    "SYSTEM_TABLE_ACCESS",
    "UNATTRIBUTABLE_PROJECTION",
    "INSERT_TARGET_NOT_ALLOWED",
    "UNSUPPORTED_INSERT_SHAPE",
]

# PII categories and column classes.
EMAIL = "PII.Email"
PHONE = "PII.Phone"
CREDIT_CARD = "PII.CreditCard"
NOT_PII = "NotClassifiedAsPii"
PII = "Pii"
UNATTRIBUTED = "Unattributed"

# Default column name to category mapping.
DEFAULT_MAPPING = [
    ("email", EMAIL),
    ("phone", PHONE),
    ("credit_card", CREDIT_CARD),
]

# Masking failures.
UNATTRIBUTED_COLUMN = "UNATTRIBUTED_COLUMN"
STRUCTURAL_MISMATCH = "STRUCTURAL_MISMATCH"
INVALID_CLASSIFICATION = "INVALID_CLASSIFICATION"

# Audit outcomes and database failure categories.
SUCCESS = "SUCCESS"
PARSING_FAILURE = "PARSING_FAILURE"
POLICY_REJECTED = "POLICY_REJECTED"
DATABASE_FAILURE = "DATABASE_FAILURE"
MASKING_REFUSED = "MASKING_REFUSED"
INTERNAL_FAILURE = "INTERNAL_FAILURE"
OUTCOMES = [
    SUCCESS,
    PARSING_FAILURE,
    POLICY_REJECTED,
    DATABASE_FAILURE,
    MASKING_REFUSED,
    INTERNAL_FAILURE,
]
CONNECTION_FAILURE = "CONNECTION_FAILURE"
EXECUTION_FAILURE = "EXECUTION_FAILURE"

# Client codes and the HTTP status each one maps to.
HTTP_STATUS = {
    "empty_sql": 400,
    "invalid_sql": 400,
    "policy_rejected": 403,
    "database_unavailable": 503,
    "query_failed": 400,
    "masking_refused": 422,
    "internal_error": 500,
    "invalid_content_type": 400,
    "invalid_json": 400,
    "invalid_request": 400,
    "sql_too_large": 400,
}

# Insert sources and literal kinds.
INSERT_NONE = "NONE"
INSERT_VALUES = "VALUES"
INSERT_SELECT = "SELECT"
POSITIVE_INTEGER = "POSITIVE_INTEGER_LITERAL"
POSITIVE_DECIMAL = "POSITIVE_DECIMAL_LITERAL"
NON_POSITIVE = "NON_POSITIVE_NUMERIC_LITERAL"
KIND_UNSUPPORTED = "UNSUPPORTED"

# The one permitted write and the transport limits.
INSERT_TABLE = "orders"
INSERT_COLUMNS = ["customer_id", "amount"]
MAX_SQL_BYTES = 65536
MAX_AUDITED_TABLES = 8
MAX_TABLE_NAME_BYTES = 63
