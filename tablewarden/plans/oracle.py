"""Reference SQL for the registered queries, in DuckDB's dialect.

Each text answers its query from the base tables alone, written relationally and
independently of the Spark jobs. Only the input derivations are shared.
"""

from __future__ import annotations

from tablewarden.plans import registry
from tablewarden.sources import derived

# Derived inputs as common table expressions.


def _select(columns: dict[str, str], table: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + f" FROM {table}"


def _list(csv: str) -> str:
    return f"CASE WHEN {csv} = '' THEN [] ELSE string_split({csv}, ',') END"


def _email(x: str) -> str:
    return (
        f"CASE WHEN {x} IS NULL OR {x} = '' THEN {x}"
        f" WHEN regexp_full_match({x}, '[^@]+@[^@]+') THEN"
        f" (CASE WHEN strlen({x}[1]) = 1 THEN {x}[1] ELSE '' END) || '***@' || split_part({x}, '@', 2)"
        f" ELSE '***' END"
    )


def _phone(x: str) -> str:
    digits = f"regexp_replace({x}, '[^0-9]', '', 'g')"
    return (
        f"CASE WHEN {x} IS NULL OR {x} = '' THEN {x}"
        f" WHEN length({digits}) >= 7 THEN '***' || right({digits}, 4) ELSE '***' END"
    )


def _card(x: str) -> str:
    digits = f"regexp_replace({x}, '[ -]', '', 'g')"
    return (
        f"CASE WHEN {x} IS NULL OR {x} = '' THEN {x}"
        f" WHEN regexp_full_match({digits}, '[0-9]{{12,}}') THEN '****' || right({digits}, 4)"
        f" ELSE '***' END"
    )


SYSTEM_TABLE = (
    "(CASE WHEN contains({t}, '.') THEN lower(split_part({t}, '.', 1)) IN ('pg_catalog', 'information_schema')"
    " OR starts_with(lower(substr({t}, strpos({t}, '.') + 1)), 'pg_') ELSE starts_with(lower({t}), 'pg_') END)"
)
ORDERS_INSERT = (
    "len(unsupported_features) = 0 AND insert_source = 'VALUES'"
    " AND affected_columns = ['customer_id', 'amount'] AND len(insert_value_kinds) = 2"
    " AND insert_value_kinds[1] = 'POSITIVE_INTEGER_LITERAL'"
    " AND insert_value_kinds[2] IN ('POSITIVE_INTEGER_LITERAL', 'POSITIVE_DECIMAL_LITERAL')"
)


def _category(name: str, mapping: dict[str, str]) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE lower({name}) {cases} END"


DEFAULTS = {"email": "PII.Email", "phone": "PII.Phone", "credit_card": "PII.CreditCard"}
CUSTOM = {"name": "PII.Email", "amount": "PII.CreditCard", "contact": "PII.Phone"}

_VALID_TABLE = "regexp_full_match(t, '[A-Za-z_][A-Za-z0-9_$]{0,62}')"


def _classes(mapping: dict[str, str]) -> str:
    bare = "regexp_replace(judged, '^.*\\.', '')"
    return f"""
SELECT statement_id, ordinal, column_name,
 CASE WHEN attribution IS NULL THEN 'Unattributed' WHEN category IS NULL THEN 'NotClassifiedAsPii'
  ELSE 'Pii' END AS data_class, category, attribution
FROM (SELECT statement_id, ordinal, column_name, attribution, {_category(bare, mapping)} AS category
 FROM (SELECT statement_id, i - 1 AS ordinal, result_columns[i] AS column_name, attribution,
   CASE attribution WHEN 'POSITIONAL' THEN projection_columns[i] WHEN 'WILDCARD' THEN result_columns[i] END AS judged
  FROM (SELECT *, unnest(range(1, len(result_columns) + 1)) AS i FROM attributed)))"""


# Name -> (text, names it needs).
CTES: dict[str, tuple[str, list[str]]] = {
    "contacts": (_select(derived.CONTACTS, "customer"), []),
    "purchases": (_select(derived.PURCHASES, "orders"), []),
    "candidates": (_select(derived.CANDIDATES, "orders"), []),
    "mapping_candidates": (_select(derived.MAPPING_CANDIDATES, "part"), []),
    "masked": (
        f"SELECT id, name, {_email('email')} AS email, {_phone('phone')} AS phone,"
        f" {_card('credit_card')} AS credit_card FROM contacts",
        ["contacts"],
    ),
    "flat_facts": (_select(derived.FACTS, "events"), []),
    "facts": (
        f"""SELECT statement_id, status, statement_count, statement_type, {_list('tables_csv')} AS tables,
 {_list('projection_csv')} AS projection_columns, {_list('result_csv')} AS result_columns,
 has_wildcard, has_computed, has_count_star, has_group_by, {_list('unsupported_csv')} AS unsupported_features,
 insert_source, {_list('affected_csv')} AS affected_columns, {_list('kinds_csv')} AS insert_value_kinds
FROM flat_facts""",
        ["flat_facts"],
    ),
    "decided": (
        f"""SELECT *, CASE
 WHEN status = 'EMPTY_INPUT' THEN 'EMPTY_INPUT' WHEN status = 'PARSE_ERROR' THEN 'UNPARSEABLE_SQL'
 WHEN status = 'MULTIPLE_STATEMENTS' OR statement_count <> 1 THEN 'MULTIPLE_STATEMENTS'
 WHEN statement_type IN ('CREATE', 'ALTER', 'DROP') THEN 'DDL_NOT_ALLOWED'
 WHEN statement_type IN ('UPDATE', 'DELETE') THEN 'DML_NOT_ALLOWED'
 WHEN statement_type = 'INSERT' THEN CASE WHEN tables <> ['orders'] THEN 'INSERT_TARGET_NOT_ALLOWED'
  WHEN {ORDERS_INSERT} THEN 'NONE' ELSE 'UNSUPPORTED_INSERT_SHAPE' END
 WHEN statement_type <> 'SELECT' THEN 'UNSUPPORTED_STATEMENT_TYPE'
 WHEN len(unsupported_features) > 0 THEN 'UNSUPPORTED_SQL_FEATURE'
 WHEN len(list_filter(tables, lambda t: {SYSTEM_TABLE.format(t='t')})) > 0 THEN 'SYSTEM_TABLE_ACCESS'
 WHEN has_wildcard AND len(projection_columns) > 0 THEN 'UNATTRIBUTABLE_PROJECTION'
 ELSE 'NONE' END AS reason FROM facts""",
        ["facts"],
    ),
    "attributed": (
        """SELECT *, CASE WHEN status <> 'OK' OR statement_type <> 'SELECT' OR has_computed THEN NULL
 WHEN len(projection_columns) > 0 THEN CASE WHEN NOT has_wildcard AND NOT has_count_star
   AND len(projection_columns) = len(result_columns) THEN 'POSITIONAL' END
 WHEN has_wildcard AND NOT has_count_star THEN 'WILDCARD'
 WHEN has_count_star AND NOT has_wildcard AND NOT has_group_by THEN 'COUNT_STAR' END AS attribution
FROM decided""",
        ["decided"],
    ),
    "classes": (_classes(DEFAULTS), ["attributed"]),
    "custom_classes": (_classes(CUSTOM), ["attributed"]),
    "executions": (_select(derived.EXECUTIONS, "events"), []),
    "settled": (
        """SELECT a.*, e.exec_status, e.row_count, e.affected_rows,
 CASE WHEN reason = 'UNPARSEABLE_SQL' THEN 'PARSING_FAILURE' WHEN reason <> 'NONE' THEN 'POLICY_REJECTED'
  WHEN exec_status <> 'OK' THEN 'DATABASE_FAILURE'
  WHEN statement_type = 'INSERT' THEN CASE WHEN affected_rows = 1 THEN 'SUCCESS' ELSE 'INTERNAL_FAILURE' END
  WHEN row_count < 0 THEN 'INTERNAL_FAILURE'
  WHEN attribution IS NULL AND len(result_columns) > 0 THEN 'MASKING_REFUSED' ELSE 'SUCCESS' END AS outcome
FROM attributed a JOIN executions e USING (statement_id)""",
        ["attributed", "executions"],
    ),
    "coded": (
        """SELECT *, CASE WHEN outcome = 'DATABASE_FAILURE' THEN exec_status END AS category,
 CASE outcome WHEN 'PARSING_FAILURE' THEN 'invalid_sql'
  WHEN 'POLICY_REJECTED' THEN CASE WHEN reason = 'EMPTY_INPUT' THEN 'empty_sql' ELSE 'policy_rejected' END
  WHEN 'DATABASE_FAILURE' THEN CASE WHEN exec_status = 'CONNECTION_FAILURE' THEN 'database_unavailable'
   ELSE 'query_failed' END
  WHEN 'MASKING_REFUSED' THEN 'masking_refused' WHEN 'INTERNAL_FAILURE' THEN 'internal_error' END AS client_code
FROM settled""",
        ["settled"],
    ),
    "statused": (
        """SELECT *, CASE client_code WHEN 'policy_rejected' THEN 403 WHEN 'database_unavailable' THEN 503
 WHEN 'masking_refused' THEN 422 WHEN 'internal_error' THEN 500 WHEN 'empty_sql' THEN 400
 WHEN 'invalid_sql' THEN 400 WHEN 'query_failed' THEN 400 ELSE 200 END AS http_status FROM coded""",
        ["coded"],
    ),
    "pii_counts": (
        """SELECT f.statement_id, count(*) FILTER (category = 'PII.Email') AS pii_email_columns,
 count(*) FILTER (category = 'PII.Phone') AS pii_phone_columns,
 count(*) FILTER (category = 'PII.CreditCard') AS pii_credit_card_columns
FROM facts f LEFT JOIN classes c USING (statement_id) GROUP BY f.statement_id""",
        ["facts", "classes"],
    ),
    "table_state": (
        f"""SELECT statement_id, tables, CASE WHEN len(tables) = 0 THEN 'ABSENT' WHEN len(tables) > 8 THEN 'OMITTED'
 WHEN len(list_filter(tables, lambda t: NOT {_VALID_TABLE})) = 0 THEN 'PRESENT' ELSE 'OMITTED' END AS table_state
FROM facts""",
        ["facts"],
    ),
    "lines": (
        """SELECT s.statement_id + 1 AS request_id, concat('{',
 CASE WHEN outcome = 'SUCCESS' AND statement_type = 'INSERT' THEN concat('"affected_rows":', affected_rows, ',') END,
 CASE WHEN outcome = 'DATABASE_FAILURE' THEN concat('"category":"', category, '",') END,
 CASE WHEN outcome = 'MASKING_REFUSED' OR (outcome = 'SUCCESS' AND statement_type = 'SELECT')
  THEN concat('"column_count":', len(result_columns), ',') END,
 '"outcome":"', outcome, '",',
 CASE WHEN outcome = 'SUCCESS' AND statement_type = 'SELECT' THEN concat('"pii_credit_card_columns":',
  pii_credit_card_columns, ',"pii_email_columns":', pii_email_columns, ',"pii_phone_columns":', pii_phone_columns, ',') END,
 CASE WHEN outcome = 'POLICY_REJECTED' THEN concat('"reason":"', reason, '",') END,
 CASE WHEN outcome IN ('PARSING_FAILURE', 'INTERNAL_FAILURE') OR table_state = 'ABSENT' THEN ''
  WHEN table_state = 'PRESENT' THEN concat('"referenced_tables":', CAST(to_json(t.tables) AS VARCHAR), ',')
  ELSE '"referenced_tables_omitted":true,' END,
 '"request_id":', s.statement_id + 1, ',',
 CASE WHEN outcome = 'SUCCESS' AND statement_type = 'SELECT' THEN concat('"row_count":', row_count, ',') END,
 CASE WHEN outcome = 'POLICY_REJECTED' THEN concat('"statement_count":', statement_count, ',') END,
 CASE WHEN outcome NOT IN ('PARSING_FAILURE', 'INTERNAL_FAILURE')
  THEN concat('"statement_type":"', statement_type, '",') END,
 '"timestamp":"', strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ'), '"}') AS value
FROM coded s JOIN pii_counts p USING (statement_id) JOIN table_state t USING (statement_id)
 JOIN events e ON e.event_id = s.statement_id""",
        ["coded", "pii_counts", "table_state"],
    ),
    "bad_lines": (
        f"SELECT request_id AS position, {registry.LINE_DEFECTS} AS value FROM lines",
        ["lines"],
    ),
    "leaky_lines": (
        f"SELECT request_id AS position, {registry.LINE_LEAKS} AS value FROM lines",
        ["lines"],
    ),
    "raw_facts": (_select(derived.RAW_FACTS, "events"), []),
    "normalized": (
        """SELECT *, CASE WHEN NOT parse_success THEN 'PARSE_ERROR' WHEN found = 0 THEN 'PARSE_ERROR'
 WHEN found > 1 THEN 'MULTIPLE_STATEMENTS' ELSE 'OK' END AS parsed_status,
 regexp_full_match(sql, '[ \\t\\n\\r\\f\\x0B]*') AS blank,
 concat(CASE WHEN first_schema <> '' THEN first_schema || '.' ELSE '' END, first_table) AS t1,
 concat(CASE WHEN second_schema <> '' THEN second_schema || '.' ELSE '' END, second_table) AS t2
FROM raw_facts""",
        ["raw_facts"],
    ),
    "requests": (_select(derived.REQUESTS, "events"), []),
    "triaged": (
        """SELECT *, CASE WHEN NOT starts_with(content_type, 'application/json') THEN 'invalid_content_type'
 WHEN kind IS NULL OR kind <> 'OBJECT' THEN 'invalid_json'
 WHEN field_kind IS NULL OR field_kind <> 'VARCHAR' THEN 'invalid_request'
 WHEN strlen(sql) > 65536 THEN 'sql_too_large' END AS transport_code
FROM (SELECT *, json_type(doc) AS kind, json_type(doc, '$.sql') AS field_kind,
  json_extract_string(doc, '$.sql') AS sql FROM (SELECT *, TRY_CAST(body AS JSON) AS doc FROM requests))""",
        ["requests"],
    ),
    "order_checks": (
        """SELECT c.*, CASE WHEN customer_id IS NULL OR amount IS NULL OR customer_id <= 0 OR amount <= 0
  THEN 'UNSUPPORTED_INSERT_SHAPE' WHEN TRY_CAST(amount AS DECIMAL(10,2)) IS NULL THEN 'EXECUTION_FAILURE'
  ELSE 'OK' END AS row_status, EXISTS (SELECT 1 FROM contacts k WHERE k.id = c.customer_id) AS known
FROM candidates c""",
        ["candidates", "contacts"],
    ),
    "accepted": (
        """SELECT id AS candidate_id, customer_id, CAST(amount AS DECIMAL(10,2)) AS amount
FROM order_checks WHERE row_status = 'OK' AND known""",
        ["order_checks"],
    ),
    "entries": (
        "SELECT event_id AS statement_id, "
        + "CASE event_id % 16 "
        + " ".join(f"WHEN {i} THEN '{label}'" for i, label in enumerate(derived.ENTRY_LABELS))
        + " END AS label, (event_id // 16) % 3 = 0 AS paired, event_id % 7 = 0 AS has_group_by FROM events",
        [],
    ),
    "refusals": (
        """SELECT *, CASE WHEN NOT has_group_by AND ((paired AND (label IN ('email', '*') OR windowed)))
  THEN 'QUERY_FAILED' WHEN label IN ('email', '*') AND NOT paired THEN NULL
  WHEN label = 'COUNT(*)' AND NOT has_group_by THEN NULL ELSE 'MASKING_REFUSED' END AS refusal
FROM (SELECT *, label LIKE '% OVER ()' AS windowed FROM entries)""",
        ["entries"],
    ),
    "result_types": (
        """SELECT statement_id, i - 1 AS ordinal, result_columns[i] AS column_name,
 (['Text', 'Text', 'Integer', 'Integer', 'Float', 'Float', 'Numeric', 'Boolean', 'Timestamp', 'Timestamp',
   'Date', 'Other'])[(statement_id + i - 1) % 12 + 1] AS neutral_type
FROM (SELECT *, unnest(range(1, len(result_columns) + 1)) AS i FROM facts)""",
        ["facts"],
    ),
    "text_rows": (
        """SELECT statement_id, row_no, CASE WHEN width = 0 THEN [] ELSE list_transform(range(1, width + 1), lambda j:
  CASE j % 4 WHEN 1 THEN concat('user', statement_id, '@example.com')
   WHEN 2 THEN concat('05', lpad(CAST(statement_id AS VARCHAR), 8, '0'))
   WHEN 3 THEN '6200 3040 5060 7080' END) END AS cells, width, len(result_columns) AS expected
FROM (SELECT *, len(result_columns) + CASE WHEN statement_id % 37 = 0 AND row_no = 1 THEN 1 ELSE 0 END AS width
 FROM (SELECT statement_id, result_columns, unnest(range(1, statement_id % 3 + 2)) AS row_no FROM facts))""",
        ["facts"],
    ),
    "refused_statements": (
        """SELECT a.statement_id, CASE WHEN w.bad THEN 'STRUCTURAL_MISMATCH' ELSE 'UNATTRIBUTED_COLUMN' END AS masking_failure
FROM attributed a JOIN (SELECT statement_id, bool_or(width <> expected) AS bad FROM text_rows GROUP BY 1) w
 USING (statement_id)
WHERE w.bad OR (a.attribution IS NULL AND len(a.result_columns) > 0)""",
        ["attributed", "text_rows"],
    ),
}


def _with(final: str, *needed: str) -> str:
    """Put the needed CTEs, in dependency order, in front of a query."""
    order: list[str] = []

    def visit(name: str) -> None:
        for other in CTES[name][1]:
            visit(other)
        if name not in order:
            order.append(name)

    for name in needed:
        visit(name)
    if not order:
        return final
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][0]})" for n in order) + "\n" + final


_JOINED = "masked c JOIN purchases o ON c.id = o.customer_id"
_ALL_CLASSES = "SELECT statement_id, CAST(ordinal AS INTEGER) AS ordinal, column_name, data_class, category FROM "
_REFUSED = (
    "SELECT statement_id, 'UNATTRIBUTED_COLUMN' AS masking_failure FROM attributed"
    " WHERE reason = 'NONE' AND statement_type = 'SELECT' AND attribution IS NULL"
    " AND len(result_columns) > 0 AND "
)
_REFUSED_LISTS = "SELECT statement_id, has_group_by, refusal FROM refusals WHERE refusal IS NOT NULL AND "


def _outer(how: str) -> str:
    return _with(
        "SELECT c.id, c.email, c.phone, o.order_id, o.customer_id FROM masked c"
        f" {how} JOIN (SELECT id AS order_id, customer_id FROM candidates) o ON c.id = o.customer_id",
        "masked",
        "candidates",
    )


def _line_checks() -> str:
    """One SELECT per violation code over parsed lines."""
    text = {k: f"json_extract_string(doc, '$.{k}')" for k in ["outcome", "statement_type", "reason", "category", "timestamp"]}
    kind = lambda k: f"json_type(doc, '$.{k}')"
    envelope = ["timestamp", "request_id", "outcome"]
    shapes = {
        "write": ["statement_type", "affected_rows"],
        "read": [
            "statement_type",
            "row_count",
            "column_count",
            "pii_email_columns",
            "pii_phone_columns",
            "pii_credit_card_columns",
        ],
        "policy": ["reason", "statement_type", "statement_count"],
        "database": ["category", "statement_type"],
        "refused": ["statement_type", "column_count"],
    }
    keys = {k: "[" + ", ".join(f"'{x}'" for x in envelope + v) + "]" for k, v in shapes.items()}
    bare = "[" + ", ".join(f"'{x}'" for x in envelope) + "]"
    forbidden = (
        "['sql','query','raw_sql','values','rows','columns','column_names','aliases','error_message',"
        "'exception','path','user_id','database_url','stack_trace','sqlstate','message','error','table',"
        "'tables','schema']"
    )
    checks = {
        "MISSING_KEY": "len(list_filter(expected, lambda k: NOT list_contains(present, k))) > 0",
        "UNEXPECTED_KEY": "len(list_filter(present, lambda k: NOT list_contains(expected, k))) > 0",
        "FORBIDDEN_KEY": f"len(list_intersect(names, {forbidden})) > 0",
        "BOTH_TABLE_KEYS": "list_contains(names, 'referenced_tables') AND list_contains(names, 'referenced_tables_omitted')",
        "BAD_OMITTED_FLAG": "list_contains(names, 'referenced_tables_omitted')"
        f" AND NOT ({kind('referenced_tables_omitted')} = 'BOOLEAN'"
        " AND json_extract_string(doc, '$.referenced_tables_omitted') = 'true')",
        "BAD_TABLE_LIST": "list_contains(names, 'referenced_tables') AND (len(listed) > 8 OR"
        " len(list_filter(listed, lambda t: NOT regexp_full_match(t, '[A-Za-z_][A-Za-z0-9_$]{0,62}'))) > 0)",
        "BAD_TIMESTAMP": f"NOT regexp_full_match({text['timestamp']},"
        " '[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}[.][0-9]{3}Z')",
        "FREE_FORM_STRING": "len(list_filter(names, lambda k: NOT list_contains(['outcome', 'statement_type',"
        " 'reason', 'category', 'timestamp'], k) AND json_type(json_extract(doc, '$.' || k)) = 'VARCHAR')) > 0",
        "BAD_OUTCOME": f"{text['outcome']} NOT IN ('SUCCESS', 'PARSING_FAILURE', 'POLICY_REJECTED',"
        " 'DATABASE_FAILURE', 'MASKING_REFUSED', 'INTERNAL_FAILURE')",
        "BAD_STATEMENT_TYPE": f"{text['statement_type']} NOT IN ('SELECT', 'INSERT', 'UPDATE', 'DELETE',"
        " 'CREATE', 'ALTER', 'DROP', 'UNKNOWN')",
    }
    codes = ", ".join(f"CASE WHEN {c} THEN '{name}' END" for name, c in checks.items())
    return f"""SELECT position, value, violation FROM (
 SELECT position, value, unnest(list_filter([{codes}], lambda c: c IS NOT NULL)) AS violation FROM (
 SELECT *, list_filter(names, lambda k: k NOT IN ('referenced_tables', 'referenced_tables_omitted')) AS present,
  CASE WHEN {text['outcome']} = 'SUCCESS' AND {text['statement_type']} = 'INSERT' THEN {keys['write']}
   WHEN {text['outcome']} = 'SUCCESS' THEN {keys['read']} WHEN {text['outcome']} = 'POLICY_REJECTED' THEN {keys['policy']}
   WHEN {text['outcome']} = 'DATABASE_FAILURE' THEN {keys['database']}
   WHEN {text['outcome']} = 'MASKING_REFUSED' THEN {keys['refused']} ELSE {bare} END AS expected
 FROM (SELECT *, json_keys(doc) AS names, CAST(json_extract(doc, '$.referenced_tables') AS VARCHAR[]) AS listed
  FROM (SELECT *, TRY_CAST(value AS JSON) AS doc FROM bad_lines) WHERE doc IS NOT NULL)))
UNION ALL SELECT position, value, 'NOT_A_JSON_OBJECT' FROM bad_lines WHERE TRY_CAST(value AS JSON) IS NULL"""


def _norm(column: str, default: str) -> str:
    return f"CASE WHEN NOT blank AND parsed_status = 'OK' THEN {column} ELSE {default} END"


def oracle_texts() -> dict[str, str]:
    masked = "SELECT id, name, email, phone, credit_card FROM masked"
    lines = _line_checks()
    numbered = _with(
        "SELECT (SELECT max(id) FROM purchases) + row_number() OVER (ORDER BY candidate_id) AS id,"
        " customer_id, amount FROM accepted",
        "accepted",
        "purchases",
    )
    texts = {
        "scan_table": "SELECT * FROM customer",
        "column_catalog": _with(
            "SELECT statement_id, CAST(ordinal AS INTEGER) AS ordinal, column_name, neutral_type FROM result_types",
            "result_types",
        ),
        "render_text": _with(
            "SELECT CAST(id AS VARCHAR) AS id, CAST(customer_id AS VARCHAR) AS customer_id,"
            " CAST(amount AS VARCHAR) AS amount, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at,"
            " CASE WHEN amount > 250000 THEN 't' ELSE 'f' END AS large FROM purchases",
            "purchases",
        ),
        "result_json_rows": _with(
            "SELECT CAST(to_json([CAST(id AS VARCHAR), name, email, phone, credit_card]) AS VARCHAR) AS row"
            " FROM masked",
            "masked",
        ),
        "audit_jsonl_sink": _with("SELECT value FROM lines", "lines"),
        "audit_jsonl_source": _with(
            """SELECT kind, outcome, statement_type, count(*) AS n_lines FROM (
 SELECT CASE WHEN doc IS NULL THEN 'reject' ELSE 'record' END AS kind,
  json_extract_string(doc, '$.outcome') AS outcome, json_extract_string(doc, '$.statement_type') AS statement_type
 FROM (SELECT TRY_CAST(value AS JSON) AS doc FROM bad_lines)) GROUP BY ALL""",
            "bad_lines",
        ),
        "request_source": _with(
            "SELECT request_no, content_type, strlen(body) AS body_bytes FROM requests", "requests"
        ),
        "orders_sink": _with(
            "SELECT customer_id, amount, '2026-01-02 03:04:05' AS created_at FROM accepted", "accepted"
        ),
        "masked_projection": _with("SELECT id, email, phone FROM masked", "masked"),
        "masked_alias": _with(
            "SELECT id, email AS contact, credit_card AS card, name AS phone FROM masked", "masked"
        ),
        "masked_wildcard": _with(masked, "masked"),
        "masked_duplicate_columns": _with(
            "SELECT CAST(to_json([email, email, CAST(id AS VARCHAR), phone]) AS VARCHAR) AS row FROM masked",
            "masked",
        ),
        "filter": _with(
            "SELECT m.id, m.email, m.phone FROM masked m JOIN contacts c USING (id)"
            " WHERE c.email LIKE 'a@%' OR c.phone = '77-31' OR c.id IN (7, 8, 9)",
            "masked",
        ),
        "zero_row_result": _with(masked + " WHERE id < 0", "masked"),
        "group_by_plain": _with(
            f"SELECT {_phone('phone')} AS phone FROM (SELECT DISTINCT phone FROM contacts)", "contacts"
        ),
        "group_by_having": _with(
            "SELECT customer_id FROM purchases GROUP BY customer_id HAVING count(*) > 12", "purchases"
        ),
        "distinct_rows": _with(
            f"SELECT {_card('credit_card')} AS credit_card FROM (SELECT DISTINCT credit_card FROM contacts)",
            "contacts",
        ),
        "masked_join": _with(
            f"SELECT o.id, c.email, c.phone, c.credit_card, o.amount FROM {_JOINED}", "masked", "purchases"
        ),
        "outer_join": _outer("FULL"),
        "outer_join_left": _outer("LEFT"),
        "outer_join_right": _outer("RIGHT"),
        "cross_join": _with(
            "SELECT c.name, c.email, o.amount FROM masked c, purchases o"
            " WHERE c.id = o.customer_id",
            "masked",
            "purchases",
        ),
        "mapping_lookup": _with(
            f"""SELECT statement_id, column_name, category,
 CASE WHEN category IS NULL THEN 'NotClassifiedAsPii' ELSE 'Pii' END AS data_class
FROM (SELECT statement_id, column_name, {_category("regexp_replace(column_name, '^.*[.]', '')", DEFAULTS)} AS category
 FROM (SELECT statement_id, unnest(projection_columns) AS column_name FROM facts))""",
            "facts",
        ),
        "fk_orphan_check": _with(
            "SELECT id, customer_id FROM candidates WHERE customer_id IS NOT NULL"
            " AND customer_id NOT IN (SELECT id FROM contacts)",
            "candidates",
            "contacts",
        ),
        "count_star": "SELECT count(*) AS email FROM customer",
        "count_star_multi": "SELECT count(*) AS count, count(*) AS phone, count(*) AS again FROM orders",
        "count_star_join": "SELECT count(*) AS count FROM customer JOIN orders ON c_custkey = o_custkey",
        "masked_order_by": _with("SELECT email, name FROM masked", "masked"),
        "masked_limit": _with(
            "SELECT m.id, m.email FROM masked m JOIN contacts c USING (id)"
            " ORDER BY c.email DESC NULLS LAST, c.id LIMIT 25",
            "masked",
        ),
        "refuse_computed": _with(_REFUSED + "has_computed", "attributed"),
        "refuse_count_mismatch": _with(
            _REFUSED + "NOT has_computed AND NOT has_wildcard AND NOT has_count_star"
            " AND len(projection_columns) > 0",
            "attributed",
        ),
        "refuse_mixed_wildcard": _with(
            "SELECT statement_id, reason FROM decided WHERE reason = 'UNATTRIBUTABLE_PROJECTION'", "decided"
        ),
        "refuse_unsupported_features": _with(
            "SELECT statement_id, reason, array_to_string(unsupported_features, ',') AS features FROM decided"
            " WHERE reason = 'UNSUPPORTED_SQL_FEATURE'",
            "decided",
        ),
        "refuse_count_variants": _with(
            _REFUSED_LISTS + "label IN ('count(1)', 'COUNT(NULL)', 'COUNT(email)', 'COUNT(DISTINCT email)')", "refusals"
        ),
        "refuse_window_projection": _with(_REFUSED_LISTS + "windowed", "refusals"),
        "refuse_value_aggregates": _with(
            _REFUSED_LISTS + "label[1:4] IN ('MIN(', 'MAX(', 'SUM(', 'AVG(')", "refusals"
        ),
        "refuse_mixed_count": _with(_REFUSED_LISTS + "paired AND (label IN ('email', '*') OR windowed)", "refusals"),
        "result_counts": "SELECT count(*) AS row_count, CAST(2 AS INTEGER) AS column_count"
        " FROM customer JOIN orders ON c_custkey = o_custkey",
        "affected_rows": _with("SELECT count(*) AS affected_rows FROM accepted", "accepted"),
        "pii_summary": _with("SELECT * FROM pii_counts", "pii_counts"),
        "audit_outcome_summary": _with(
            """SELECT kind, outcome, count(*) AS records FROM (
 SELECT CASE WHEN doc IS NULL THEN 'reject' ELSE 'record' END AS kind, json_extract_string(doc, '$.outcome') AS outcome
 FROM (SELECT TRY_CAST(value AS JSON) AS doc FROM (SELECT value FROM lines UNION ALL SELECT value FROM bad_lines)))
GROUP BY ALL""",
            "lines",
            "bad_lines",
        ),
        "null_check_customers": _with(
            "SELECT c.column_name, c.nulls FROM (SELECT unnest([{'column_name': 'id', 'nulls': count(*) - count(id)},"
            " {'column_name': 'name', 'nulls': count(*) - count(name)}]) AS c FROM contacts) WHERE c.nulls > 0",
            "contacts",
        ),
        "null_check_orders": _with(
            "SELECT c.column_name, c.nulls FROM (SELECT unnest([{'column_name': 'id', 'nulls': count(*) - count(id)},"
            " {'column_name': 'customer_id', 'nulls': count(*) - count(customer_id)},"
            " {'column_name': 'amount', 'nulls': count(*) - count(amount)}]) AS c FROM candidates) WHERE c.nulls > 0",
            "candidates",
        ),
        "mapping_collision_check": _with(
            "SELECT lower(column_name) AS mapping_key, count(*) AS entries FROM mapping_candidates"
            " GROUP BY 1 HAVING count(*) > 1",
            "mapping_candidates",
        ),
        "unique_check": _with(
            "SELECT email, count(*) AS occurrences FROM contacts"
            " GROUP BY email HAVING count(*) > 1 OR email IS NULL",
            "contacts",
        ),
        "unique_check_id": _with(
            "SELECT id, count(*) AS occurrences FROM contacts GROUP BY id HAVING count(*) > 1 OR id IS NULL",
            "contacts",
        ),
        "request_id_assign": "SELECT event_id, row_number() OVER (ORDER BY date_trunc('day', ts), event_id)"
        " AS request_id FROM events",
        "audit_order_check": f"""WITH r AS (SELECT position, {registry.DISORDERED_ID} AS request_id, t AS timestamp FROM (
 SELECT event_id AS position, event_id + 1 AS request_id,
  epoch_ms(ts) - CASE WHEN event_id % 83 = 0 THEN 86400000 ELSE 0 END AS t FROM events)),
p AS (SELECT *, lag(request_id) OVER (ORDER BY position) AS prev_request_id,
 lag(timestamp) OVER (ORDER BY position) AS prev_timestamp FROM r)
SELECT position, request_id, prev_request_id, 'REQUEST_ID_NOT_RISING' AS violation FROM p WHERE request_id <= prev_request_id
UNION ALL SELECT position, request_id, prev_request_id, 'TIME_FALLS' FROM p WHERE timestamp < prev_timestamp""",
        "trail_order_check": _with(
            f"""SELECT append, request_id, prev_request_id, unnest(list_filter([
  CASE WHEN request_id <= prev_request_id THEN 'REQUEST_ID_NOT_RISING' END,
  CASE WHEN t < prev_t THEN 'TIME_FALLS' END], lambda v: v IS NOT NULL)) AS violation FROM (
 SELECT *, lag(request_id) OVER w AS prev_request_id, lag(t) OVER w AS prev_t FROM (
  SELECT append, event_id + 1 AS request_id, epoch_ms(ts) AS t FROM events, (SELECT unnest([0, 1])::BIGINT AS append)
  WHERE {registry.LATE_APPEND.replace(":late", "append = 1").replace("request_id", "(event_id + 1)")})
 WINDOW w AS (ORDER BY append, request_id))
UNION ALL SELECT NULL, event_id + 1, NULL, 'DUPLICATE_REQUEST_ID' FROM events
 WHERE (event_id + 1) % 3 <> 0 AND (event_id + 1) % 53 = 0"""
        ),
        "dedupe_tables": _with(
            f"SELECT statement_id, {_norm(chr(39) * 2 + ' || CASE WHEN t1 = t2 THEN t1 ELSE concat(t1, ' + chr(39) + ',' + chr(39) + ', t2) END', chr(39) * 2)} AS tables FROM normalized",
            "normalized",
        ),
        "mask_email": _with("SELECT id, email AS masked FROM masked", "masked"),
        "mask_phone": _with("SELECT id, phone AS masked FROM masked", "masked"),
        "mask_credit_card": _with("SELECT id, credit_card AS masked FROM masked", "masked"),
        "never_unchanged_check": _with(
            " UNION ALL ".join(
                f"SELECT '{c}' AS column_name, count(*) AS checked, count(*) FILTER (c.{c} = m.{c}) AS unchanged"
                f" FROM contacts c JOIN masked m USING (id) WHERE c.{c} <> ''"
                for c in DEFAULTS
            ),
            "masked",
        ),
        "classify_positional": _with(_ALL_CLASSES + "classes WHERE attribution = 'POSITIONAL'", "classes"),
        "classify_wildcard": _with(_ALL_CLASSES + "classes WHERE attribution = 'WILDCARD'", "classes"),
        "classify_count_star": _with(_ALL_CLASSES + "classes WHERE attribution = 'COUNT_STAR'", "classes"),
        "classify_fail_closed": _with(_ALL_CLASSES + "classes WHERE attribution IS NULL", "classes"),
        "classify_custom_mapping": _with(_ALL_CLASSES + "custom_classes", "custom_classes"),
        "pii_catalog": _with(
            f"""SELECT column_name, neutral_type, occurrences, category,
 CASE WHEN category IS NULL THEN 'NotClassifiedAsPii' ELSE 'Pii' END AS data_class
FROM (SELECT column_name, neutral_type, count(*) AS occurrences, {_category('column_name', DEFAULTS)} AS category
 FROM result_types GROUP BY column_name, neutral_type)""",
            "result_types",
        ),
        "mask_preflight": _with("SELECT * FROM refused_statements", "refused_statements"),
        "mask_positional_rows": _with(
            f"""SELECT statement_id, row_no, CAST(to_json(CASE WHEN expected = 0 THEN [] ELSE
  list_transform(cells, lambda v, i: CASE cats[i] WHEN 'PII.Email' THEN {_email('v')}
   WHEN 'PII.Phone' THEN {_phone('v')} WHEN 'PII.CreditCard' THEN {_card('v')} ELSE v END) END) AS VARCHAR) AS cells
FROM text_rows r LEFT JOIN (SELECT statement_id, list(category ORDER BY ordinal) AS cats FROM classes GROUP BY 1) c
 USING (statement_id)
WHERE statement_id NOT IN (SELECT statement_id FROM refused_statements)""",
            "text_rows",
            "classes",
            "refused_statements",
        ),
        "mask_table": _with(
            f"""SELECT c.id, '***' AS name, {_email('c.email')} AS email, c.phone, c.credit_card,
 {_phone('CAST(o.amount AS VARCHAR)')} AS amount, strftime(o.created_at, '%Y-%m-%d %H:%M:%S') AS created_at
FROM contacts c JOIN purchases o ON c.id = o.customer_id""",
            "contacts",
            "purchases",
        ),
        "release_after_audit": _with(
            "SELECT *, (SELECT count(*) FROM masked) AS audited_rows,"
            " '2026-08-02T10:00:00.000Z' AS audited_at, CAST(1 AS BIGINT) AS audited_email_columns FROM masked",
            "masked",
        ),
        "normalize_facts": _with(
            f"""SELECT statement_id, CASE WHEN blank THEN 'EMPTY_INPUT' ELSE parsed_status END AS status,
 CASE WHEN NOT blank AND parsed_status = 'PARSE_ERROR' THEN CASE WHEN parse_success
   THEN 'parser returned success with no statements'
   WHEN parse_error = '' THEN 'parser reported failure' ELSE parse_error END END AS error_reason,
 CAST(CASE WHEN blank THEN 0 ELSE found END AS INTEGER) AS statement_count,
 {_norm('statement_type', "'UNKNOWN'")} AS statement_type,
 {_norm('has_wildcard', 'false')} AS has_wildcard_projection, 'NONE' AS insert_source,
 {_norm("CASE WHEN t1 = t2 THEN t1 ELSE concat(t1, ',', t2) END", "''")} AS tables,
 {_norm("'id,c.Email'", "''")} AS projection_columns FROM normalized""",
            "normalized",
        ),
        "policy_decision": _with(
            "SELECT statement_id, reason = 'NONE' AS allowed, reason FROM decided", "decided"
        ),
        "insert_shape_rule": _with(
            "SELECT statement_id, reason = 'NONE' AS allowed, reason, insert_source FROM decided"
            " WHERE statement_type = 'INSERT'",
            "decided",
        ),
        "request_outcome": _with(
            "SELECT statement_id, outcome, category, client_code, http_status FROM statused", "statused"
        ),
        "batch_outcome_report": _with(
            "SELECT outcome, reason, client_code, count(*) AS statements FROM coded GROUP BY ALL", "coded"
        ),
        "client_code_map": _with(
            "SELECT outcome, category, client_code, count(*) AS n FROM coded GROUP BY ALL", "coded"
        ),
        "http_status_map": _with(
            "SELECT client_code, http_status, count(*) AS n FROM statused GROUP BY ALL", "statused"
        ),
        "audit_build": _with("SELECT request_id, value FROM lines", "lines"),
        "audit_table_metadata": _with("SELECT statement_id, table_state FROM table_state", "table_state"),
        "audit_validate": _with(f"SELECT position, violation FROM ({lines})", "bad_lines"),
        "audit_leak_scan": _with(
            f"SELECT position, canary FROM leaky_lines JOIN (SELECT DISTINCT {registry.CANARY} AS canary"
            " FROM customer) ON contains(value, canary)",
            "leaky_lines",
        ),
        "audit_completeness": f"""SELECT request_id, requests, records FROM (
 SELECT event_id + 1 AS request_id, 1 AS requests FROM events) r
 JOIN (SELECT request_id AS rid, {registry.COPIES} AS records FROM (SELECT event_id + 1 AS request_id FROM events)) t
 ON rid = request_id WHERE records <> 1""",
        "order_batch_validate": _with(
            "SELECT id, row_status AS reason FROM order_checks WHERE row_status = 'UNSUPPORTED_INSERT_SHAPE'",
            "order_checks",
        ),
        "order_batch_types": _with("SELECT id, row_status AS status FROM order_checks", "order_checks"),
        "order_batch_fk": _with(
            "SELECT id, CASE WHEN row_status = 'OK' AND NOT known THEN 'EXECUTION_FAILURE' ELSE row_status END"
            " AS status FROM order_checks",
            "order_checks",
        ),
        "order_append": numbered,
        "request_triage": _with(
            "SELECT request_no, transport_code, CASE WHEN transport_code IS NULL THEN strlen(sql) END AS sql_bytes"
            " FROM triaged",
            "triaged",
        ),
        "request_exclude_malformed": _with(
            "SELECT request_no, md5(sql) AS sql_md5 FROM triaged WHERE transport_code IS NULL", "triaged"
        ),
        "stream_mask": _with(masked, "masked"),
        "stream_triage_policy": _with(
            "SELECT statement_id, reason = 'NONE' AS allowed, reason FROM decided"
            " WHERE statement_id IN (SELECT request_no FROM triaged WHERE transport_code IS NULL)",
            "decided",
            "triaged",
        ),
        "stream_release_after_audit": _with(masked, "masked"),
        "stream_audit_validate": _with(
            f"SELECT violation, count(*) AS n_lines FROM ({lines}) GROUP BY violation", "bad_lines"
        ),
    }
    return texts
