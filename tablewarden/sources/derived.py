"""Governance inputs derived from the base tables.

The base tables hold no contact columns, statement facts or raw requests, so
each is computed from a whole base table. The expressions are plain SQL scalars
that Spark and other engines read alike; ``plans.oracle`` uses them too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden import vocab
from tablewarden.functions.text import text_array
from tablewarden.operators.policy import RAW_STATEMENT_TYPE
from tablewarden.operators.projection import ENTRY_TYPE
from tablewarden.plans.lineage import as_table
from tablewarden.sources.tables import scan_table

CONTACTS = {
    "id": "c_custkey",
    "name": "c_name",
    "email": """CASE c_custkey % 11 WHEN 0 THEN 'mail at home' WHEN 1 THEN ''
        WHEN 2 THEN concat('a@', CAST(c_custkey AS STRING), '@example.com')
        WHEN 3 THEN concat('ñ', CAST(c_custkey AS STRING), '@example.com') WHEN 4 THEN NULL
        ELSE concat(lower(c_mktsegment), '.', CAST(c_custkey AS STRING), '@example.com') END""",
    "phone": """CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '77-31'
        WHEN 3 THEN concat('+1 (555) ', lpad(CAST(c_custkey AS STRING), 7, '0'))
        ELSE concat('05', lpad(CAST(c_custkey AS STRING), 8, '0')) END""",
    "credit_card": """CASE c_custkey % 5 WHEN 0 THEN NULL
        WHEN 1 THEN concat('6200-3040-5060-', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'))
        WHEN 2 THEN concat('90210007733', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'))
        WHEN 3 THEN '55y2040608010'
        ELSE concat('6200 3040 5060 ', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')) END""",
}

PURCHASES = {
    "id": "o_orderkey",
    "customer_id": "o_custkey",
    "amount": "CAST(o_totalprice AS DECIMAL(10,2))",
    "created_at": "o_orderdate",
}

# Flat statement facts; the *_csv columns become arrays.
FACTS = {
    "statement_id": "event_id",
    "status": """CASE WHEN event_id % 23 = 0 THEN 'EMPTY_INPUT' WHEN event_id % 23 = 1 THEN 'PARSE_ERROR'
        WHEN event_id % 23 = 2 THEN 'MULTIPLE_STATEMENTS' ELSE 'OK' END""",
    "statement_count": """CASE WHEN event_id % 23 < 2 THEN 0 WHEN event_id % 23 = 2 THEN 2 ELSE 1 END""",
    "statement_type": """CASE WHEN event_id % 23 < 3 THEN 'UNKNOWN' WHEN event_type = 'signup' THEN 'INSERT'
        WHEN event_type = 'error' THEN CASE event_id % 5 WHEN 0 THEN 'DROP' WHEN 1 THEN 'UPDATE'
         WHEN 2 THEN 'DELETE' WHEN 3 THEN 'CREATE' ELSE 'UNKNOWN' END ELSE 'SELECT' END""",
    "tables_csv": """CASE WHEN event_id % 23 < 3 THEN '' ELSE
        CASE user_id % 6 WHEN 0 THEN 'customers' WHEN 1 THEN 'orders' WHEN 2 THEN 'customers,orders'
        WHEN 3 THEN 'public.customers' WHEN 4 THEN 'PG_AUTHID'
        ELSE CASE event_id % 4 WHEN 0 THEN 'information_schema.tables' WHEN 1 THEN 'pgcustomers'
         WHEN 2 THEN 'public.pg_x,customers' ELSE 'a,b,c,d,e,f,g,h,i' END END END""",
    "projection_csv": """CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'id,c.Email'
        WHEN 2 THEN 'phone' ELSE 'id,amount' END""",
    "result_csv": """CASE WHEN event_id % 14 = 0 THEN '' WHEN event_id % 11 = 0 THEN 'id'
        WHEN event_id % 4 = 0 THEN 'id,EMAIL,phone,Credit_Card,note'
        WHEN event_id % 4 = 2 THEN 'contact' ELSE 'first,second' END""",
    "has_wildcard": "event_id % 3 = 0",
    "has_computed": "event_id % 7 = 0",
    "has_count_star": "event_id % 5 = 0",
    "has_group_by": "event_id % 25 = 0",
    "unsupported_csv": "CASE WHEN event_id % 10 = 0 THEN 'WITH/CTE' ELSE '' END",
    "insert_source": """CASE WHEN event_type = 'signup' THEN
        CASE WHEN event_id % 9 = 0 THEN 'SELECT' ELSE 'VALUES' END ELSE 'NONE' END""",
    "affected_csv": """CASE event_id % 8 WHEN 0 THEN 'amount,customer_id' WHEN 1 THEN 'customer_id'
        WHEN 2 THEN 'Customer_id,amount' ELSE 'customer_id,amount' END""",
    "kinds_csv": """CASE event_id % 7 WHEN 0 THEN 'UNSUPPORTED,POSITIVE_INTEGER_LITERAL'
        WHEN 1 THEN 'POSITIVE_INTEGER_LITERAL,NON_POSITIVE_NUMERIC_LITERAL'
        WHEN 2 THEN 'POSITIVE_INTEGER_LITERAL'
        WHEN 3 THEN 'POSITIVE_INTEGER_LITERAL,POSITIVE_INTEGER_LITERAL'
        ELSE 'POSITIVE_INTEGER_LITERAL,POSITIVE_DECIMAL_LITERAL' END""",
}

# Raw facts: the parts normalize_facts works on.
RAW_FACTS = {
    "statement_id": "event_id",
    "sql": """CASE event_id % 19 WHEN 0 THEN '' WHEN 1 THEN concat(' ', chr(9), chr(10), chr(13))
        WHEN 2 THEN concat(chr(160), ' ') ELSE concat('SELECT ', CAST(event_id AS STRING)) END""",
    "parse_success": "event_id % 13 <> 0",
    "parse_error": "CASE WHEN event_id % 2 = 0 THEN 'syntax error at position 7' ELSE '' END",
    "found": "CASE event_id % 17 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 1 END",
    "first_schema": "CASE WHEN event_id % 3 = 0 THEN 'public' ELSE '' END",
    "first_table": "CASE user_id % 3 WHEN 0 THEN 'customers' WHEN 1 THEN 'orders' ELSE 'items' END",
    "second_schema": "CASE WHEN event_id % 6 = 0 THEN 'public' ELSE '' END",
    "second_table": "CASE user_id % 2 WHEN 0 THEN 'customers' ELSE 'orders' END",
    "statement_type": "CASE WHEN event_type = 'signup' THEN 'INSERT' ELSE 'SELECT' END",
    "has_wildcard": "event_id % 3 = 0",
}

# One select-list entry per event, named by the kind of text it stands for.
ENTRY_LABELS = [
    "email",
    "*",
    "COUNT(*)",
    "count(1)",
    "COUNT(NULL)",
    "COUNT(email)",
    "COUNT(DISTINCT email)",
    "COUNT(*) OVER ()",
    "COUNT(*) + 1",
    "MIN(email)",
    "MAX(credit_card)",
    "SUM(amount)",
    "AVG(amount)",
    "ROW_NUMBER() OVER ()",
    "UPPER(email)",
    "1",
]

# What running an allowed statement reported.
EXECUTIONS = {
    "statement_id": "event_id",
    "exec_status": """CASE event_id % 29 WHEN 0 THEN 'CONNECTION_FAILURE' WHEN 1 THEN 'EXECUTION_FAILURE'
        ELSE 'OK' END""",
    "row_count": "CASE WHEN event_id % 97 = 5 THEN -1 ELSE event_id % 100 END",
    "affected_rows": "CASE event_id % 31 WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 2 THEN -1 ELSE 1 END",
}

CANDIDATES = {
    "id": "o_orderkey",
    "customer_id": """CASE o_orderkey % 13 WHEN 0 THEN -o_custkey-1 WHEN 1 THEN o_custkey+10000000
        WHEN 2 THEN NULL ELSE o_custkey END""",
    "amount": """CASE o_orderkey % 17 WHEN 0 THEN 0.0 WHEN 1 THEN -o_totalprice WHEN 2 THEN 0.001
        WHEN 3 THEN 100000000.0 ELSE o_totalprice END""",
}

REQUESTS = {
    "request_no": "event_id",
    "content_type": """CASE event_id % 11 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'Application/json'
        WHEN 2 THEN 'application/json; charset=utf-8' ELSE 'application/json' END""",
    "body": """CASE WHEN event_id % 499 = 7 THEN concat('{"sql":"', repeat('x', 65537), '"}')
        WHEN event_id % 499 = 8 THEN concat('{"sql":"', repeat('x', 65536), '"}')
        ELSE CASE event_id % 10 WHEN 0 THEN '{not json' WHEN 1 THEN '["SELECT 1"]'
         WHEN 2 THEN '{"query":"SELECT 1"}' WHEN 3 THEN '{"sql":42}' WHEN 4 THEN '{"sql":null}'
         WHEN 5 THEN '{"sql":""}' WHEN 6 THEN '{"sql":"SELECT 1"} rest'
         ELSE concat('{"note":{"sql":1},"sql":"SELECT ', CAST(event_id AS STRING), '"}') END END""",
}

# Column name -> category candidates, some of which collide without case.
MAPPING_CANDIDATES = {
    "column_name": """CASE WHEN p_partkey % 3 = 0 THEN upper(concat(p_name, CAST(p_partkey % 400 AS STRING)))
        ELSE concat(p_name, CAST(p_partkey % 900 AS STRING)) END""",
    "category": "CASE p_partkey % 3 WHEN 0 THEN 'PII.Email' WHEN 1 THEN 'PII.Phone' ELSE 'PII.CreditCard' END",
}


def derive(table: DataFrame, columns: dict[str, str]) -> DataFrame:
    return table.selectExpr(*[f"{expr} AS {name}" for name, expr in columns.items()])


def contacts(spark: SparkSession, sf: str) -> DataFrame:
    return as_table(derive(scan_table(spark, sf, "customer"), CONTACTS), "customers")


def purchases(spark: SparkSession, sf: str) -> DataFrame:
    return as_table(derive(scan_table(spark, sf, "orders"), PURCHASES), "orders")


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    return as_table(derive(scan_table(spark, sf, "orders"), CANDIDATES), "order_requests")


def mapping_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return derive(scan_table(spark, sf, "part"), MAPPING_CANDIDATES)


def facts_of(events: DataFrame) -> DataFrame:
    flat = derive(events, FACTS)
    arrays = {
        "tables_csv": "tables",
        "projection_csv": "projection_columns",
        "result_csv": "result_columns",
        "unsupported_csv": "unsupported_features",
        "affected_csv": "affected_columns",
        "kinds_csv": "insert_value_kinds",
    }
    flags = {
        "has_wildcard": "has_wildcard_projection",
        "has_computed": "has_computed_projection",
        "has_count_star": "has_safe_count_star_projection",
    }
    columns = []
    for name in flat.columns:
        if name in arrays:
            columns.append(text_array(F.col(name)).alias(arrays[name]))
        else:
            columns.append(F.col(name).alias(flags.get(name, name)))
    return flat.select(*columns)


def statement_facts(spark: SparkSession, sf: str) -> DataFrame:
    return facts_of(scan_table(spark, sf, "events"))


def raw_facts(spark: SparkSession, sf: str) -> DataFrame:
    flat = derive(scan_table(spark, sf, "events"), RAW_FACTS)

    def names(*values: str) -> F.Column:
        return F.array(*[F.lit(v) for v in values]).cast("array<string>")

    table = "struct<schema:string,name:string>"
    refs = F.array(
        F.struct("first_schema", "first_table").cast(table),
        F.struct("second_schema", "second_table").cast(table),
        F.struct("first_schema", "first_table").cast(table),
    )
    one = F.struct(
        F.col("statement_type"),
        refs,
        names("id", "c.Email"),
        F.col("has_wildcard"),
        F.lit(False),
        F.lit(False),
        F.lit(False),
        names(),
        F.lit(vocab.INSERT_NONE),
        names(),
        names(),
    ).cast(RAW_STATEMENT_TYPE)
    return flat.select(
        "statement_id",
        "sql",
        "parse_success",
        "parse_error",
        F.array_repeat(one, F.col("found")).alias("statements"),
    )


def projection_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Statements with one or two entries; the label says what the first one is."""
    events = scan_table(spark, sf, "events").select(
        F.col("event_id").alias("statement_id"),
        F.pmod("event_id", F.lit(len(ENTRY_LABELS))).alias("which"),
        (F.pmod(F.floor(F.col("event_id") / 16), F.lit(3)) == 0).alias("paired"),
    )

    def entry(kind, name=None, arguments=(), distinct=False, windowed=False):
        listed = F.array(*[F.lit(a) for a in arguments]).cast("array<string>")
        return F.struct(
            F.lit(kind), F.lit(name), listed, F.lit(distinct), F.lit(windowed)
        ).cast(ENTRY_TYPE)

    call = "FUNCTION"
    forms = [
        entry("COLUMN", "email"),
        entry("STAR"),
        entry(call, "COUNT", ["*"]),
        entry(call, "count", ["1"]),
        entry(call, "COUNT", ["NULL"]),
        entry(call, "COUNT", ["email"]),
        entry(call, "COUNT", ["email"], distinct=True),
        entry(call, "COUNT", ["*"], windowed=True),
        entry("OPERATOR", "+"),
        entry(call, "MIN", ["email"]),
        entry(call, "MAX", ["credit_card"]),
        entry(call, "SUM", ["amount"]),
        entry(call, "AVG", ["amount"]),
        entry(call, "ROW_NUMBER", windowed=True),
        entry(call, "UPPER", ["email"]),
        entry("LITERAL", "1"),
    ]
    first = F.element_at(F.array(*forms), F.col("which").cast("int") + 1)
    label = F.element_at(F.array(*[F.lit(x) for x in ENTRY_LABELS]), F.col("which").cast("int") + 1)
    return events.select(
        "statement_id",
        label.alias("label"),
        "paired",
        F.when(F.col("paired"), F.array(first, forms[2])).otherwise(F.array(first)).alias("entries"),
    )


def executions(spark: SparkSession, sf: str) -> DataFrame:
    return derive(scan_table(spark, sf, "events"), EXECUTIONS)


def requests(spark: SparkSession, sf: str) -> DataFrame:
    return derive(scan_table(spark, sf, "events"), REQUESTS)


def event_times(spark: SparkSession, sf: str) -> DataFrame:
    """Arrival time of every statement, in epoch milliseconds."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return scan_table(spark, sf, "events").select(
        F.col("event_id").alias("statement_id"),
        F.timestamp_diff("MILLISECOND", epoch, F.col("ts")).alias("timestamp_ms"),
    )
