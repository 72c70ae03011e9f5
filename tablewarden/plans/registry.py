"""The registered queries: one per operator, each over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden import vocab
from tablewarden.functions.masks import mask_credit_card, mask_email, mask_phone
from tablewarden.functions.render import json_rows, render_text
from tablewarden.operators import audit, catalog, integrity, joins, orders, triage
from tablewarden.operators.classify import (
    Mapping,
    classify_bulk,
    explode_classes,
    lookup_in_table,
    mapping_collisions,
    with_pii_counts,
)
from tablewarden.operators.masking import mask_positional_rows, positional_refusals
from tablewarden.operators.policy import batch_outcome_report, normalize_facts, policy_decision
from tablewarden.operators.projection import (
    Col,
    CountStar,
    Star,
    is_aggregate,
    is_count_star,
    is_count_variant,
    is_windowed,
    reads_a_row,
    with_list_refusal,
)
from tablewarden.operators.sequence import assign_dense_ids
from tablewarden.operators.trail import audit_leak_join, trail_entries, trail_order
from tablewarden.plans.guarded import guard, guarded_read
from tablewarden.plans.lineage import as_table
from tablewarden.plans.release import release_after_audit
from tablewarden.plans.settle import audit_records, settle
from tablewarden.session import scratch_path, tune
from tablewarden.sources import derived, releases
from tablewarden.sources.requests import read_requests, write_requests
from tablewarden.sources.tables import scan_table, stream_table
from tablewarden.sources.trail import append_audit, append_lines, read_trail, stream_trail
from tablewarden.sources.trail_summary import outcome_summary
from tablewarden.streaming import jobs

# Defects put into audit lines, so the validator has something to find.
LINE_DEFECTS = """CASE request_id % 19
    WHEN 0 THEN concat('{bad ', value)
    WHEN 1 THEN concat('{"sql":"SELECT 1",', substr(value, 2))
    WHEN 2 THEN replace(value, '"outcome":"', '"outcome":"X')
    WHEN 3 THEN replace(value, 'Z"', '"')
    WHEN 4 THEN replace(value, '"request_id":', '"request_no":')
    WHEN 5 THEN replace(value, '"referenced_tables":["', '"referenced_tables":["a.')
    WHEN 6 THEN replace(value, '"statement_type":"SELECT"', '"statement_type":"SELEKT"')
    WHEN 7 THEN replace(value, '_omitted":true', '_omitted":"true"')
    WHEN 8 THEN concat(value, ' rest')
    ELSE value END"""

# Values of rows that leaked into some lines, by the hash of their key, and the hashes to look for.
LINE_LEAKS = """CASE WHEN request_id % 101 = 0
    THEN concat('{"note":"', md5(CAST(request_id % 2000 AS STRING)), '",', substr(value, 2)) ELSE value END"""
CANARY = "md5(CAST(c_custkey AS STRING))"

# Trail order and coverage defects.
DISORDERED_ID = "CASE WHEN request_id % 71 = 0 THEN request_id - 5 ELSE request_id END"
COPIES = "CASE WHEN request_id % 53 = 0 THEN 0 WHEN request_id % 59 = 0 THEN 2 ELSE 1 END"

# Which lines go into the first and the second append of a trail.
LATE_APPEND = "CASE WHEN :late THEN request_id % 3 = 0 OR request_id % 53 = 0 ELSE request_id % 3 <> 0 END"

CUSTOM_MAPPING = [("NAME", vocab.EMAIL), ("Amount", vocab.CREDIT_CARD), ("contact", vocab.PHONE)]


def _joined(spark: SparkSession, sf: str) -> DataFrame:
    c = derived.contacts(spark, sf).alias("c")
    o = derived.purchases(spark, sf).alias("o")
    return c.join(o, F.col("c.id") == F.col("o.customer_id"))


def _customers(spark: SparkSession, sf: str) -> DataFrame:
    return derived.contacts(spark, sf).alias("c")


# Sources and sinks


def q_scan_table(spark, sf):
    return scan_table(spark, sf, "customer")


def _result_types(spark: SparkSession, sf: str) -> DataFrame:
    """Result metadata of every statement: column names and database type numbers."""
    return (
        derived.statement_facts(spark, sf)
        .select("statement_id", "result_columns")
        .withColumn(
            "result_types",
            F.expr(
                "transform(result_columns, (name, i) -> named_struct('name', name, 'type_number', "
                "element_at(array(25, 1043, 20, 23, 700, 701, 1700, 16, 1114, 1184, 1082, 3802), "
                "CAST((statement_id + i) % 12 AS INT) + 1)))"
            ),
        )
    )


def q_column_catalog(spark, sf):
    return catalog.result_catalog(_result_types(spark, sf))


def q_render_text(spark, sf):
    table = derived.purchases(spark, sf).withColumn("large", F.col("amount") > 250000)
    return render_text(table)


def q_result_json_rows(spark, sf):
    return json_rows(guarded_read(_customers(spark, sf), [Star()]))


def _audit_records(spark: SparkSession, sf: str) -> DataFrame:
    settled = settle(derived.statement_facts(spark, sf), derived.executions(spark, sf))
    return audit_records(settled, derived.event_times(spark, sf))


def _lines(spark: SparkSession, sf: str, change: str = "value") -> DataFrame:
    lines = audit.audit_lines(_audit_records(spark, sf))
    return lines.select(F.col("request_id").alias("position"), F.expr(change).alias("value"))


def q_audit_jsonl_sink(spark, sf):
    path = scratch_path(spark, "trail")
    append_audit(_audit_records(spark, sf), path)
    return read_trail(spark, path).select("value")


def q_audit_jsonl_source(spark, sf):
    path = scratch_path(spark, "trail")
    _lines(spark, sf, LINE_DEFECTS).select("value").write.text(path)
    entries = trail_entries(read_trail(spark, path).select("value"))
    return entries.groupBy("kind", "outcome", "statement_type").agg(F.count("*").alias("n_lines"))


def q_request_source(spark, sf):
    path = scratch_path(spark, "requests")
    write_requests(derived.requests(spark, sf), path)
    return read_requests(spark, path).select(
        "request_no", "content_type", F.octet_length("body").cast("bigint").alias("body_bytes")
    )


def _appended_orders(spark: SparkSession, sf: str) -> tuple[int, str]:
    path = scratch_path(spark, "orders")
    validated = orders.validate_orders(derived.candidates(spark, sf), derived.contacts(spark, sf))
    moment = F.lit("2026-01-02 03:04:05").cast("timestamp_ntz")
    return orders.append_orders(validated, derived.purchases(spark, sf), path, moment, "first"), path


def q_orders_sink(spark, sf):
    _, path = _appended_orders(spark, sf)
    written = orders.read_orders(spark, path)
    return written.select("customer_id", "amount", F.col("created_at").cast("string"))


# Guarded reads


def q_masked_projection(spark, sf):
    return guarded_read(_customers(spark, sf), [Col("c.id"), Col("c.email"), Col("phone")])


def q_masked_alias(spark, sf):
    spec = [Col("id"), Col("email", "contact"), Col("c.credit_card", "card"), Col("name", "phone")]
    return guarded_read(_customers(spark, sf), spec)


def q_masked_wildcard(spark, sf):
    return guarded_read(_customers(spark, sf), [Star()])


def q_masked_duplicate_columns(spark, sf):
    twice = guarded_read(
        _customers(spark, sf), [Col("email"), Col("email"), Col("id"), Col("phone", "email")]
    )
    return json_rows(twice)


def q_filter(spark, sf):
    raw = _customers(spark, sf).filter(
        "c.email LIKE 'a@%' OR c.phone = '77-31' OR c.id IN (7, 8, 9)"
    )
    return guarded_read(raw, [Col("id"), Col("email"), Col("phone")])


def q_zero_row_result(spark, sf):
    return guarded_read(_customers(spark, sf).filter("id < 0"), [Star()])


def q_group_by_plain(spark, sf):
    return guarded_read(_customers(spark, sf), [Col("phone")], group_by=["phone"])


def q_group_by_having(spark, sf):
    return guarded_read(
        derived.purchases(spark, sf).alias("o"),
        [Col("o.customer_id")],
        group_by=["customer_id"],
        having=F.count("*") > 12,
    )


def q_distinct_rows(spark, sf):
    return guarded_read(_customers(spark, sf), [Col("credit_card")], distinct=True)


def q_masked_join(spark, sf):
    return guarded_read(
        _joined(spark, sf),
        [Col("o.id"), Col("c.email"), Col("c.phone"), Col("c.credit_card"), Col("o.amount")],
    )


def _outer(spark: SparkSession, sf: str, how: str) -> DataFrame:
    c = derived.contacts(spark, sf).select("id", "email", "phone").alias("c")
    o = (
        derived.candidates(spark, sf)
        .select(F.col("id").alias("order_id"), "customer_id")
        .alias("o")
    )
    joined = joins.outer_join(c, o, "id", "customer_id", how)
    spec = [Col("id"), Col("email"), Col("phone"), Col("order_id"), Col("customer_id")]
    return guarded_read(joined, spec)


def q_outer_join(spark, sf):
    return _outer(spark, sf, "full")


def q_outer_join_left(spark, sf):
    return _outer(spark, sf, "left")


def q_outer_join_right(spark, sf):
    return _outer(spark, sf, "right")


def q_cross_join(spark, sf):
    """A comma list with its key in WHERE; Catalyst plans it as an equi-join."""
    c = derived.contacts(spark, sf).alias("c")
    o = derived.purchases(spark, sf).alias("o")
    listed = c.join(o).where("c.id = o.customer_id")
    return guarded_read(listed, [Col("c.name"), Col("c.email"), Col("o.amount")])


def q_mapping_lookup(spark, sf):
    names = derived.statement_facts(spark, sf).select(
        "statement_id", F.explode_outer("projection_columns").alias("column_name")
    ).filter("column_name IS NOT NULL")
    return lookup_in_table(names, "column_name", catalog.mapping_table(spark))


def q_fk_orphan_check(spark, sf):
    return integrity.orphans(
        derived.candidates(spark, sf), "customer_id", derived.contacts(spark, sf), "id"
    ).select("id", "customer_id")


def q_count_star(spark, sf):
    return guarded_read(_customers(spark, sf), [CountStar("email")])


def q_count_star_multi(spark, sf):
    return guarded_read(
        derived.purchases(spark, sf), [CountStar(), CountStar("phone"), CountStar("again")]
    )


def q_count_star_join(spark, sf):
    return joins.count_matches(
        derived.contacts(spark, sf), derived.purchases(spark, sf), "id", "customer_id"
    )


def q_masked_order_by(spark, sf):
    return guarded_read(
        _customers(spark, sf), [Col("email"), Col("name")], order_by=[F.desc("email"), "id"]
    )


def q_masked_limit(spark, sf):
    """The report itself is a top-k: the 25 last addresses in raw order."""
    return guarded_read(
        _customers(spark, sf),
        [Col("id"), Col("email")],
        order_by=[F.desc_nulls_last("email"), "id"],
        limit=25,
    )


# Refusals in bulk


def _classified(spark: SparkSession, sf: str) -> DataFrame:
    return classify_bulk(policy_decision(derived.statement_facts(spark, sf)))


def _refused(classified: DataFrame, condition: Column | str) -> DataFrame:
    return (
        classified.filter("allowed AND statement_type = 'SELECT'")
        .filter(condition)
        .filter(~F.col("fully_attributed"))
        .select("statement_id", F.lit(vocab.UNATTRIBUTED_COLUMN).alias("masking_failure"))
    )


def q_refuse_computed(spark, sf):
    return _refused(_classified(spark, sf), "has_computed_projection")


def q_refuse_count_mismatch(spark, sf):
    return _refused(
        _classified(spark, sf),
        "NOT has_computed_projection AND NOT has_wildcard_projection"
        " AND NOT has_safe_count_star_projection AND size(projection_columns) > 0",
    )


def q_refuse_mixed_wildcard(spark, sf):
    return (
        policy_decision(derived.statement_facts(spark, sf))
        .filter(F.col("reason") == vocab.REASON_UNATTRIBUTABLE)
        .select("statement_id", "reason")
    )


def q_refuse_unsupported_features(spark, sf):
    return (
        policy_decision(derived.statement_facts(spark, sf))
        .filter(F.col("reason") == vocab.REASON_UNSUPPORTED_FEATURE)
        .select("statement_id", "reason", F.array_join("unsupported_features", ",").alias("features"))
    )


def _refused_lists(spark: SparkSession, sf: str, *kinds) -> DataFrame:
    """Refused select lists that have an entry of each kind; every seventh statement is grouped."""
    lists = derived.projection_entries(spark, sf).select(
        "statement_id", "entries", (F.col("statement_id") % 7 == 0).alias("has_group_by")
    )
    for kind in kinds:
        lists = lists.filter(F.exists("entries", kind))
    judged = with_list_refusal(lists)
    return judged.filter("refusal IS NOT NULL").select("statement_id", "has_group_by", "refusal")


def q_refuse_count_variants(spark, sf):
    return _refused_lists(spark, sf, is_count_variant)


def q_refuse_window_projection(spark, sf):
    return _refused_lists(spark, sf, is_windowed)


def q_refuse_value_aggregates(spark, sf):
    return _refused_lists(spark, sf, lambda e: is_aggregate(e, ["min", "max", "sum", "avg"]))


def q_refuse_mixed_count(spark, sf):
    return _refused_lists(spark, sf, is_count_star, reads_a_row)


# Aggregates of governance


def q_result_counts(spark, sf):
    entry = releases.stage(
        guarded_read(_joined(spark, sf), [Col("c.email"), Col("o.amount")]),
        scratch_path(spark, "store"),
        "counts",
    )
    return spark.createDataFrame(
        [(entry["row_count"], entry["column_count"])], "row_count bigint, column_count int"
    )


def q_affected_rows(spark, sf):
    rows, _ = _appended_orders(spark, sf)
    return spark.createDataFrame([(rows,)], "affected_rows bigint")


def q_pii_summary(spark, sf):
    return with_pii_counts(_classified(spark, sf)).select(
        "statement_id", "pii_email_columns", "pii_phone_columns", "pii_credit_card_columns"
    )


def q_audit_outcome_summary(spark, sf):
    """A trail with broken lines that grows: the second summary reads the second append only."""
    path = scratch_path(spark, "trail")
    append_audit(_audit_records(spark, sf).filter("request_id % 2 = 0"), path)
    outcome_summary(spark, path)
    append_audit(_audit_records(spark, sf).filter("request_id % 2 = 1"), path)
    broken = _lines(spark, sf, LINE_DEFECTS).select("value")
    append_lines(broken, path)
    return outcome_summary(spark, path)


def q_null_check_customers(spark, sf):
    return integrity.null_violations(derived.contacts(spark, sf), ["id", "name"])


def q_null_check_orders(spark, sf):
    return integrity.null_violations(derived.candidates(spark, sf), ["id", "customer_id", "amount"])


def q_mapping_collision_check(spark, sf):
    return mapping_collisions(derived.mapping_candidates(spark, sf))


def q_unique_check(spark, sf):
    return integrity.unique_violations(derived.contacts(spark, sf), ["email"])


def q_unique_check_id(spark, sf):
    return integrity.unique_violations(derived.contacts(spark, sf), ["id"])


def q_request_id_assign(spark, sf):
    arrivals = scan_table(spark, sf, "events").select(
        F.date_trunc("day", F.col("ts")).cast("timestamp_ntz").alias("arrived"),
        F.col("event_id"),
    )
    return assign_dense_ids(arrivals, ["arrived", "event_id"], "request_id").select(
        "event_id", "request_id"
    )


def q_audit_order_check(spark, sf):
    times = derived.event_times(spark, sf)
    records = times.select(
        F.col("statement_id").alias("position"),
        (F.col("statement_id") + 1).alias("request_id"),
        F.when(F.col("statement_id") % 83 == 0, F.col("timestamp_ms") - 86400000)
        .otherwise(F.col("timestamp_ms"))
        .alias("timestamp"),
    ).withColumn("request_id", F.expr(DISORDERED_ID))
    return audit.audit_order_check(records)


def q_trail_order_check(spark, sf):
    """Two appends whose ids interleave, with some lines in both."""
    path, records = scratch_path(spark, "trail"), _audit_records(spark, sf)
    append_audit(records.filter(LATE_APPEND.replace(":late", "false")), path)
    append_audit(records.filter(LATE_APPEND.replace(":late", "true")), path)
    return trail_order(read_trail(spark, path)).select("append", "request_id", "prev_request_id", "violation")


def q_dedupe_tables(spark, sf):
    return normalize_facts(derived.raw_facts(spark, sf)).select(
        "statement_id", F.array_join("tables", ",").alias("tables")
    )


# Scalar rules


def _mask_column(spark, sf, name: str, rule) -> DataFrame:
    return derived.contacts(spark, sf).select("id", rule(F.col(name)).alias("masked"))


def q_mask_email(spark, sf):
    return _mask_column(spark, sf, "email", mask_email)


def q_mask_phone(spark, sf):
    return _mask_column(spark, sf, "phone", mask_phone)


def q_mask_credit_card(spark, sf):
    return _mask_column(spark, sf, "credit_card", mask_credit_card)


def q_never_unchanged_check(spark, sf):
    return integrity.never_unchanged(derived.contacts(spark, sf))


# Classification, masking, release


def _classes_by(spark, sf, mode: str | None, mapping: Mapping | None = None) -> DataFrame:
    classified = classify_bulk(derived.statement_facts(spark, sf), mapping)
    wanted = F.col("attribution").isNull() if mode is None else F.col("attribution") == mode
    return explode_classes(classified.filter(wanted))


def q_classify_positional(spark, sf):
    return _classes_by(spark, sf, "POSITIONAL")


def q_classify_wildcard(spark, sf):
    return _classes_by(spark, sf, "WILDCARD")


def q_classify_count_star(spark, sf):
    return _classes_by(spark, sf, "COUNT_STAR")


def q_classify_fail_closed(spark, sf):
    return _classes_by(spark, sf, None)


def q_classify_custom_mapping(spark, sf):
    classified = classify_bulk(derived.statement_facts(spark, sf), Mapping(CUSTOM_MAPPING))
    return explode_classes(classified)


def q_pii_catalog(spark, sf):
    columns = catalog.result_catalog(_result_types(spark, sf))
    return catalog.pii_catalog(columns, catalog.mapping_table(spark))


def _positional_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One to three text rows per statement; every 37th statement has a wide row."""
    facts = derived.statement_facts(spark, sf).select("statement_id", "result_columns")
    rows = facts.select(
        "statement_id",
        "result_columns",
        F.explode(F.sequence(F.lit(1), (F.col("statement_id") % 3 + 1).cast("int"))).alias("row_no"),
    )
    wide = (F.col("statement_id") % 37 == 0) & (F.col("row_no") == 1)
    width = F.array_size("result_columns") + F.when(wide, 1).otherwise(0)

    def cell(j: Column) -> Column:
        text = F.col("statement_id").cast("string")
        return (
            F.when(j % 4 == 1, F.concat(F.lit("user"), text, F.lit("@example.com")))
            .when(j % 4 == 2, F.concat(F.lit("05"), F.lpad(text, 8, "0")))
            .when(j % 4 == 3, F.lit("6200 3040 5060 7080"))
        )

    cells = F.when(width > 0, F.transform(F.sequence(F.lit(1), width), cell)).otherwise(
        F.array().cast("array<string>")
    )
    return rows.select("statement_id", "row_no", cells.alias("cells"))


def q_mask_preflight(spark, sf):
    classified = classify_bulk(derived.statement_facts(spark, sf))
    return positional_refusals(_positional_rows(spark, sf), classified)


def q_mask_positional_rows(spark, sf):
    classified = classify_bulk(derived.statement_facts(spark, sf))
    masked = mask_positional_rows(_positional_rows(spark, sf), classified)
    return masked.select("statement_id", "row_no", F.to_json("cells").alias("cells"))


def q_mask_table(spark, sf):
    return guarded_read(
        _joined(spark, sf).select("c.*", F.col("o.amount"), F.col("o.created_at")),
        [Star()],
        Mapping([("EMAIL", vocab.EMAIL), ("amount", vocab.PHONE), ("Name", "PII.Other")]),
    ).withColumn("created_at", F.col("created_at").cast("string"))


def q_release_after_audit(spark, sf):
    store, trail = scratch_path(spark, "store"), scratch_path(spark, "trail")
    result = guard(_customers(spark, sf), [Star()], tables=["customers"])
    release_after_audit(
        result, store, trail, release_id="customers", request_id=1, timestamp_ms=1785664800000
    )
    record = audit.parse_trail(read_trail(spark, trail).select("value")).select(
        F.col("row_count").alias("audited_rows"),
        F.col("timestamp").alias("audited_at"),
        F.col("pii_email_columns").alias("audited_email_columns"),
    )
    # Exactly one record: a bounded row joined to every released row.
    audited = record.first()
    return releases.read_release(spark, store, "customers").select(
        "*", *[F.lit(v).alias(k) for k, v in audited.asDict().items()]
    )


# Policy and outcomes


def q_normalize_facts(spark, sf):
    facts = normalize_facts(derived.raw_facts(spark, sf))
    return facts.select(
        "statement_id",
        "status",
        "error_reason",
        "statement_count",
        "statement_type",
        "has_wildcard_projection",
        "insert_source",
        F.array_join("tables", ",").alias("tables"),
        F.array_join("projection_columns", ",").alias("projection_columns"),
    )


def q_policy_decision(spark, sf):
    return policy_decision(derived.statement_facts(spark, sf)).select(
        "statement_id", "allowed", "reason"
    )


def q_insert_shape_rule(spark, sf):
    return (
        policy_decision(derived.statement_facts(spark, sf))
        .filter("statement_type = 'INSERT'")
        .select("statement_id", "allowed", "reason", "insert_source")
    )


def _settled(spark: SparkSession, sf: str) -> DataFrame:
    return settle(derived.statement_facts(spark, sf), derived.executions(spark, sf))


def q_request_outcome(spark, sf):
    return _settled(spark, sf).select(
        "statement_id", "outcome", "category", "client_code", "http_status"
    )


def q_batch_outcome_report(spark, sf):
    return batch_outcome_report(_settled(spark, sf))


def q_client_code_map(spark, sf):
    return _settled(spark, sf).groupBy("outcome", "category", "client_code").agg(
        F.count("*").alias("n")
    )


def q_http_status_map(spark, sf):
    return _settled(spark, sf).groupBy("client_code", "http_status").agg(F.count("*").alias("n"))


# Audit


def q_audit_build(spark, sf):
    return audit.audit_lines(_audit_records(spark, sf))


def q_audit_table_metadata(spark, sf):
    return derived.statement_facts(spark, sf).select(
        "statement_id", audit.table_metadata_state(F.col("tables")).alias("table_state")
    )


def q_audit_validate(spark, sf):
    return audit.audit_validate(_lines(spark, sf, LINE_DEFECTS))


def q_audit_leak_scan(spark, sf):
    canaries = scan_table(spark, sf, "customer").select(F.expr(CANARY).alias("canary"))
    return audit_leak_join(_lines(spark, sf, LINE_LEAKS), canaries)


def q_audit_completeness(spark, sf):
    ids = scan_table(spark, sf, "events").select((F.col("event_id") + 1).alias("request_id"))
    trail = ids.select(
        F.explode(F.array_repeat(F.col("request_id"), F.expr(COPIES))).alias("request_id")
    )
    return audit.audit_completeness(ids, trail)


# Validated append


def q_order_batch_validate(spark, sf):
    checked = derived.candidates(spark, sf).select("id", orders.shape_reason().alias("reason"))
    return checked.filter("reason IS NOT NULL")


def q_order_batch_types(spark, sf):
    return orders.validate_shape_and_type(derived.candidates(spark, sf)).select("id", "status")


def q_order_batch_fk(spark, sf):
    validated = orders.validate_orders(derived.candidates(spark, sf), derived.contacts(spark, sf))
    return validated.select("id", "status")


def q_order_append(spark, sf):
    _, path = _appended_orders(spark, sf)
    return orders.read_orders(spark, path).select("id", "customer_id", "amount")


# Triage


def q_request_triage(spark, sf):
    return triage.triage(derived.requests(spark, sf)).select(
        "request_no", "transport_code", F.octet_length("sql").cast("bigint").alias("sql_bytes")
    )


def q_request_exclude_malformed(spark, sf):
    accepted = triage.accepted_requests(triage.triage(derived.requests(spark, sf)))
    return accepted.select("request_no", F.md5("sql").alias("sql_md5"))


# Streams


def q_stream_mask(spark, sf):
    path, checkpoint = scratch_path(spark, "out"), scratch_path(spark, "checkpoint")
    stream = as_table(derived.derive(stream_table(spark, sf, "customer"), derived.CONTACTS), "customers")
    jobs.stream_mask(stream, [Star()], path, checkpoint).awaitTermination()
    return spark.read.parquet(path)


def q_stream_triage_policy(spark, sf):
    """Requests and facts of one arrival stream: triage, then decide the accepted ones."""
    path, checkpoint = scratch_path(spark, "out"), scratch_path(spark, "checkpoint")
    events = stream_table(spark, sf, "events")
    with_request = events.select("*", *[F.expr(e).alias(n) for n, e in derived.REQUESTS.items()])
    accepted = triage.accepted_requests(triage.triage(with_request))
    jobs.stream_policy(derived.facts_of(accepted), path, checkpoint).awaitTermination()
    return spark.read.parquet(path).select("statement_id", "allowed", "reason")


def q_stream_release_after_audit(spark, sf):
    store, trail = scratch_path(spark, "store"), scratch_path(spark, "trail")
    stream = as_table(derived.derive(stream_table(spark, sf, "customer"), derived.CONTACTS), "customers")

    jobs.stream_release_after_audit(
        stream, [Star()], store, trail, scratch_path(spark, "checkpoint"), timestamp_ms=lambda _: 1785664800000
    ).awaitTermination()
    return releases.read_all(spark, store)


def q_stream_audit_validate(spark, sf):
    trail, path = scratch_path(spark, "trail"), scratch_path(spark, "out")
    _lines(spark, sf, LINE_DEFECTS).select("value").write.text(trail)
    jobs.stream_audit_validate(
        stream_trail(spark, trail), path, scratch_path(spark, "checkpoint")
    ).awaitTermination()
    return (
        spark.read.parquet(path).groupBy("violation").agg(F.count("*").alias("n_lines"))
    )


def registered() -> dict:
    """Every ``q_`` function above, on a session with the runtime settings set."""

    def bind(run):
        return lambda spark, sf: run(tune(spark), sf)

    return {
        name.removeprefix("q_"): bind(run)
        for name, run in globals().items()
        if name.startswith("q_")
    }
