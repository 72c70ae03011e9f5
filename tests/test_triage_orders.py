"""Request triage and the validated append."""

import decimal

import pytest
from pyspark.sql import functions as F

from tablewarden.functions.json import is_json_object
from tablewarden.operators import orders
from tablewarden.operators.triage import accepted_requests, transport_rejects, triage
from tablewarden.session import scratch_root
from tablewarden.sources import commit_log
from tablewarden.sources.requests import read_requests, write_requests

JSON = "application/json"

# Request parts and the transport code they get.
REQUESTS = [
    ("text/plain", '{"sql":"SELECT 1"}', "invalid_content_type"),
    (None, '{"sql":"SELECT 1"}', "invalid_content_type"),
    ("Application/JSON", '{"sql":"SELECT 1"}', "invalid_content_type"),
    (JSON, "{not json", "invalid_json"),
    (JSON, '["SELECT 1"]', "invalid_json"),
    (JSON, '"SELECT 1"', "invalid_json"),
    (JSON, "", "invalid_json"),
    (JSON, None, "invalid_json"),
    (JSON, '{"sql":"a"} rest', "invalid_json"),
    (JSON, '{"sql":"a"}{"sql":"b"}', "invalid_json"),
    (JSON, '{"sql":"a"},{"sql":"b"}', "invalid_json"),
    (JSON, '{"sql":"a"}] x', "invalid_json"),
    (JSON, '{"sql":"a"}} x', "invalid_json"),
    (JSON, '{"sql":"a",}', "invalid_json"),
    (JSON, "{'sql':'a'}", "invalid_json"),
    (JSON, '{"query":"SELECT 1"}', "invalid_request"),
    (JSON, '{"sql":42}', "invalid_request"),
    (JSON, '{"sql":null}', "invalid_request"),
    (JSON, '{"sql":["a"]}', "invalid_request"),
    (JSON, '{"SQL":"a"}', "invalid_request"),
    (JSON, '{"sql":"' + "x" * 65537 + '"}', "sql_too_large"),
    (JSON, '{"sql":"' + "é" * 32769 + '"}', "sql_too_large"),
    (JSON, '{"sql":"' + "x" * 65536 + '"}', None),
    (JSON, '{"sql":""}', None),
    (JSON, ' {"x":1,"sql":"SELECT 1"} ', None),
    (JSON, '\ufeff{"sql":"SELECT 1"}', None),
    (JSON, '{\ufeff"sql":"SELECT 1"}', "invalid_json"),
    (JSON + "; charset=utf-8", '{"sql":"SELECT 1"}', None),
]


def test_triage(spark):
    rows = [(i, c, b) for i, (c, b, _) in enumerate(REQUESTS)]
    df = spark.createDataFrame(rows, "request_no bigint, content_type string, body string")
    done = triage(df)
    got = [r.transport_code for r in done.orderBy("request_no").collect()]
    assert got == [e for _, _, e in REQUESTS]
    assert transport_rejects(done).count() + accepted_requests(done).count() == len(REQUESTS)
    assert accepted_requests(done).filter("sql IS NULL").count() == 0


def test_last_of_equal_keys_counts(spark):
    df = spark.createDataFrame([(1, JSON, '{"sql":1,"sql":"b"}')], "request_no bigint, content_type string, body string")
    row = triage(df).first()
    assert (row.transport_code, row.sql) == (None, "b")


def test_strict_object(spark):
    cases = [("{}", True), (" {} ", True), ("{}]", False), ("[]", False), ("null", False), ("", False), (None, False)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(is_json_object(F.col("t"))).collect()] == [e for _, e in cases]


def test_request_log_round_trip(spark, tmp_path):
    path = str(tmp_path / "log")
    df = spark.createDataFrame([(1, JSON, '{"sql":"é\\n"}'), (2, None, None)], "request_no bigint, content_type string, body string")
    write_requests(df, path)
    assert sorted(read_requests(spark, path).collect()) == sorted(df.collect())


def test_orders_are_validated_and_appended(spark, tmp_path):
    customers = spark.createDataFrame([(1,), (2,)], "id bigint")
    rows = [
        (1, 1, 5.0, "OK"),
        (2, 1, 0.001, "OK"),
        (3, 2, 199.995, "OK"),
        (4, 0, 5.0, "UNSUPPORTED_INSERT_SHAPE"),
        (5, -1, 5.0, "UNSUPPORTED_INSERT_SHAPE"),
        (6, None, 5.0, "UNSUPPORTED_INSERT_SHAPE"),
        (7, 1, 0.0, "UNSUPPORTED_INSERT_SHAPE"),
        (8, 1, None, "UNSUPPORTED_INSERT_SHAPE"),
        (9, 1, 100000000.0, "EXECUTION_FAILURE"),
        (10, 99, 5.0, "EXECUTION_FAILURE"),
    ]
    batch = spark.createDataFrame([r[:3] for r in rows], "id bigint, customer_id bigint, amount double")
    checked = orders.validate_orders(batch, customers)
    assert {r.id: r.status for r in checked.collect()} == {r[0]: r[3] for r in rows}
    assert orders.order_rejects(checked).count() == 7
    path = str(tmp_path / "orders")
    existing = spark.createDataFrame([(41,)], "id bigint")
    assert orders.append_orders(checked, existing, path) == 3
    written = orders.read_orders(spark, path).orderBy("id").collect()
    assert [(r.id, r.customer_id, r.amount) for r in written] == [
        (42, 1, decimal.Decimal("5.00")),
        (43, 1, decimal.Decimal("0.00")),
        (44, 2, decimal.Decimal("200.00")),
    ]
    assert all(r.created_at is not None for r in written)


def test_text_candidates_must_be_numeric(spark):
    rows = [("1", "5.5", "OK"), ("1.5", "5", "UNSUPPORTED_INSERT_SHAPE"), ("x", "5", "UNSUPPORTED_INSERT_SHAPE"), ("1", "y", "UNSUPPORTED_INSERT_SHAPE")]
    rows += [("1", text, "UNSUPPORTED_INSERT_SHAPE") for text in ("NaN", "Infinity", "inf", "5d", "")]
    rows += [("1", "5e400", "EXECUTION_FAILURE"), ("1", "+5.", "OK"), ("1", "5e1", "OK")]
    df = spark.createDataFrame([r[:2] for r in rows], "customer_id string, amount string")
    got = orders.validate_shape_and_type(df)
    assert sorted((r.customer_id, r.amount, r.status) for r in got.collect()) == sorted(rows)


def batch_of(spark, *ids):
    return orders.validate_orders(
        spark.createDataFrame([(i, 1, 1.0 * i) for i in ids], "id bigint, customer_id bigint, amount double").repartition(3),
        spark.createDataFrame([(1,)], "id bigint"),
    )


def test_a_batch_that_runs_twice_is_there_once(spark, tmp_path):
    path, scratch = str(tmp_path / "orders"), f"{scratch_root(spark)}/tablewarden"
    before = set(commit_log.names(spark, scratch))
    existing = spark.createDataFrame([(100,)], "id bigint")
    nothing = existing.filter(F.raise_error(F.lit("the table is not read again")).isNull())
    assert orders.append_orders(batch_of(spark, 5, 3, 4), existing, path, batch="a") == 3
    assert orders.append_orders(batch_of(spark, 9), nothing, path, batch="b") == 1
    assert orders.append_orders(batch_of(spark, 4, 5, 3), nothing, path, batch="a") == 3
    assert orders.append_orders(batch_of(spark), nothing, path, batch="none") == 0
    assert orders.append_orders(batch_of(spark, 1), nothing, path, batch="c") == 1
    found = [(r.id, int(r.amount)) for r in orders.read_orders(spark, path).orderBy("id").collect()]
    assert found == [(101, 3), (102, 4), (103, 5), (104, 9), (105, 1)]
    with pytest.raises(ValueError, match="3 accepted rows"):
        orders.append_orders(batch_of(spark, 5, 3), nothing, path, batch="a")
    with pytest.raises(ValueError, match="batch name"):
        orders.append_orders(batch_of(spark, 5), nothing, path, batch="../a")
    left = set(commit_log.names(spark, scratch)) - before
    assert len([name for name in left if name.startswith("runs-")]) <= 2  # only those of the refused batches


@pytest.mark.parametrize("broken", ["create_once", "remove_folder"])
def test_a_crashed_batch_keeps_its_ids(spark, tmp_path, monkeypatch, broken):
    path, existing = str(tmp_path / "orders"), spark.createDataFrame([(7,)], "id bigint")
    real = getattr(orders, broken)

    def dying(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(orders, broken, dying)
    with pytest.raises(KeyboardInterrupt):
        orders.append_orders(batch_of(spark, 1, 2), existing, path, batch="a")
    monkeypatch.setattr(orders, broken, real)
    assert orders.append_orders(batch_of(spark, 1, 2), existing, path, batch="a") == 2
    assert [r.id for r in orders.read_orders(spark, path).orderBy("id").collect()] == [8, 9]
