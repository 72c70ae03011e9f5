"""The physical plans the jobs are meant to have."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablewarden.operators import joins
from tablewarden.operators.classify import classify_bulk
from tablewarden.operators.masking import mask_positional_rows
from tablewarden.operators.orders import validate_orders
from tablewarden.operators.policy import policy_decision
from tablewarden.operators.projection import Col, Star
from tablewarden.operators.triage import accepted_requests, triage
from tablewarden.plans.lineage import as_table
from tablewarden.plans.guarded import guarded_read
from tablewarden.sources import derived
from tablewarden.sources.tables import scan_table


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_narrow_jobs_do_not_shuffle(spark, sf):
    facts = derived.statement_facts(spark, sf)
    for df in (
        guarded_read(derived.contacts(spark, sf), [Star()]),
        policy_decision(facts),
        classify_bulk(facts),
        triage(derived.requests(spark, sf)),
    ):
        assert "Exchange" not in plan_of(df)


def test_filters_and_columns_reach_the_scan(spark, sf):
    customers = scan_table(spark, sf, "customer").withColumnRenamed("c_name", "email")
    masked = guarded_read(customers.filter("c_custkey > 5"), [Star()]).select("email")
    plan = plan_of(masked)
    assert "PushedFilters: [IsNotNull(c_custkey), GreaterThan(c_custkey,5)]" in plan
    assert re.search(r"ReadSchema: struct<c_custkey:bigint,c_name:string>", plan)
    # An unused mask costs nothing: its column is not even read.
    unused = guarded_read(customers, [Star()]).select("c_acctbal")
    assert "ReadSchema: struct<c_acctbal:double>" in plan_of(unused)


def test_top_k_is_one_operator(spark, sf):
    df = guarded_read(derived.contacts(spark, sf), [Col("email")], order_by=["email", "id"], limit=5)
    assert "TakeOrderedAndProject" in plan_of(df)


def test_comma_list_with_a_key_is_an_equi_join(spark, sf):
    c, o = derived.contacts(spark, sf).alias("c"), derived.purchases(spark, sf).alias("o")
    plan = plan_of(c.join(o).where("c.id = o.customer_id"))
    assert "HashJoin" in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_filtering_accepted_requests_does_not_parse_again(spark, sf):
    accepted = accepted_requests(triage(derived.requests(spark, sf)))
    text = accepted._jdf.queryExecution().optimizedPlan().toString()
    # A text is parsed boxed and listed, once each, and not again by the filter above.
    assert len(re.findall(r"(?i)parsejson|parse_json", text)) <= 2
    assert text.index("Filter") < text.index("Generate")


@pytest.fixture()
def small_skew_limits(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def hot_orders(spark, rows=30000):
    """A third of all rows belong to customer 7."""
    ids = spark.range(0, rows, 1, 8)
    customer = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 500)
    return ids.select(
        F.col("id").alias("order_id"),
        customer.cast("bigint").alias("customer_id"),
        F.sha2(F.col("id").cast("string"), 256).alias("payload"),
    )


def split_joins(df) -> int:
    df.collect()
    return plan_of(df).count("skew=true")


def largest_share(df) -> float:
    """Share of the rows in the fullest task; one hot key per task would be over one half."""
    tasks = Counter(r["_task"] for r in df.withColumn("_task", F.spark_partition_id()).collect())
    return max(tasks.values()) / sum(tasks.values())


def test_hot_keys_are_split(spark, small_skew_limits):
    customers = as_table(spark.range(500).select("id", F.lit("k@l.example").alias("email")), "customers")
    orders = as_table(hot_orders(spark), "orders")
    inner = guarded_read(
        customers.join(orders, F.col("id") == F.col("customer_id")), [Col("email"), Col("payload")]
    )
    assert split_joins(inner) == 1 and inner.count() == 30000
    left = joins.outer_join(customers, orders, "id", "customer_id", "left")
    assert largest_share(left) < 0.4 and left.count() == 30000
    full = joins.outer_join(customers, orders, "id", "customer_id", "full")
    assert largest_share(full) < 0.4 and full.count() == 30000
    nobody = customers.filter("id <> 7")
    right = joins.outer_join(nobody, orders, "id", "customer_id", "right")
    assert largest_share(right) < 0.4 and right.count() == 30000
    batch = orders.select(
        F.col("order_id").alias("id"), "customer_id", F.lit(1.0).alias("amount"), "payload"
    )
    checked = validate_orders(batch, customers)
    assert largest_share(checked) < 0.4
    assert checked.filter("status = 'OK'").count() == 30000 - batch.filter("customer_id = 0").count()


def test_a_hot_statement_is_split(spark, small_skew_limits):
    names = F.array(F.lit("email"))
    facts = spark.range(200).select(
        F.col("id").alias("statement_id"),
        F.lit("OK").alias("status"),
        F.lit("SELECT").alias("statement_type"),
        names.alias("projection_columns"),
        names.alias("result_columns"),
        *[
            F.lit(False).alias(f"has_{n}")
            for n in (
                "wildcard_projection",
                "computed_projection",
                "safe_count_star_projection",
                "group_by",
            )
        ],
    )
    rows = hot_orders(spark).select(
        (F.col("customer_id") % 200).alias("statement_id"),
        F.col("order_id").alias("row_no"),
        F.array(F.concat("payload", F.lit("@example.com"))).alias("cells"),
    )
    masked = mask_positional_rows(rows, classify_bulk(facts))
    assert largest_share(masked) < 0.4 and masked.count() == 30000
    assert masked.filter("cells[0] NOT LIKE '_***@example.com'").count() == 0


def test_scratch_needs_a_shared_folder_off_the_driver():
    from tablewarden.session import local_scratch

    assert local_scratch("local") and local_scratch("local[4]")
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://host"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            local_scratch(master)
