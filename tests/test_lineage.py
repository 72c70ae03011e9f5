"""Columns are followed to tables; what cannot be is refused before a job starts."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tablewarden import vocab
from tablewarden.operators.classify import Mapping
from tablewarden.operators.projection import Col, CountStar, Star
from tablewarden.plans.guarded import guard, guarded_read
from tablewarden.plans.lineage import Origin, as_table, origins, tables_of
from tablewarden.refusals import MaskingRefused, PolicyRejected, QueryFailed


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(
        [(1, "uma", "uma@one.example", ("k@l.example", 3), ["x"])],
        "id int, name string, email string, contact struct<email:string, n:int>, tags array<string>",
    )


@pytest.fixture(scope="module")
def visits(spark):
    return spark.createDataFrame([(1, 7), (1, 8)], "person int, place int")


def nested(kind):
    value = {"array": "array(struct(email))", "map": "map('k', named_struct('Phone', name))"}[kind]
    return lambda p: as_table(p.select("id", F.expr(value).alias("things")), "t")


HIDDEN = {
    "renamed": (lambda p: p.withColumnRenamed("email", "note"), [Star()]),
    "renamed and picked": (lambda p: p.select("id", F.col("email").alias("note")), [Col("note")]),
    "renamed twice": (lambda p: p.toDF("id", "a", "b", "c", "d").withColumnRenamed("b", "z"), [Col("z")]),
    "computed under another name": (lambda p: p.select(F.upper("email").alias("name")), [Star()]),
    "computed under its own name": (lambda p: p.withColumn("name", F.concat("email", "name")), [Col("name")]),
    "cast": (lambda p: p.select(F.col("email").cast("binary").alias("note")), [Star()]),
    "struct under star": (lambda p: p.select("id", "contact"), [Star()]),
    "struct by name": (lambda p: p, [Col("contact")]),
    "struct under star of a table": (lambda p: p.alias("p"), [Star("p")]),
    "array of structs": (nested("array"), [Star()]),
    "map of structs": (nested("map"), [Col("things")]),
    "field of a struct": (lambda p: p.select(F.col("contact.email").alias("note")), [Star()]),
    "field beside a mapped struct": (lambda p: p.select(F.col("contact.n").alias("n")), [Star()]),
    "aggregate": (lambda p: p.groupBy("id").agg(F.max("email").alias("name")), [Star()]),
    "collected": (lambda p: p.groupBy("id").agg(F.collect_list("email").alias("names")), [Star()]),
    "grouping renamed": (lambda p: p.groupBy(F.col("email").alias("note")).agg(F.lit(1).alias("id")), [Col("note")]),
    "window": (lambda p: p.withColumn("name", F.first("email").over(Window.partitionBy("id"))), [Col("name")]),
    "generated": (lambda p: p.select("id", F.explode(F.array("email")).alias("name")), [Star()]),
    "second branch of a union": (lambda p: p.select("name").union(p.select("email")), [Star()]),
    "outer using join": (lambda p: p.select("id", "name").join(p.select("id", "email"), "id", "full"), [Col("id")]),
    "rows by code": (lambda p: p.select("id", "name").mapInArrow(lambda b: b, "id int, name string"), [Star()]),
    "constant": (lambda p: p.select(F.lit("x").alias("name")), [Star()]),
    "rollup": (lambda p: p.rollup("name").agg(F.lit(1).alias("one")), [Col("name")]),
    "pivot": (lambda p: p.groupBy("id").pivot("name", ["uma"]).agg(F.first("email")), [Star()]),
}


@pytest.mark.parametrize("name", HIDDEN)
def test_hidden_columns_are_refused_and_no_job_starts(spark, people, name):
    relation, spec = HIDDEN[name]
    mapping = Mapping([*vocab.DEFAULT_MAPPING, ("contact", vocab.PHONE)]) if "mapped" in name else None
    spark.sparkContext.setJobGroup("lineage", "none may start")
    with pytest.raises(MaskingRefused) as refused:
        guard(relation(people), spec, mapping)
    assert refused.value.reason == vocab.UNATTRIBUTED_COLUMN and refused.value.column_count > 0
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("lineage")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


OPEN = {
    "filter, sort, limit": lambda p, v: p.filter("email > ''").orderBy("name").limit(5).select("id", "email"),
    "alias of aliases": lambda p, v: p.alias("a").select("id", "email").alias("b"),
    "join": lambda p, v: p.join(v, p.id == v.person, "left").select("id", "email", "place"),
    "self join": lambda p, v: p.alias("a").join(p.alias("b"), F.col("a.id") == F.col("b.id")).select("a.email", "b.id"),
    "union by name": lambda p, v: p.select("email", "id").unionByName(p.select("id", "email")),
    "union with a gap": lambda p, v: p.select("email", "id").unionByName(p.select("id"), allowMissingColumns=True),
    "distinct": lambda p, v: p.select("email").distinct().dropDuplicates(["email"]),
    "grouping": lambda p, v: p.groupBy("email").count().select("email"),
    "semi join and set operations": lambda p, v: p.join(v, p.id == v.person, "semi").select("id", "email")
    .intersect(p.select("id", "email")).exceptAll(p.filter("id < 0").select("id", "email")),
    "harmless column renamed": lambda p, v: p.select("email", F.col("id").alias("person")),
    "harmless field": lambda p, v: p.select("email", "contact.n"),
    "unused computed column": lambda p, v: p.withColumn("extra", F.upper("email")).drop("extra").select("email"),
}


@pytest.mark.parametrize("name", OPEN)
def test_unchanged_columns_are_followed_and_masked(people, visits, name):
    got = guarded_read(OPEN[name](people, visits), [Star()])
    found = [r["email"] for r in got.collect()]
    assert found and set(found) <= {"u***@one.example", None} and "u***@one.example" in found


def test_only_selected_columns_count(people):
    wide = people.withColumn("more", F.upper("email"))
    assert guarded_read(wide, [Col("email")]).first()[0] == "u***@one.example"
    assert guarded_read(wide, [CountStar()]).first()[0] == 1
    with pytest.raises(MaskingRefused):
        guarded_read(wide, [Col("more")])
    assert guarded_read(wide, [Col("email")], group_by=["email", "more"]).first()[0] == "u***@one.example"


def test_a_declared_table_is_judged_by_its_names(people):
    made = as_table(people.select("id", F.lower("name").alias("email")), "made")
    again = made.join(made.withColumnRenamed("email", "other"), "id")
    assert guarded_read(made, [Star()]).first()["email"] == "***"
    assert origins(made) == [frozenset([Origin("made", ("id",))]), frozenset([Origin("made", ("email",))])]
    with pytest.raises(MaskingRefused):
        guard(again, [Col("other")])


def test_tables_come_from_the_plan(spark, people, visits, tmp_path):
    path = str(tmp_path / "stored.parquet")
    visits.write.parquet(path)
    stored = spark.read.parquet(path)
    both = as_table(people.drop("contact"), "people").join(stored, F.col("id") == F.col("person"))
    assert tables_of(both) == ["people", "stored"]
    assert guard(both, [Col("email")], tables=["view"]).tables == ["view", "people", "stored"]
    both.createOrReplaceTempView("lineage_view")
    stored.createOrReplaceTempView("lineage_stored")
    within = spark.sql("SELECT email FROM lineage_view WHERE id IN (SELECT person FROM lineage_stored)")
    assert tables_of(within) == ["people", "stored"]
    named = spark.sql("WITH x AS (SELECT id, email FROM lineage_view) SELECT a.email FROM x a JOIN x b ON a.id = b.id")
    assert guarded_read(named, [Star()]).first()[0] == "u***@one.example"
    with pytest.raises(MaskingRefused):
        guard(spark.sql("WITH x AS (SELECT email AS note FROM lineage_view) SELECT note FROM x"), [Star()])
    with pytest.raises(PolicyRejected):
        guard(as_table(visits, "pg_catalog.visits"), [Star()])


def test_names_of_two_columns_stay_ambiguous(people):
    twice = people.alias("a").join(people.alias("b"), F.col("a.id") == F.col("b.id"))
    with pytest.raises(QueryFailed):
        guard(twice, [Col("email")])
    assert guarded_read(twice, [Col("b.email")]).first()[0] == "u***@one.example"
