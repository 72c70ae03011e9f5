"""A training corpus in stages, each over the whole table that the stage before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.llm import exact_dedup, jaccard_join, packing, quality, secrets
from tablewarden.llm.store import keep

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_QUALITY = 0.3


def _matching(docs: DataFrame, stays: DataFrame, digest: Column) -> DataFrame:
    """Rows of ``docs`` whose doc_id and digest of the text are among ``stays``; null ids are equal."""
    keys = stays.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_stays"))
    keyed = docs.select(*COLUMNS, digest.alias("_digest"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_stays"))
    return keyed.join(keys, same, "left_semi")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model, learned from the labels, does not reject."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs.select(COLUMNS), model, LEAST_QUALITY)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalized texts the one with the smallest doc_id stays."""
    groups = keep(exact_dedup.exact_groups(docs).withColumnRenamed("text_sha256", "digest"), "exact-groups")
    digest = F.sha2(exact_dedup.normalized(F.col("text")), 256)
    left = _matching(docs, groups.filter("kept"), digest)
    if not groups.groupBy("doc_id", "digest").count().filter("count > 1").isEmpty():
        left = left.dropDuplicates(["doc_id", "_digest"])  # rows that repeat a doc_id with its text
    return left.select(COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8 the one with the smallest doc_id stays.

    Documents without words are linked with nothing and stay.
    """
    found = keep(jaccard_join.similar_components(docs, n=5, percent=80), "near-components")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    first = found.groupBy("root").agg(F.min(order).alias("first")).select("root", "first.row")
    stays = found.join(first.withColumnRenamed("row", "_row"), "root").filter("row = _row")
    left = _matching(docs, stays.withColumnRenamed("text_md5", "digest"), F.md5(F.coalesce("text", F.lit(""))))
    return left.select(COLUMNS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret's span replaced by a mark."""
    model = secrets.fit(secrets.labelled_samples(spark, docs))
    changed = ~F.col("text").eqNullSafe(F.col("_before"))
    before = docs.select(COLUMNS).withColumn("_before", F.col("text"))
    clean = secrets.redacted(secrets.secret_spans(before, model))
    n_chars = F.when(changed, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", n_chars).select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 1024-token sequences."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.piece_digests(packing.pack_documents(docs, path, end_id=0))


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("secret scans", without_secrets),
    ("packing", packed),
]

# Learned scores and tokenizing are not expressible in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each one's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = keep(docs, "stage-" + name.replace(" ", "-"))
    return docs
