"""The corpus pipeline: language ID, near duplicates, decontamination, secrets, mixing.

Each stage is (spark, docs, sf_dir) -> DataFrame; its result is written and reread as the next one's docs.

Cases, for all stages: an empty table stays empty. Rows are told apart by id and text, null-safely, so rows without an id
and other texts under one id are documents of their own. Very long texts are handled whole. Columns of the documents whose
names a stage uses itself keep their place and content; only ``text`` and ``n_chars`` change, where secrets are replaced.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from privlytics.llm import decontaminate, jaccard_join, language_id, mixing, queries, secret_scan
from privlytics.llm.common import crc_mod, scratch_dir


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known well enough. Null and empty texts, and texts without a letter, have none and go."""
    model = language_id.fit(docs.select("doc_id", "text", "lang"), learn=crc_mod(F.col("doc_id"), 4) != 2)
    seen = language_id.predict(docs.select(*(F.col(c) for c in docs.columns)), model)
    return seen.filter(~F.col("rejected")).select(*docs.columns)


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the smallest id, null after all others.

    Rows are told apart by id and text, null-safely: other texts under one id, and rows without an id, are documents of their own.
    """
    keyed = docs.withColumn("_key", F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text"))
    found = jaccard_join.jaccard_components(keyed.select("_key", "text"), doc_id="_key").select(F.col("doc_id").alias("_key"), "component_id").distinct()
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key")
    first = found.join(keyed.select("_key", "doc_id").distinct(), "_key").groupBy("component_id").agg(F.min(order).alias("first")).select("first._key")
    return keyed.join(first, "_key", "left_semi").dropDuplicates(["_key"]).select(*docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs. Rows without words stay; an empty benchmark takes nothing."""
    return decontaminate.decontaminate(docs, queries.table(spark, sf_dir, "benchmark").select("item_id", "text")).select(*docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, repeated ones too, their secrets replaced. A null text stays null if it gets here."""
    found = secret_scan.join_secrets(docs, secret_scan.scan_secrets(docs))
    clean = found.withColumn("text", F.when(F.size("secrets") > 0, secret_scan.redact(F.col("text"), F.col("secrets"))).otherwise(F.col("text")))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are to be used at all, with their rates; equal rows have equal ones. Without labels all domains are alike."""
    labels = mixing.label_domains(queries.table(spark, sf_dir, "labels"))
    rates = mixing.mix_sources(docs.select("doc_id", "text"), labels, queries.TARGETS)
    return mixing.join_rates(docs, rates).filter("rate > 0").select(*docs.columns, "rate")


STAGES = [
    ("language_id", language_stage),
    ("near_duplicates", duplicates_stage),
    ("decontamination", benchmark_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
]
#: Trained models and iterations are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{scratch_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
