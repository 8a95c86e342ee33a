"""The corpus pipeline: documents to a training mix, stage by stage.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and gives the documents that go on, with the
columns of documents, the last one's with its place in the mix besides. ``run`` applies them in order, each stage's
result written as Parquet to the shared folder and read again.

1. quality_classifier: documents that the factorisation machine, fitted on ``labels.quality``, scores under 0.5 go.
2. near_duplicates: five-word shingles, similarity 0.8 or more; the smallest doc_id of each component stays.
3. decontamination: documents that hold a ten-word window of a benchmark item go.
4. secret_scan: every secret in a text becomes [SECRET]; n_chars follows the text.
5. source_mixing: every document gets its slot in a schedule by source weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.llm import decontaminate, mixing, neardup, quality, secrets
from lorebase.llm.common import stored


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.dedup(docs, shingle=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("source_mixing", source_mixing),
]

#: SQL expresses neither the fitted classifier nor the schedule; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
