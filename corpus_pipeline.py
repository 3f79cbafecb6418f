"""The corpus pipeline: each stage works on all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written and read again before the next. All but the last return the columns of
``documents``; rows that leave are gone for the later stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm.common import materialize, table
from factorloom.llm.mixing import mixed_documents
from factorloom.llm.near_dedup import near_duplicates
from factorloom.llm.packing import pack_documents
from factorloom.llm.quality_rules import quality_rules, trusted_ids
from factorloom.llm.secrets import redact_secrets


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that pass the quality rules; null and empty texts fail."""
    judged = quality_rules(docs.withColumnRenamed("quality", "__quality"), trusted_ids(spark, sf_dir))
    return judged.where("quality.kept").drop("quality").withColumnRenamed("__quality", "quality").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of least id of each group of near-duplicates (5-word shingles, similarity 0.8)."""
    leave = near_duplicates(docs.select("doc_id", "text"), size=5).where("not kept").select(F.col("doc_id").alias("__leave")).distinct()
    return docs.join(leave, F.col("doc_id") == F.col("__leave"), "left_anti")


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put a mark in the place of every secret; n_chars follows the text."""
    clean = redact_secrets(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their shares: documents leave, come once or twice, or end where a budget ends."""
    return mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents."""
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secret_scan", secret_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Sketches, Markov models and tokenizers are beyond SQL; tests hold the redaction and packing stages against plain Python and
#: check that the quality stage keeps rows whole. The near-duplicate and mixing stages and ``run`` are tested by their operators only.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}")
    return docs
