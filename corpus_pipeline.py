"""Corpus pipeline: quality rules, near-duplicate removal, decontamination, redaction, packing.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns the columns of
documents; the last returns the packed places.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempestry.llm import decontamination, jaccard, packing, privacy, quality
from tempestry.llm.common import discard, shared_dir, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and stay inside the fences of their language and source."""
    return quality.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return jaccard.deduplicated(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced; n_chars follows the text."""
    out = privacy.redacted(docs, privacy.fit(docs))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


def length_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every document in a batch."""
    return packing.packed(docs.select("doc_id", "text"), drop_text=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("redaction", redaction),
    ("length_packing", length_packing),
]

#: Similarity joins, tiling, boosted selection and the packing optimum have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written and read again as the next one's input, and deleted after that."""
    docs, before = table(spark, sf_dir, "documents"), None
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        if before:
            discard(spark, before)
        before = f"{at}/{name}"
    return docs
