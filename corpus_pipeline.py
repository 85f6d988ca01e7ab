"""The corpus pipeline: quality rules, exact dedup, SimHash near-dedup, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, packing, quality_rules, secrets, simhash
from tessera.llm.common import documents, shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return quality_rules.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, spaces aside, through a digest index of its own."""
    return exact_dedup.deduplicate(docs, exact_dedup.DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts (5-word shingles, similarity 0.8), that with the smallest doc_id."""
    return simhash.keep_one(docs)


def scrub(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by a mark and ``n_chars`` counted anew."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in out.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document: its length in tokens, bucket, batch and slot."""
    return packing.pack(packing.lengths(docs, packing.default_path()), "length", "doc_id")


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("near_dedup", near), ("secret_scans", scrub), ("packing", pack)]

#: SQL can't express the SimHash components, the randomness battery or the bucket choice; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them goes to the cluster's shared folder."""
    docs, folder = documents(spark, sf_dir), f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}_{name}")
        docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
