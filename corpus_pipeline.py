"""From documents to packed training sequences, stage by stage.

Every stage works on all rows that its predecessor kept and is written before the next one reads it, so a lost executor
costs at most the running stage. Documents are told apart by ``doc_id``: rows that share one stay or go together.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sensorframe.llm import exact_groups, jaccard_components, pack_documents, quality_rules, redact, train_markov
from sensorframe.llm.queries import byte_tables
from sensorframe.llm.secret_scan import labelled_samples
from sensorframe.scratch import pin


def only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is among ``ids``; null is an id like others."""
    ids = ids.select(F.col("doc_id").alias("_kept"))
    return docs.join(ids, docs["doc_id"].cast("long").eqNullSafe(ids["_kept"]), "left_semi")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null and empty texts have too few words."""
    return only(docs, quality_rules(docs).where("kept"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id."""
    return only(docs, exact_groups(docs, keep="smallest").where("kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by similar shingles the document with the smallest id; documents without an id stay."""
    groups = jaccard_components(docs)
    return only(docs, groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark."""
    return redact(docs, train_markov(labelled_samples(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in the training sequences."""
    return pack_documents(docs, byte_tables(), public_tokenizers.PATTERN)


STAGES = [("quality rules", rules), ("exact dedup", exact), ("near duplicates", near), ("secret scan", secrets), ("packing", pack)]

#: Robust estimates by iteration and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = pin(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
