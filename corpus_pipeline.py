"""A corpus pipeline of five stages over ``documents``; each keeps whole rows until the last packs them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from locusloom.llm import minhash_dedup, mixing, packing, quality_classifier, quality_rules
from locusloom.plans.checkpoints import shared_folder


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier rejects."""
    return quality_classifier.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def rule(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the current rule policy rejects."""
    return quality_rules.keep(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates."""
    return minhash_dedup.keep(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents towards the sources' targets."""
    return mixing.emit(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' tokens into sequences."""
    return packing.pack_documents(docs)


STAGES = [("quality_classifier", classify), ("quality_rules", rule), ("minhash_dedup", dedup), ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's rows are stored as Parquet and read again by the next.

    They lie in a new folder in that of ``spark.checkpoint.dir``. So each text is scored once, and a stage that is
    repeated after the loss of an executor reads the same rows in the same order. Defined results: null, empty and very long texts,
    repeated rows and further columns are handled as each stage states it; an empty table packs into no rows.
    """
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
    return docs


#: Fitted weights and token ids are beyond SQL; tests/llm holds the stages against a plain version.
ORACLE_SQL = None
