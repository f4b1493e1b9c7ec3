"""The corpus pipeline: from raw documents to packed training sequences.

Each stage is one operator of ``quern.llm``; its result is written as Parquet and read again as the next
stage's documents. No stage is expressible in SQL as a whole, so there is no oracle.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quern.llm import decontam, jaccard, packing, suffix, toxicity
from quern.llm.queries import TOKENIZER
from quern.llm.spread import shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity field does not reject."""
    return toxicity.accepted(docs, _table(spark, sf_dir, "labels"), folds=3, held=1, threshold=0.7)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones."""
    return jaccard.representatives(docs)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that repeat elsewhere."""
    return suffix.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean(docs, _table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.packed(docs, TOKENIZER)


STAGES = [
    ("toxicity", toxicity_stage),
    ("jaccard_join", jaccard_stage),
    ("suffix_array_dedup", suffix_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over sf_dir's documents; each stage's result is a table in the shared folder.

    Null and empty texts pass all filters (unless nearly all labels are toxic) and are packed as their end id alone;
    very long texts are treated whole; rows that repeat an id and text become one in the Jaccard stage, but those
    without words; null ids are ids; other columns, whatever their names, come along up to packing. Empty documents
    give an empty result, an empty benchmark or no labels take nothing away.
    """
    rows = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, rows, sf_dir).write.parquet(path)
        rows = spark.read.parquet(path)
    return rows
