"""The corpus pipeline: documents that are clean, each text once, packed into training sequences.

Every stage takes the documents that the stage before kept and calls one
operator; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from structura.llm import exact_dedup, packing, simhash, toxicity
from structura.llm.common import Scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, doesn't reject."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.reject(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id."""
    return exact_dedup.drop_duplicates(docs, snapshots=3)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the smallest id."""
    return simhash.keep_first(docs, shingle=3, radius=2)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's tokens lie in the training sequences."""
    return packing.pack_documents(docs, capacity=2048, per_source=4)


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_exact_copies), ("SimHash near-dedup", drop_near_copies), ("best-fit packing", pack)]

#: SQL can't train a classifier or pack best-fit.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), str(k))
    return docs
