"""A corpus pipeline: toxic, then poor documents go, one of each near-duplicate group stays, and the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Stages
are written as Parquet and read again in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellplan.llm import neardup, packing, quality, toxicity
from cellplan.llm.common import remove, table, written


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the model rejects; it learns from the labelled documents among those it is given."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def poor_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the model rejects; it learns from the labelled and the surest unlabelled ones among those it is given."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one of each group of five-word shingle similarity 0.8 or more; rows that repeat doc_id and text count once."""
    return neardup.keep_one(docs, size=5)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 1024 tokens: a row for each piece of a document and its place."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", toxic_out), ("quality", poor_out), ("near_duplicates", copies_out), ("packing", packed)]

#: SQL can't express the fitted models, the sketches or the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; a stage's table is deleted when the next one's is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, path = written(docs, name)
            if before:
                remove(spark, before)
            before = path
    return docs
