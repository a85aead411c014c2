"""The corpus pipeline: quality, near copies, benchmark passages, mixture, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that the next one reads as
its docs; all but the last return the columns of ``documents``. Null and empty texts and
those without words score 0 and go with the first stage; rows without a doc_id are in no
group of near copies and stay; rows that repeat a doc_id and text are one document, unlike
texts under one doc_id are several; columns beyond those of ``documents`` are carried
along, whatever their names; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from galeria.llm.common import discard, scratch, stored, table
from galeria.llm.decontam import clean
from galeria.llm.dedup import deduplicated
from galeria.llm.mix import mix_documents
from galeria.llm.quality import filtered
from galeria.llm.shard import sharded_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near copies."""
    return deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark's items."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of sources at target weights, as documents: a row for each round that takes words of one."""
    return mix_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard of 16 and its slot there."""
    return sharded_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("sharding", sharding),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs, path = stored(stage(spark, docs, sf_dir), name.split()[0])
            keep.add(path)
        if last:
            discard(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
