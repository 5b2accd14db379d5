"""A training-data pipeline over ``documents``: each stage reads what its predecessor kept.

toxicity -> exact copies -> near copies -> personal data -> packing.  Every stage takes (spark, docs, sf_dir) and
returns the columns of documents, the last one the packed pieces.  Stages are written as Parquet in the shared
folder and read again, so a lost executor costs its own stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from filinglens.llm import exact, near, packing, surrogates, toxicity
from filinglens.llm.common import documents, labels, stored


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold."""
    return toxicity.without_toxic(docs, labels(spark, sf_dir))


def copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact.without_duplicates(docs)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id."""
    return near.without_near_duplicates(docs)


def private_data_replaced(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data in their texts."""
    return surrogates.with_surrogates(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    return packing.pack(docs)


STAGES = [("toxicity", toxic_out), ("exact_dedup", copies_out), ("near_dedup", near_copies_out), ("pii", private_data_replaced), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


# The toxicity model, MinHash and the tokenizer have no form in SQL; tests hold the stages against brute force.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
