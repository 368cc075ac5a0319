"""The training-data pipeline: which documents are kept, how often, and how they are packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again before the next. All but the last return the columns of
documents; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberline.llm import mixing, packing, pii, simhash, toxicity
from emberline.llm.common import cut, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that the network scores 0.5 or more; it learns from labelled ones outside the held-out fold."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near duplicates."""
    return simhash.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a kind's name in the place of each span of personal data; keeps all documents."""
    return pii.masked(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources come to their target weights."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents' ids into sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxic),
    ("near-dedup", near_dedup),
    ("personal-data", personal_data),
    ("mixing", mix),
    ("packing", pack),
]

#: The stages learn a network, hash, bootstrap and tokenise, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
