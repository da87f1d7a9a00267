"""A training-data pipeline of five stages; each takes (spark, docs, sf_dir) and gives a DataFrame.

All but the last return the columns of documents, whatever they are; rows that repeat and rows without an id are rows
like any other, a null text is an empty one, and an empty table stays one. A stage learns from the labels of its own
input alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import mixing, near_copies, packing, quality, toxicity
from textloom.llm._common import read, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar scores 0.5 or more go. An empty text has no clause and stays."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores under 0.5 go, empty ones by the score of their statistics."""
    return quality.keep_good(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents alike to 0.8 or more, by five-word shingles, the one with the smallest id stays.

    Texts without words are alike. Rows without an id come last; a row that repeats another's id and text goes.
    """
    return near_copies.keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to the square roots of their sizes by Poisson replication, in a global shuffle; null is a source."""
    return mixing.mix(docs).drop("__copy", "__order")


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row that is left gets its length bucket, batch and position; a bucket's rows keep the order of the shuffle."""
    return packing.pack(docs, order=mixing.order)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_batches),
]

#: No SQL expresses the fitted stages; tests hold the pipeline against its stages done one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each over all that the one before kept, written to the shared folder in between."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
