"""Small plans over the driver's tables that the catalog registers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.spread import spread
from textloom.operators import corpus
from textloom.plans.samples import TEXTS


def documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """These columns of every document, over all cores."""
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select(*cols))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): every document and the sample texts."""
    return documents(spark, sf_dir, "doc_id", "text").unionByName(spark.createDataFrame(TEXTS, "doc_id long, text string"))


def author_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as their sources' samples: those of a usable size; every fifth id counts as spoken."""
    docs = documents(spark, sf_dir, "doc_id", "source", "text")
    return corpus.valid(docs.select(F.col("source").alias("author"), F.col("doc_id").alias("sample"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("label"), F.when(F.col("doc_id") % 5 == 0, "spoken").otherwise("written").alias("type"), "text", F.lit(False).alias("override")))


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a draft of the source after its own in name order, so that it is someone else's."""
    docs = documents(spark, sf_dir, "doc_id", "source", "text")
    n = F.regexp_extract("source", "(\\d+)$", 1)
    return docs.select("doc_id", F.concat(F.lit("src"), ((n.cast("int") + 1) % 20).cast("string")).alias("author"), "text")
