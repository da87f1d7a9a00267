"""Queries of the training-data operators: one opN_<name> each, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import ann, lm_score, lz_fingerprint, main_text, mixing, packing, quality, simhash, token_counts, toxicity
from textloom.llm._common import read


def op1_length_bucket_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op2_simhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_near_duplicates(read(spark, sf_dir, "documents"))


def op3_ann_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"))


def op4_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.lz_fingerprints(read(spark, sf_dir, "documents"))


def op5_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), token_counts.load_pieces())


def op6_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents are replicated and shuffled; a digest of each copy's text is returned in its place."""
    mixed = mixing.mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.col("__copy").alias("copy"), F.col("__order").alias("shuffle_key"))


def op7_masked_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.masked_scores(read(spark, sf_dir, "documents"))


def op8_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return main_text.extract(pages, main_text.learn(pages))


def op9_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


_OPERATORS = (
    op1_length_bucket_packing,
    op2_simhash_near_dups,
    op3_ann_multi_index,
    op4_lz_fingerprint,
    op5_trie_token_counts,
    op6_poisson_mixing,
    op7_masked_lm_score,
    op8_html_main_text,
    op9_quality_fm,
    op10_toxicity_grammar,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _OPERATORS}


def oracle_sql() -> dict[str, str]:
    """The others have no SQL: their tests hold them against brute force or held-out labels."""
    return {"op6_poisson_mixing": mixing.ORACLE_SQL}
