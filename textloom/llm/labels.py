"""Labelled rows for fitting: a bounded, deterministic share of the labels, met with the documents in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._common import fold


def training_rows(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, fold_parts: int, held_fold: int | None, max_rows: int) -> DataFrame:
    """(doc_id, text, y) for at most about max_rows labelled rows of the folds that may be learned from.

    Beyond max_rows labels a share of them is taken by a hash of the id. The ids that are left are bounded by max_rows
    and so are broadcast; only their documents are shuffled. Null ids and null labels teach nothing; of an id's several
    labels the largest counts, of its several texts the first in their order.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id IS NOT NULL AND y IS NOT NULL")
    part = fold("doc_id", fold_parts)
    if held_fold is not None:
        known = known.filter(part != held_fold)
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    total = known.count()
    if total > max_rows:
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_000)) < int(1_000_000 * max_rows / total))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    met = own.join(F.broadcast(known), "doc_id")
    return met.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
