"""Packing into optimal length buckets.

A global histogram of lengths goes through a dynamic programme that picks the bucket bounds with the least padding:
a document in a bucket is padded to the bucket's bound, its longest length. For a fixed last bound the choice of the
bound before it is a minimum over lines, so each further bucket costs one pass over the distinct lengths. Within a
bucket documents fill token-budget batches in the order of a hash of the document and the number of its copy.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm._common import cut
from textloom.llm.mixing import uniform

CHUNK_ROWS = 50_000


def words(text_col: str = "text") -> Column:
    """Number of words (runs without ASCII white space); 0 for a null text."""
    return F.coalesce(F.size(F.array_remove(F.split(F.col(text_col).cast("string"), r"[ \t\n\x0B\f\r]+"), "")), F.lit(0)).cast("long")


def optimal_bounds(lengths: Sequence[int], counts: Sequence[int], buckets: int) -> list[int]:
    """Bounds (ascending, the last is the greatest length) of at most so many buckets with the least total padding.

    lengths are distinct and ascending. Among equal choices the one with the fewest buckets is taken.
    """
    m = len(lengths)
    if m == 0:
        return []
    before = [0]
    for c in counts:
        before.append(before[-1] + c)
    cost = [0] + [length * n for length, n in zip(lengths, before[1:], strict=True)]  # of the first j lengths in one bucket
    steps, best, fewest = [], cost[-1], 1
    for k in range(2, min(buckets, m) + 1):
        hull: list[tuple[int, int, int]] = []  # (slope, intercept, i), of the lower envelope for growing lengths
        new, choice, at = [0] + [None] * m, [0] * (m + 1), 0
        for j in range(1, m + 1):
            if j - 1 >= k - 1 and cost[j - 1] is not None:
                line = (-before[j - 1], cost[j - 1], j - 1)
                while len(hull) >= 2 and (line[1] - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - line[0]):
                    hull.pop()
                hull.append(line)
                at = min(at, len(hull) - 1)
            if hull:
                x = lengths[j - 1]
                while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                    at += 1
                new[j] = hull[at][0] * x + hull[at][1] + before[j] * x
                choice[j] = hull[at][2]
        steps.append(choice)
        cost = new
        if cost[m] < best:
            best, fewest = cost[m], k
    bounds, j = [], m
    for k in range(fewest, 0, -1):
        bounds.append(lengths[j - 1])
        j = steps[k - 2][j] if k > 1 else 0
    return bounds[::-1]


def hashed(doc_id: Column, copy: Column) -> Column:
    return uniform(F.lit("pack"), doc_id, copy)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: Column | None = None, buckets: int = 16, budget: int = 16_384, order: Callable[[Column, Column], Column] = hashed) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_tokens, batch, position for every row of docs.

    bucket counts from 0 in order of length; bucket_tokens is its bound, to which its documents are padded. A batch
    of a bucket holds budget // bucket_tokens documents, one at least: a document above the budget is a batch of its
    own. order(doc_id, copy) is a number in (0, 1) by which a bucket's rows are laid in batches; copy counts the rows of
    one id and length from 0, so that copies of a document are spread. position counts from 0 in the batch; only a bucket's last batch may be short. Lengths are words unless a
    length column is given; null lengths count as 0, and a bound of 0 takes up a token. Repeated rows and null ids are
    packed as rows of their own. An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    sized = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(words(text_col) if length is None else length.cast("long"), F.lit(0)).alias("n_tokens")))
    # One row for each distinct length: no more than the longest text has words, and of N words in all sqrt(2 N).
    histogram = sorted((r["n_tokens"], r["count"]) for r in sized.groupBy("n_tokens").count().collect())
    bounds = optimal_bounds([n for n, _ in histogram], [c for _, c in histogram], buckets)
    total = sum(c for _, c in histogram)
    held = F.array(*map(F.lit, bounds)) if bounds else F.array(F.lit(0))
    bucket = F.size(F.filter(held, lambda b: b < F.col("n_tokens")))
    chunks = max(1, -(-total // CHUNK_ROWS))
    copies = sized.groupBy("doc_id", "n_tokens").count().withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1))).drop("count")
    rows = copies.withColumn("bucket", bucket).withColumn("draw", order(F.col("doc_id"), F.col("copy"))).withColumn("chunk", F.floor(F.col("draw") * chunks).cast("int"))
    # The rank in a bucket: the rank in a chunk of it, after the sizes of the chunks before.
    sizes = rows.groupBy("bucket", "chunk").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("base", F.sum("n").over(Window.partitionBy("bucket").orderBy("chunk")) - F.col("n")).drop("n")
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("bucket", "chunk").orderBy("draw", "doc_id", "n_tokens", "copy")) - 1)
    ranked = ranked.join(sizes, ["bucket", "chunk"]).withColumn("r", F.col("r") + F.col("base"))
    ranked = ranked.withColumn("bucket_tokens", F.element_at(held, F.col("bucket") + 1).cast("long"))
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.lit(1), F.col("bucket_tokens")))).cast("long")
    return ranked.select("doc_id", "n_tokens", "bucket", "bucket_tokens", F.floor(F.col("r") / room).cast("long").alias("batch"), (F.col("r") % room).cast("long").alias("position"))
