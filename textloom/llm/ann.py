"""Approximate nearest neighbours by cosine: an inverted multi-index.

Unit vectors are cut into halves, each quantised by its own codebook; a cell is a pair of centroids. The squared
distance from a query to a pair is the sum of two halves' distances, so a heap walks the pairs in ascending order from
sorted lists, up to a distance that is measured on a sample, whole cells always. Candidates are then ranked by the exact
cosine of the original vectors.

Equal vectors are one entry, with the smallest ids of its rows: no query can be shown more of them. Entries meet the
queries that probe their cells in blocks of bounded size on either side.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm._common import cut, shuffle_width


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, which is exact, so that neither huge nor tiny components leave the range."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _nearest_centroid(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.argmin((book * book).sum(1) - 2 * x @ book.T, axis=1)


def codebook(x: np.ndarray, size: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """k-means centroids of the rows of x (Lloyd's rounds from distinct random rows)."""
    rng = np.random.default_rng(seed)
    rows = np.unique(x, axis=0)
    book = rows[rng.permutation(len(rows))[:size]].copy()
    for _ in range(rounds):
        own = _nearest_centroid(x, book)
        n = np.bincount(own, minlength=len(book))
        sums = np.zeros_like(book)
        np.add.at(sums, own, x)
        book[n > 0] = sums[n > 0] / n[n > 0, None]
    return book


def walk(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, enough: int, limit: float = -np.inf) -> np.ndarray:
    """Pairs of centroids by ascending summed distance: those within limit, and on until their cells hold enough entries.

    Empty cells are left out. A heap holds the next pair of each first centroid.
    """
    i, j = np.nonzero(sizes)
    within = first[i] + second[j] <= limit
    if sizes[i[within], j[within]].sum() >= enough:  # nothing beyond the limit will be wanted
        i, j = i[within], j[within]
    order = np.lexsort((second[j], i))
    i, j = i[order], j[order]
    sums, counts = (first[i] + second[j]).tolist(), sizes[i, j].tolist()
    starts = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1]))) if i.size else np.empty(0, np.int64)
    ends = [*starts[1:].tolist(), len(sums)]
    heap = [(sums[s], s, e) for s, e in zip(starts.tolist(), ends, strict=False)]
    heapq.heapify(heap)
    found, held = [], 0
    while heap and (held < enough or heap[0][0] <= limit):
        _, at, end = heap[0]
        found.append(at)
        held += counts[at]
        if at + 1 < end:
            heapq.heapreplace(heap, (sums[at + 1], at + 1, end))
        else:
            heapq.heappop(heap)
    return np.stack((i[found], j[found]), axis=1)


def reach_limit(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], k: int, reach: float, queries: int = 256) -> float:
    """The summed distance within which a share `reach` of the k nearest of sampled rows x have their cells.

    Taken among the sample's own rows: in the whole table the nearest are nearer, so that no less is found there.
    """
    h = books[0].shape[1]
    cells = [_nearest_centroid(x[:, :h], books[0]), _nearest_centroid(x[:, h:], books[1])]
    asked = np.arange(0, len(x), max(1, len(x) // queries))
    sums = []
    for at in asked:
        near = x @ x[at]
        near[at] = -np.inf
        best = np.argsort(-near, kind="stable")[: min(k, len(x) - 1)]
        sums.append(((books[0][cells[0][best]] - x[at, :h]) ** 2).sum(1) + ((books[1][cells[1][best]] - x[at, h:]) ** 2).sum(1))
    every = np.concatenate(sums) if sums else np.empty(0)
    return float(np.quantile(every, reach)) if every.size else np.inf


def _blocks(sizes: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, parts) of each cell: the number of its first block and in how many it lies."""
    first, parts = np.zeros(len(sizes), np.int64), np.maximum(1, -(-sizes // block))
    number, held = 0, 0
    for cell in np.flatnonzero(sizes).tolist():
        n = int(sizes[cell])
        if held and held + n > block:
            number, held = number + 1, 0
        first[cell] = number
        if n > block:
            number, held = number + int(parts[cell]), 0
        else:
            held += n
    return first, parts


def _valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec, key) of the rows that take part; key names the vector."""
    vec = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec")).filter("vec_id IS NOT NULL AND vec IS NOT NULL")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.filter(~F.exists("vec", bad)).filter(F.exists("vec", lambda x: x != 0))
    width = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if width is not None:
        rows = rows.filter(F.size("vec") == width["n"])
    return rows.withColumn("key", F.md5(F.col("vec").cast("string").cast("binary")))


def nearest(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 50, k: int = 5, reach: float = 0.94, candidates: int = 0, fit_rows: int = 20_000, most_centroids: int = 512, block: int = 4_096) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row whose id is divisible by every.

    Rows with a null id, a null or zero vector, or null or non-finite components take no part, nor do vectors of another
    length than the most frequent. A row repeated with the same id and vector counts once; a query is never its own
    neighbour. Ties go to the smaller id. With fewer than k candidates all are returned, with none no row. The codebooks
    are fitted on at most about fit_rows vectors; every row is indexed. A query's cells are those within the distance
    that holds a share `reach` of the true neighbours in the fitted sample, and as many more as k other entries (or
    `candidates`) take. How much of the table that is follows from the data: a fifth where vectors are all but noise, as
    the driver's are, far less where they have structure. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = cut(_valid(vectors, id_col, vec_col).groupBy("vec_id", "key").agg(F.first("vec").alias("vec")))
    # Equal vectors: the k + 1 smallest ids are all that any query can be shown. The limit is taken in each task first.
    least = rows.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))).filter(F.col("n") <= k + 1)
    entries = cut(least.groupBy("key").agg(F.first("vec").alias("vec"), F.sort_array(F.collect_list("vec_id")).alias("ids")))
    total = entries.count()
    result = "query_id long, rank int, vec_id long, score double"
    if total == 0:
        return spark.createDataFrame([], result)
    picked = F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, fit_rows / total) + 1)
    sample = entries.filter(picked).orderBy("key").select("vec").toArrow()["vec"].combine_chunks()
    if not len(sample):
        sample = entries.select("vec").limit(1).toArrow()["vec"].combine_chunks()
    x = _unit(sample.flatten().to_numpy().reshape(len(sample), -1))
    half = max(1, x.shape[1] // 2)
    size = int(np.clip(len(x) // 4, 1, most_centroids))
    books = codebook(x[:, :half], size), codebook(x[:, half:], size) if x.shape[1] > half else np.zeros((1, 0))
    limit, seconds = reach_limit(x, books, k, reach), len(books[1])
    shared = spark.sparkContext.broadcast((books, half))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (one, two), h = shared.value
        for batch in batches:
            if batch.num_rows:
                u = _unit(batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1))
                cell = _nearest_centroid(u[:, :h], one) * seconds + _nearest_centroid(u[:, h:], two)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], names=["key", "vec", "ids", "cell"])

    placed = cut(entries.select("key", "vec", "ids").mapInArrow(place, "key string, vec array<double>, ids array<long>, cell int"))
    sizes = np.zeros(len(books[0]) * seconds, np.int64)
    for r in placed.groupBy("cell").count().collect():  # most_centroids squared at most
        sizes[r["cell"]] = r["count"]
    # Cells in turn fill blocks of about `block` entries; a larger cell is cut into several blocks of its own.
    first, parts = _blocks(sizes, block)
    grid = spark.sparkContext.broadcast((sizes.reshape(-1, seconds), first, parts))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, first_of, parts_of = grid.value
        for batch in batches:
            cell, salt = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns[1:4], pa.array(first_of[cell] + salt % parts_of[cell], pa.int32())], names=["vec", "ids", "cell", "block"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (one, two), h = shared.value
        held, first_of, parts_of = grid.value
        for batch in batches:
            out = {"query": [], "vec": [], "block": [], "cells": []}
            vecs = batch.column(1).to_pylist()
            u = _unit(np.array(vecs)) if vecs else np.empty((0, h))
            for key, vec, unit in zip(batch.column(0).to_pylist(), vecs, u, strict=True):
                pairs = walk(((one - unit[:h]) ** 2).sum(1), ((two - unit[h:]) ** 2).sum(1), held, max(candidates, k + 1), limit)
                cells = pairs[:, 0] * seconds + pairs[:, 1]
                times = parts_of[cells]
                which = np.repeat(first_of[cells], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                cells, order = np.repeat(cells, times), np.argsort(which, kind="stable")
                parts, starts = np.unique(which[order], return_index=True)
                for part, own in zip(parts.tolist(), np.split(cells[order], starts[1:]), strict=True):
                    for name, value in zip(out, (key, vec, part, own.astype(np.int32)), strict=True):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("query", pa.string()), ("vec", pa.list_(pa.float64())), ("block", pa.int32()), ("cells", pa.list_(pa.int32()))]))

    queries = rows.filter(F.col("vec_id") % every == 0)
    # Each query is much work: they are dealt out evenly. By key the plan would take the aggregation's few partitions.
    distinct = queries.groupBy("key").agg(F.first("vec").alias("vec")).repartition(shuffle_width(spark))
    probes = cut(distinct.mapInArrow(probe, "query string, vec array<double>, block int, cells array<int>"))
    # A block that many queries probe meets them in parts of a block's size.
    crowds = probes.groupBy("block").count().filter(F.col("count") > block).select("block", F.ceil(F.col("count") / block).cast("int").alias("t"))
    salt = lambda name: F.pmod(F.xxhash64(name), F.lit(1 << 30)).cast("int")
    left = placed.withColumn("salt", salt("key")).mapInArrow(settle, "vec array<double>, ids array<long>, cell int, block int")
    left = left.join(crowds, "block", "left").withColumn("t", F.explode(F.sequence(F.lit(0), F.coalesce("t", F.lit(1)) - 1)))
    right = probes.join(crowds, "block", "left").withColumn("t", salt("query") % F.coalesce("t", F.lit(1)))

    def rank(entry: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = {"query": [], "score": [], "ids": []}
        if len(entry) and len(asked):
            x, ids = _scaled(np.stack(entry["vec"].to_numpy())), entry["ids"].to_numpy()
            cell, firsts = entry["cell"].to_numpy(), np.fromiter((v[0] for v in ids), np.int64, len(ids))
            norms = np.linalg.norm(x, axis=1)
            for at in range(0, len(asked), 64):
                part = asked.iloc[at : at + 64]
                qs = _scaled(np.stack(part["vec"].to_numpy()))
                near = (x @ (qs / np.linalg.norm(qs, axis=1)[:, None]).T) / norms[:, None]
                for n, (query, cells) in enumerate(zip(part["query"], part["cells"], strict=True)):
                    own = np.flatnonzero(np.isin(cell, cells))
                    if len(own) > k + 1:  # all that may be among the best, ties and rounding included
                        s = near[own, n]
                        own = own[s >= np.partition(s, -k - 1)[-k - 1] - 1e-9]
                    scores = (x[own] * qs[n]).sum(1) / (norms[own] * np.linalg.norm(qs[n]))
                    for o in np.lexsort((firsts[own], -scores))[: k + 1]:
                        out["query"].append(query)
                        out["score"].append(float(scores[o]))
                        out["ids"].append(ids[own[o]])
        return pd.DataFrame(out)

    found = left.groupBy("block", "t").cogroup(right.groupBy("block", "t")).applyInPandas(rank, "query string, score double, ids array<long>")
    order = [F.desc("score"), F.col("vec_id")]
    best = found.select("query", "score", F.explode("ids").alias("vec_id"))
    best = best.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("n") <= k + 1).drop("n")
    shown = queries.select(F.col("vec_id").alias("query_id"), F.col("key").alias("query")).join(best, "query").filter("vec_id <> query_id")
    shown = shown.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= k)
    return shown.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
