"""SimHash near-duplicates through a segment-popcount embedding.

Fingerprint: majority vote of the 64-bit hashes of a text's word shingles. Candidate search: a fingerprint is
embedded as the bit counts of its 32 two-bit segments. One differing bit moves one count by at most one, so the
Manhattan distance of two embeddings is a lower bound of the Hamming distance. The counts are written in unary
(0, 1, 2 -> 00, 01, 11), which makes that Manhattan distance the population count of an XOR.

Grid range-join: the 32 counts are cut into max_distance + 3 blocks. Two embeddings within max_distance disagree in
at most max_distance blocks, so they agree on three whole blocks at least: each fingerprint goes to one grid cell for
every choice of three blocks, and every pair in range meets in a cell. In a cell the Manhattan bound is tested first
and the Hamming distance exactly afterwards.

Equal fingerprints are one row here, so exact copies never meet. A cell gives a spanning forest of the links among
its members, never all of them: what was reached is taken out of the cell, and cells are read as sorted runs, eight
bytes a member.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._common import cut
from textloom.llm.components import components

_SEGMENTS = 32
_ODD = 0x5555555555555555
#: byte -> eight byte lanes with that byte's bits
_LANES = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of one text, unsigned; zero for a text without words (or null)."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    n = len(words)
    if n == 0:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n <= shingle:
        hashes = [digest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate(([0], ends[: n - shingle] + 1))
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    lanes = _LANES[np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(lanes, np.arange(0, len(hashes), 255), axis=0)  # 255 rows can't overflow a lane
    votes = sums.view(np.uint8).reshape(len(sums), 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id long, fp long) of every row; fp holds the unsigned fingerprint's bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t, shingle) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, fp long")


def _unary(x: np.ndarray) -> np.ndarray:
    """Unary-coded bit counts of the two-bit segments."""
    odd, one = np.uint64(_ODD), np.uint64(1)
    return ((x | (x >> one)) & odd) | ((x & (x >> one) & odd) << one)


def _blocks(max_distance: int) -> list[int]:
    """A mask of the unary code for each block of segments."""
    edges = np.linspace(0, _SEGMENTS, max_distance + 4).round().astype(int)
    return [((1 << (2 * int(b))) - 1) ^ ((1 << (2 * int(a))) - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(cell: np.ndarray, max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one cell that keep every connection among its members: each reached member is linked once."""
    left = np.unique(cell)
    code = _unary(left)
    heads, tails = [], []
    while left.size > 1:
        front = [(left[0], code[0])]
        left, code = left[1:], code[1:]
        while front and left.size:
            x, u = front.pop()
            near = np.flatnonzero(np.bitwise_count(code ^ u) <= max_distance)
            near = near[np.bitwise_count(left[near] ^ x) <= max_distance]
            if near.size:
                heads.append(np.full(near.size, x, np.uint64))
                tails.append(left[near])
                front += zip(left[near], code[near], strict=True)
                left, code = np.delete(left, near), np.delete(code, near)
    empty = np.empty(0, np.uint64)
    return (np.concatenate(heads), np.concatenate(tails)) if heads else (empty, empty)


def _links_of_runs(key: np.ndarray, fp: np.ndarray, max_distance: int) -> pd.DataFrame:
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    lengths = np.diff(np.concatenate((starts, [len(key)])))
    twos = starts[lengths == 2]
    a, b = fp[twos], fp[twos + 1]
    near = np.bitwise_count(_unary(a) ^ _unary(b)) <= max_distance
    near &= np.bitwise_count(a ^ b) <= max_distance
    heads, tails = [a[near]], [b[near]]
    for s, n in zip(starts[lengths > 2], lengths[lengths > 2], strict=True):
        x, y = _forest(fp[s : s + n], max_distance)
        heads.append(x)
        tails.append(y)
    return pd.DataFrame({"a": np.concatenate(heads).view(np.int64), "b": np.concatenate(tails).view(np.int64)})


def fingerprint_links(distinct_fps: DataFrame, max_distance: int = 4) -> DataFrame:
    """distinct fp -> links (a, b) at max_distance or fewer bits; every linked pair is connected by them."""
    masks = [sum(c) for c in combinations(_blocks(max_distance), 3)]
    half = F.expr("shiftrightunsigned(fp, 1)")
    odd = F.lit(_ODD)
    unary = F.col("fp").bitwiseOR(half).bitwiseAND(odd).bitwiseOR(F.shiftleft(F.col("fp").bitwiseAND(half).bitwiseAND(odd), 1))
    cells = F.array(*[F.xxhash64(F.lit(i), F.col("u").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(masks)])
    placed = distinct_fps.select("fp", unary.alias("u")).select("fp", F.explode(cells).alias("cell"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # rows of the run that may go on in the next batch
        for batch in batches:
            if not len(batch):
                continue
            key, fp = batch["cell"].to_numpy(), batch["fp"].to_numpy().view(np.uint64)
            if held and key[-1] == held[0][0][0]:
                held.append((key, fp))
                continue
            key = np.concatenate([k for k, _ in held] + [key])
            fp = np.concatenate([f for _, f in held] + [fp])
            last = int(np.searchsorted(key, key[-1], "left"))
            held = [(key[last:], fp[last:])]
            if last:
                yield _links_of_runs(key[:last], fp[:last], max_distance)
        if held:
            yield _links_of_runs(np.concatenate([k for k, _ in held]), np.concatenate([f for _, f in held]), max_distance)

    return placed.repartition("cell").sortWithinPartitions("cell").mapInPandas(run, "a long, b long")


def simhash_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_distance: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, copies for every row of docs.

    Words are runs of bytes other than space and \\t\\n\\v\\f\\r, A-Z lower-cased. component_id is the smallest doc_id
    reachable over links of max_distance or fewer differing bits, the document's own included; copies counts the
    documents with the same fingerprint.
    Null, empty and wordless texts have fingerprint zero and link like any other. Repeated rows each give a row. A row
    with a null id gives a row; its component_id is the smallest non-null id of its component (null if there is none).
    An empty table gives an empty result. Other columns of docs are not read.
    """
    fps = cut(fingerprints(docs, id_col, text_col, shingle))
    groups = fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    labels = components(fingerprint_links(groups.select("fp"), max_distance))
    groups = groups.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = groups.groupBy("label").agg(F.min("first").alias("component_id"))
    groups = groups.join(least, "label").select("fp", "copies", "component_id")
    return fps.join(groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "copies")
