"""Lempel-Ziv phrase fingerprints: the phrase set of an LZ78 parse, as a minimum-hash signature.

A text is parsed left to right into phrases, each the shortest one not yet in the text's own dictionary. The
dictionary holds every prefix of its phrases, so the search starts at the length of the last phrase and goes up or
down a character at a time. Phrases are hashed together, from prefix sums of a polynomial over the code points.
The signature is one permutation with BINS bins: each phrase hash names a bin and a 16-bit value, and a bin keeps its
least value. Likeness of two signatures estimates the Jaccard likeness of the phrase sets, which is high where one
text's dictionary compresses the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._common import shuffle_width

BINS = 128
_EMPTY = 0xFFFF
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _phrases(text: str, at: int, stop: int, known: set[str], cuts: list[int], length: int = 1) -> int:
    """Parse text from at; adds phrases that end by stop to known and their ends to cuts; gives where it stopped."""
    while at < stop:
        if at + length > stop:
            length = stop - at
        if text[at : at + length] in known:
            length += 1
            while at + length <= stop and text[at : at + length] in known:
                length += 1
            if at + length > stop:
                return at  # the rest is a phrase already known
        else:
            while length > 1 and text[at : at + length - 1] not in known:
                length -= 1
        known.add(text[at : at + length])
        at += length
        cuts.append(at)
    return at


class _Hasher:
    """Hashes of the phrases of texts; holds the powers of the polynomial's base and its inverse as far as needed."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate((self.up, self.up * np.uint64(pow(_BASE, k, 1 << 64))))
            self.down = np.concatenate((self.down, self.down * np.uint64(pow(pow(_BASE, -1, 1 << 64), k, 1 << 64))))

    def __call__(self, text: str, cuts: list[int]) -> np.ndarray:
        n = len(text)
        self._grow(n + 1)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(points * self.up[:n], dtype=np.uint64)))
        ends = np.array(cuts, np.int64)
        starts = np.concatenate(([0], ends[:-1]))
        h = (sums[ends] - sums[starts]) * self.down[starts]
        h ^= (ends - starts).astype(np.uint64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        return h ^ (h >> np.uint64(31))


def _signature(hashes: np.ndarray) -> np.ndarray:
    sig = np.full(BINS, _EMPTY, np.uint16)
    value = np.minimum((hashes & np.uint64(0xFFFF)).astype(np.uint16), _EMPTY - 1)
    np.minimum.at(sig, (hashes >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64), value)
    return sig


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of bins with equal values among those that either has filled; 1.0 for two empty signatures."""
    filled = int(np.count_nonzero((a != _EMPTY) | (b != _EMPTY)))
    return 1.0 if not filled else int(np.count_nonzero((a == b) & (a != _EMPTY))) / filled


def hex_of(sig: np.ndarray) -> str:
    return sig.astype(">u2").tobytes().hex()


_hasher = _Hasher()


def signature(text: str | None) -> np.ndarray:
    """Signature of one text; of a null or empty text, with no bin filled."""
    text, cuts = text or "", []
    _phrases(text, 0, len(text), set(), cuts)
    return _signature(_hasher(text, cuts)) if cuts else np.full(BINS, _EMPTY, np.uint16)


def edited(text: str, after: str) -> str:
    """text with its last floor(n/2) code points replaced by the first as many (or all) of after."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def signature_pair(text: str, after: str) -> tuple[np.ndarray, np.ndarray, str]:
    """Signatures of a text and of its edited text, and that text. What both begin with is parsed once."""
    other = edited(text, after)
    shared, cuts, known = len(text) - len(text) // 2, [], set()
    at = 0
    # A phrase that ends within the shared part is the same in both parses.
    at = _phrases(text, 0, shared, known, cuts)
    other_known, other_cuts = set(known), list(cuts)
    _phrases(text, at, len(text), known, cuts)
    _phrases(other, at, len(other), other_known, other_cuts)
    empty = np.full(BINS, _EMPTY, np.uint16)
    return (_signature(_hasher(text, cuts)) if cuts else empty), (_signature(_hasher(other, other_cuts)) if other_cuts else empty.copy()), other


def _bucket(bounds: list[int]):
    """Number of bounds that are <= doc_id, found in two steps of about sqrt(len(bounds)) comparisons."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    rows = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    heads = F.array(*[F.lit(r[0]) for r in rows])
    coarse = F.size(F.filter(heads, lambda x: x <= F.col("doc_id")))
    row = F.element_at(F.array(*[F.array(*map(F.lit, r)) for r in rows]), F.greatest(coarse, F.lit(1)))
    fine = F.size(F.filter(row, lambda x: x <= F.col("doc_id")))
    return F.when(F.col("doc_id").isNull() | (coarse == 0), 0).otherwise((coarse - 1) * step + fine)


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def lz_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every text and of its edited text, with the likeness to that and to the next document.

    The next document is the next row in the order (doc_id, text), nulls first; after the last comes the first, so a
    lone row follows itself. A null text counts as empty; an empty text has no phrase: its fingerprint is all f, its
    likeness to another empty one 1. Repeated rows each give a row. An empty table gives an empty result. Other columns
    are not read.

    Documents are dealt once, into ranges of doc_id whose bounds come from a quantile sketch of the ids. The first
    document of each range goes along to the range before it, so that no range needs another.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    width = shuffle_width(spark)
    points = own.select(F.percentile_approx("doc_id", F.array(*[F.lit(i / width) for i in range(1, width)]) if width > 1 else F.array(F.lit(0.5)), 100 * width)).first()[0]
    bounds = sorted(set(points or []))[: width - 1]
    placed = own.withColumn("bucket", _bucket(bounds))
    # A row of two integers for each range: no more rows than shuffle partitions.
    firsts = sorted((r["bucket"], r["first"]) for r in own.select("doc_id").withColumn("bucket", _bucket(bounds)).groupBy("bucket").agg(F.min(F.struct("doc_id"))["doc_id"].alias("first")).collect())
    before = [(firsts[i][1], firsts[i - 1][0]) for i in range(len(firsts))]  # the first of all follows the last
    ahead = spark.createDataFrame(before, "first long, bucket int")
    copies = own.join(F.broadcast(ahead), F.col("doc_id").eqNullSafe(F.col("first"))).select("doc_id", "text", "bucket", F.lit(1).alias("role"))
    dealt = placed.select("doc_id", "text", F.col("bucket").cast("int").alias("bucket"), F.lit(0).alias("role")).unionByName(copies)
    dealt = dealt.repartitionById(max(1, width), F.col("bucket")).sortWithinPartitions("role", "doc_id", "text").select("doc_id", "text", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait, done = None, False  # the row whose next document is not yet read
        for batch in batches:
            pairs = []
            for doc_id, text, role in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if done:
                    break
                if wait is not None:
                    pairs.append((*wait, text))
                wait, done = (None, True) if role else ((doc_id, text), False)
            yield pa.RecordBatch.from_pylist(_compared(pairs), schema=_ARROW)

    return dealt.mapInArrow(run, _OUT)


def _compared(pairs: list[tuple]) -> list[dict]:
    """Result rows of (doc_id, text, next text), where the next text is mostly the next row's own."""
    both = [signature_pair(text, after) for _, text, after in pairs]
    rows = []
    for i, ((doc_id, text, after), (sig, other_sig, other)) in enumerate(zip(pairs, both, strict=True)):
        following = both[i + 1][0] if i + 1 < len(both) else signature(after)
        rows.append(
            {
                "doc_id": doc_id,
                "n_chars": len(text),
                "edited_sha256": hashlib.sha256(other.encode("utf-8", "replace")).hexdigest(),
                "fingerprint": hex_of(sig),
                "edited_fingerprint": hex_of(other_sig),
                "near_edited": likeness(sig, other_sig),
                "near_next": likeness(sig, following),
            }
        )
    return rows
