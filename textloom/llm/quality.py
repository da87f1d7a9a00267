"""Quality classifier: a factorisation machine over hashed words and structure statistics.

Of a document's metadata labels, language, source and id may not be inputs; its length, which is left, is a statistic of
the text itself.

score(x) = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), where the pair term is half of
sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2): linear in the number of features.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._common import fold, keep_rows
from textloom.llm.labels import training_rows

HASHED = 1024
#: Cut points that turn a statistic into a ramp: one feature for each step that the value passes.
_RAMPS = {
    "log2_chars": (2, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17),
    "log2_lines": (1, 2, 3, 4, 5, 6, 8, 10),
    "upper_share": (0.01, 0.03, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8),
    "digit_share": (0.005, 0.01, 0.03, 0.06, 0.1, 0.2, 0.4),
    "symbol_share": (0.005, 0.01, 0.03, 0.06, 0.1, 0.2, 0.3),
    "exclaim_share": (0.002, 0.01, 0.03, 0.06, 0.1, 0.2),
    "bar_share": (0.002, 0.01, 0.03, 0.06, 0.1, 0.2),
    "stop_share": (0.003, 0.006, 0.01, 0.015, 0.02, 0.03, 0.05),
    "comma_share": (0.003, 0.006, 0.01, 0.015, 0.02, 0.03, 0.05),
    "other_share": (0.01, 0.03, 0.06, 0.1, 0.2, 0.4, 0.6),
    "space_share": (0.02, 0.06, 0.1, 0.13, 0.16, 0.2, 0.3, 0.5),
    "distinct_words": (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9),
    "repeated_next": (0.02, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8),
    "distinct_lines": (0.1, 0.2, 0.3, 0.5, 0.7, 0.85, 0.95),
    "word_chars": (2, 3, 3.5, 4, 4.5, 5, 5.5, 6, 7, 8, 10, 15),
    "long_words": (0.01, 0.03, 0.06, 0.1, 0.2, 0.4),
    "short_words": (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7),
    "line_words": (1, 2, 4, 8, 16, 32, 64, 128, 512),
}
_NAMES = list(_RAMPS)
_CUTS = [np.array(c) for c in _RAMPS.values()]
STRUCTURE = sum(map(len, _CUTS))
WIDTH = HASHED + STRUCTURE

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#$%&*+/<=>@[\\]^_`{}~|")] = True


class _Slots(dict):
    """word -> hashed slot; emptied when full, which costs time and changes nothing."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 300_000:
            self.clear()
        self[word] = slot = zlib.crc32(word.encode("utf-8", "replace")) % HASHED
        return slot


def _statistics(text: str, words: list[str]) -> list[float]:
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    byte = np.bincount(raw, minlength=256)
    size, n = max(1, len(raw)), max(1, len(words))
    lines = [x for x in text.split("\n") if x]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    share = lambda *codes: sum(int(byte[c]) for c in codes) / size
    return [
        np.log2(1 + len(text)),
        np.log2(1 + len(lines)),
        int(byte[65:91].sum()) / size,
        int(byte[48:58].sum()) / size,
        int(byte[_SYMBOLS].sum()) / size,
        share(33),
        share(124),
        share(46, 63, 58, 59),
        share(44),
        int(byte[128:].sum()) / size,
        share(32, 9, 10, 13),
        len(set(words)) / n,
        sum(map(eq, words, words[1:])) / n,
        len(set(lines)) / max(1, len(lines)),
        float(lengths.mean()) if len(lengths) else 0.0,
        int((lengths > 12).sum()) / n,
        int((lengths < 4).sum()) / n,
        n / max(1, len(lines)),
    ]


def vector(text: str | None, slots: dict) -> np.ndarray:
    """Features of one text, all between 0 and 1: hashed words (root of their share), then the statistics' ramps."""
    text = text or ""
    words = text.split()
    out = np.zeros(WIDTH, np.float32)
    if words:
        counts = np.bincount(np.fromiter((slots[w] for w in words), np.int64, len(words)), minlength=HASHED)
        out[:HASHED] = np.sqrt(counts / len(words))
    at = HASHED
    for value, cuts in zip(_statistics(text, words), _CUTS, strict=True):
        out[at : at + len(cuts)] = value >= cuts
        at += len(cuts)
    return out


@dataclass
class Machine:
    bias: float
    w: np.ndarray
    v: np.ndarray

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.bias + x @ self.w + 0.5 * ((x @ self.v) ** 2 - (x * x) @ (self.v * self.v)).sum(1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x).astype(float), -60, 60)))


def fit_machine(x: np.ndarray, y: np.ndarray, rank: int = 8, epochs: int = 25, batch: int = 256, rate: float = 0.02, decay: float = 2e-4, seed: int = 7) -> Machine:
    """Minibatch Adam on the log loss. Without rows of both labels: the smoothed base rate for every text."""
    rng = np.random.default_rng(seed)
    n, d = x.shape
    base = (float(y.sum()) + 1) / (n + 2)
    if n == 0 or y.min() == y.max():
        return Machine(float(np.log(base / (1 - base))), np.zeros(d, np.float32), np.zeros((d, rank), np.float32))
    theta = [np.array([np.log(base / (1 - base))], np.float32), np.zeros(d, np.float32), rng.normal(0, 0.01, (d, rank)).astype(np.float32)]
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(n)
        for i in range(0, n, batch):
            rows = order[i : i + batch]
            xb, machine = x[rows].astype(np.float32), Machine(float(theta[0][0]), theta[1], theta[2])
            e = ((machine.probability(xb) - y[rows]) / len(rows)).astype(np.float32)
            inner = xb @ theta[2]
            grads = [np.array([e.sum()]), xb.T @ e + decay * theta[1], xb.T @ (e[:, None] * inner) - ((xb * xb).T @ e)[:, None] * theta[2] + decay * theta[2]]
            step += 1
            lr = rate * (1 - epoch / epochs) * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
            for t, g, m, s in zip(theta, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                t -= (lr * m / (np.sqrt(s) + 1e-8)).astype(np.float32)
    return Machine(float(theta[0][0]), theta[1], theta[2])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_parts: int = 3, held_fold: int = 1, max_rows: int = 12_000) -> Machine:
    """Fit on at most about max_rows labelled rows outside the held-out fold; their vectors (2 bytes a feature) meet on the driver."""
    rows = training_rows(docs, labels, "quality", id_col, text_col, held_parts, held_fold, max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = _Slots()
        for batch in batches:
            xs = [vector(t, slots).astype(np.float16).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(xs, pa.binary()), batch.column(2)], names=["doc_id", "x", "y"])

    got = rows.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, x binary, y int").toArrow()
    x = np.frombuffer(b"".join(v.as_py() for v in got["x"]), np.float16).reshape(-1, WIDTH)
    y = (got["y"].to_numpy() > 0).astype(np.float32)
    order = np.lexsort((x.astype(np.float32).sum(1), got["doc_id"].to_numpy())) if len(y) else np.arange(0)  # the same order at every run
    return fit_machine(x[order], y[order])


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", held_parts: int = 3, held_fold: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    A null text counts as empty, and an empty text gets the score of its (all but constant) vector. A null id is never
    held out. Repeated rows each give a row; an empty table gives an empty result. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, slots = shared.value, _Slots()
        for batch in batches:
            texts, parts = batch.column(1).to_pylist(), []
            for i in range(0, len(texts), 512):
                parts.append(own.probability(np.array([vector(t, slots) for t in texts[i : i + 512]])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts) if parts else np.empty(0))], names=["doc_id", "score"])

    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold("doc_id", held_parts) == held_fold, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Fit on the labels outside the held-out fold, then score every document."""
    return score(docs, fit(docs, labels, **options), **{k: v for k, v in options.items() if k != "max_rows"})


def keep_good(docs: DataFrame, machine: Machine, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that score threshold or more, with all columns; nulls and empty texts are scored as in score()."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def keep():
        slots = _Slots()

        def judge(texts: list[str | None]) -> list[bool]:
            out: list[bool] = []
            for i in range(0, len(texts), 512):
                out += (shared.value.probability(np.array([vector(t, slots) for t in texts[i : i + 512]])) >= threshold).tolist()
            return out

        return judge

    return keep_rows(docs, text_col, keep)
