"""Masked pseudo-likelihood under a bidirectional window network trained in numpy.

The network reads two words on either side of a masked one: embeddings of the four, by place, are added in a tanh layer,
and a softmax gives the class of the masked word. A word's probability is its class's, given its neighbours, times its
own among the words of that class, counted over every document: the vocabulary is the corpus's. A document's score is
the sum of the log-probabilities of its words.

Words are read as some two thousand context symbols: the frequent words of the corpus have one each, all others share
hashed ones by their ending. Classes are the most frequent words by themselves and hashed endings.

Training has two parts. Over the nearest neighbours' classes the objective depends on the corpus only through the counts
of (left, masked, right), which are gathered from every document and trained on in full. From there on every task trains
the whole network on its own documents, masking an eighth of the words at random, and the tasks' weights are averaged, each
by the words it has masked. Counts of words grow with the corpus and stay dealt out by the word's hash.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._common import cut, release, shuffle_width

EDGE, FREQUENT, HASHED = 1, 95, 32
SYMBOLS = EDGE + FREQUENT + HASHED
#: A chunk of documents ends at so many words or documents.
CHUNK_WORDS, CHUNK_DOCS = 500_000, 4096
#: Logarithms of word counts are added up as integers of this fraction, in any order to the same sum.
_FINE = float(1 << 24)
#: Context symbols of frequent words and of hashed endings (a multiple of HASHED), and the places of a window.
CONTEXT_WORDS, CONTEXT_HASHED, PLACES = 1_887, 160, 4
CONTEXTS = EDGE + CONTEXT_WORDS + CONTEXT_HASHED
#: A task with fewer masked words than this goes over them again, up to LEAST_STEPS steps.
ENOUGH = 250_000
#: Training in a task: words of a batch, share of the words that are masked, steps at least, rate, and blocks of weights.
BATCH, MASKED, LEAST_STEPS, RATE, BLOCKS = 8_192, 1 / 8, 120, 0.004, 16


@dataclass
class Symbols:
    """Word -> symbol. Symbol 0 stands beyond both ends of a text."""

    frequent: list[str]

    def __post_init__(self) -> None:
        self.known = {w: EDGE + i for i, w in enumerate(self.frequent)}

    def cache(self) -> _Cache:
        return _Cache(self.known, HASHED, EDGE + FREQUENT)


class _Cache(dict):
    """word -> symbol, hashed by its ending where it is not known; goes back to the frequent words when full, which costs time and changes nothing."""

    def __init__(self, known: dict[str, int], hashed: int, least: int) -> None:
        super().__init__(known)
        self.first, self.hashed, self.least = known, hashed, least

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
            self.update(self.first)
        self[word] = symbol = self.least + _ending(word) % self.hashed
        return symbol


@lru_cache(100_000)
def _crc(tail: str) -> int:
    return zlib.crc32(tail.lower().encode("utf-8", "replace"))


def _ending(word: str) -> int:
    return _crc(word[-2:] + "+" if len(word) > 8 else word[-2:])


@dataclass
class Contexts:
    """Word -> context symbol. The class of a symbol's words is known from the symbol."""

    frequent: list[str]
    symbols: Symbols

    def __post_init__(self) -> None:
        self.known = {w: EDGE + i for i, w in enumerate(self.frequent)}

    def of(self, word: str) -> int:
        found = self.known.get(word)
        return EDGE + CONTEXT_WORDS + _ending(word) % CONTEXT_HASHED if found is None else found

    def cache(self) -> _Cache:
        return _Cache(self.known, CONTEXT_HASHED, EDGE + CONTEXT_WORDS)

    def classes(self) -> np.ndarray:
        """The class of each context symbol."""
        out = np.zeros(CONTEXTS, np.int64)
        cache = self.symbols.cache()
        out[EDGE : EDGE + len(self.frequent)] = [cache[w] for w in self.frequent]
        out[EDGE + CONTEXT_WORDS :] = EDGE + FREQUENT + np.arange(CONTEXT_HASHED) % HASHED
        return out


def frequent_words(docs: DataFrame, text_col: str = "text", most: int = FREQUENT) -> list[str]:
    """The corpus's most frequent words, ties in the order of the word; counted over every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"word": list(counts.keys()), "n": list(counts.values())}, schema=pa.schema([("word", pa.string()), ("n", pa.int64())]))
            counts.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update((text or "").split())
                if len(counts) > 400_000:
                    yield flush()
        yield flush()

    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r["word"] for r in counted.orderBy(F.desc("n"), "word").limit(most).collect()]


def _codes(text: str | None, cache: dict, kind: type = np.int64) -> np.ndarray:
    """A text's symbols with the edge symbol at either end."""
    words = (text or "").split()
    out = np.zeros(len(words) + 2, kind)
    out[1:-1] = np.fromiter(map(cache.__getitem__, words), kind, len(words))
    return out


def coded(docs: DataFrame, contexts: Contexts, text_col: str = "text") -> DataFrame:
    """(codes): each text's context symbols between two edges, two bytes a symbol, in the order and partitions of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = contexts.cache()
        for batch in batches:
            rows = [_codes(t, cache, np.int16).tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["codes"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "codes binary")


def _laid(rows: list[bytes]) -> np.ndarray:
    """Rows of coded(), end to end."""
    return np.frombuffer(b"".join(rows), np.int16)


def window_counts(docs: DataFrame, symbols: Symbols, text_col: str = "text") -> np.ndarray:
    """Counts [left, right, masked] over every word of every document; SYMBOLS cubed cells, whatever the corpus."""

    def classes() -> Callable[[list], np.ndarray]:
        cache = symbols.cache()
        return lambda texts: np.concatenate([_codes(t, cache) for t in texts])

    return _window_counts(docs.select(F.col(text_col).cast("string").alias("text")), classes)


def coded_window_counts(rows: DataFrame, contexts: Contexts) -> np.ndarray:
    """window_counts() of the documents of coded()."""
    own = contexts.classes()
    return _window_counts(rows, lambda: lambda codes: own[_laid(codes)])


def _window_counts(docs: DataFrame, classes: Callable[[], Callable[[list], np.ndarray]]) -> np.ndarray:
    """docs(one column); classes() makes what lays a task's values end to end as classes between edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lay, total = classes(), np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            values = batch.column(0).to_pylist()
            for i in range(0, len(values), 2048):
                # Windows whose middle is an edge are no word's.
                flat = lay(values[i : i + 2048])
                cell = (flat[:-2] * SYMBOLS + flat[2:]) * SYMBOLS + flat[1:-1]
                total += np.bincount(cell[flat[1:-1] > 0], minlength=SYMBOLS**3)
        blocks = total.reshape(SYMBOLS, -1)
        for left in range(SYMBOLS):
            at = np.flatnonzero(blocks[left])
            if at.size:
                row = {"left": [left], "at": [at.astype(np.int32).tobytes()], "n": [blocks[left][at].astype(np.int64).tobytes()]}
                yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("left", pa.int32()), ("at", pa.binary()), ("n", pa.binary())]))

    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for part in parts:
            for left, at, n in zip(part["left"], part["at"], part["n"], strict=True):
                block = sums.setdefault(int(left), np.zeros(SYMBOLS**2, np.int64))
                block[np.frombuffer(at, np.int32)] += np.frombuffer(n, np.int64)
        for left, block in sums.items():
            yield pd.DataFrame({"left": [left], "n": [block.tobytes()]})

    gathered = docs.mapInArrow(run, "left int, at binary, n binary")
    # Any task may hold several blocks or part of one: sums are added up once more on the driver.
    counts = np.zeros((SYMBOLS, SYMBOLS * SYMBOLS), np.int64)
    for r in gathered.repartition("left").mapInPandas(add, "left int, n binary").toLocalIterator():
        counts[r["left"]] += np.frombuffer(r["n"], np.int64)
    return counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


@dataclass
class Network:
    left: np.ndarray
    right: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def hidden(self, contexts: np.ndarray) -> np.ndarray:
        return np.tanh(self.left[contexts // SYMBOLS] + self.right[contexts % SYMBOLS] + self.bias)

    def log_probabilities(self, contexts: np.ndarray) -> np.ndarray:
        """Rows of log-probabilities of the masked symbol, one for each context left * SYMBOLS + right."""
        z = self.hidden(contexts) @ self.out + self.out_bias
        z[:, 0] = -np.inf  # the edge is never masked
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def table(self) -> np.ndarray:
        """All log-probabilities, [left, right, masked]."""
        parts = [self.log_probabilities(np.arange(a, min(a + 2048, SYMBOLS**2))) for a in range(0, SYMBOLS**2, 2048)]
        return np.concatenate(parts).astype(np.float32).reshape(SYMBOLS, SYMBOLS, SYMBOLS)


def train(counts: np.ndarray, width: int = 24, rounds: int = 60, rate: float = 0.05, seed: int = 5) -> Network:
    """Adam on the mean negative log-likelihood of the counted windows, in minibatches of contexts."""
    rng = np.random.default_rng(seed)
    by_context = counts.reshape(-1, SYMBOLS)
    weights = by_context.sum(1)
    contexts = np.flatnonzero(weights)
    theta = [rng.normal(0, 0.1, (SYMBOLS, width)), rng.normal(0, 0.1, (SYMBOLS, width)), np.zeros(width), rng.normal(0, 0.1, (width, SYMBOLS)), np.zeros(SYMBOLS)]
    theta = [t.astype(np.float32) for t in theta]
    total = weights.sum()
    if not total:
        return Network(*theta)
    theta[4][:] = np.log((by_context.sum(0) + 1) / (total + SYMBOLS))
    first, second, step = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta], 0
    for round_ in range(rounds):
        order = rng.permutation(contexts)
        parts = max(1, len(order) // 2048)
        for own in np.array_split(order, parts):
            net = Network(*theta)
            h, n = net.hidden(own), by_context[own].astype(np.float32)
            scale = np.float32(parts / total)
            p = np.exp(net.log_probabilities(own))
            e = (p * n.sum(1, keepdims=True) - n) * scale
            back = (e @ theta[3].T) * (1 - h * h)
            grads = [np.zeros_like(theta[0]), np.zeros_like(theta[1]), back.sum(0), h.T @ e, e.sum(0)]
            np.add.at(grads[0], own // SYMBOLS, back)
            np.add.at(grads[1], own % SYMBOLS, back)
            step += 1
            lr = rate * (1 - round_ / rounds) * (1 - 0.99**step) ** 0.5 / (1 - 0.9**step)
            for t, g, m, s in zip(theta, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                t -= (lr * m / (np.sqrt(s) + 1e-7)).astype(np.float32)
    return Network(*theta)


def score(docs: DataFrame, symbols: Symbols, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, log_likelihood (the sum), per_word (its mean; null without words) of the symbols of every row of docs.

    Null, empty and blank texts have no words and a sum of 0. Repeated rows each give a row, null ids stay null, and an
    empty table gives an empty result. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast((symbols, network.table().ravel()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table = shared.value
        cache = own.cache()
        for batch in batches:
            sums, sizes = [], []
            for text in batch.column(1).to_pylist():
                c = _codes(text, cache)
                sums.append(float(table[(c[:-2] * SYMBOLS + c[2:]) * SYMBOLS + c[1:-1]].sum(dtype=np.float64)))
                sizes.append(len(c) - 2)
            per = [s / n if n else None for s, n in zip(sums, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(sums, pa.float64()), pa.array(per, pa.float64())], names=["doc_id", "n_words", "log_likelihood", "per_word"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, log_likelihood double, per_word double")


@dataclass
class Wide:
    """The whole network: embeddings by place and context symbol, and the layer that gives classes."""

    places: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def start(cls, near: Network, contexts: Contexts) -> Wide:
        """The nearest places as trained on classes, the others without a say."""
        own, none = contexts.classes(), np.zeros((CONTEXTS, near.left.shape[1]), np.float32)
        return cls(np.stack((none, near.left[own], near.right[own], none)).astype(np.float32), near.bias.copy(), near.out.copy(), near.out_bias.copy())

    def parts(self) -> list[np.ndarray]:
        return [self.places, self.bias, self.out, self.out_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def like(self, flat: np.ndarray) -> Wide:
        """A network of this one's shape with the weights of flat."""
        ends = np.cumsum([p.size for p in self.parts()])
        return Wide(*(x.reshape(p.shape).astype(np.float32) for x, p in zip(np.split(flat, ends[:-1]), self.parts(), strict=True)))

    def hidden(self, windows: np.ndarray) -> np.ndarray:
        total = np.take(self.places[0], windows[:, 0], axis=0)
        for place in range(1, PLACES):
            total += np.take(self.places[place], windows[:, place], axis=0)
        total += self.bias
        return np.tanh(total, out=total)

    def log_probabilities(self, hidden: np.ndarray) -> np.ndarray:
        z = hidden @ self.out + self.out_bias
        z[:, 0] = -np.inf  # the edge is never masked
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def score(self, windows: np.ndarray, masked: np.ndarray) -> np.ndarray:
        """Log-probability of each window's masked class."""
        out, layer = np.empty(len(masked), np.float64), np.vstack((self.out, self.out_bias))[:, 1:]  # the edge is never masked
        # Unless weights are that large, no exponential can overflow and none need be scaled first.
        plain = float(np.abs(layer).sum(0).max()) < 60
        ones = np.ones(layer.shape[1], layer.dtype)
        for at in range(0, len(masked), 2048):  # what fits a cache
            own, rows = masked[at : at + 2048] - 1, windows[at : at + 2048]
            hidden = self.hidden(rows)
            z = np.column_stack((hidden, np.ones(len(rows), hidden.dtype))) @ layer
            if not plain:
                z -= z.max(1, keepdims=True)
            got = z[np.arange(len(rows)), own]
            out[at : at + 2048] = got - np.log(np.exp(z, out=z) @ ones)
        return out


def _windows(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The four neighbours of the symbols after places at, of texts laid end to end, each between two edges."""
    wide = np.concatenate((np.zeros(1, flat.dtype), flat, np.zeros(1, flat.dtype)))
    return np.stack((wide[at], wide[at + 1], wide[at + 3], wide[at + 4]), axis=1)


class _Adam:
    def __init__(self, net: Wide) -> None:
        self.net, self.step = net, 0
        self.first, self.second = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()]

    def learn(self, windows: np.ndarray, masked: np.ndarray) -> None:
        net = self.net
        h = net.hidden(windows)
        e = np.exp(net.log_probabilities(h))
        e[np.arange(len(masked)), masked] -= 1
        e /= len(masked)
        back = (e @ net.out.T) * (1 - h * h)
        places = np.empty_like(net.places)
        for place in range(PLACES):
            for d in range(back.shape[1]):
                places[place, :, d] = np.bincount(windows[:, place], back[:, d], CONTEXTS)
        self.step += 1
        rate = RATE * (1 - 0.99**self.step) ** 0.5 / (1 - 0.9**self.step)
        for t, g, m, s in zip(net.parts(), (places, back.sum(0), h.T @ e, e.sum(0)), self.first, self.second, strict=True):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            t -= (rate * m / (np.sqrt(s) + 1e-7)).astype(np.float32)


def refine(rows: DataFrame, contexts: Contexts, start: Wide, seed: int = 5) -> Wide:
    """start, trained further on every document of coded(): by each task on its own, from the same start, then averaged.

    A task with few words goes over them again until it has made LEAST_STEPS steps or learned ENOUGH words. Weights are added up by blocks, so
    that the driver gets them once, however many tasks there are.
    """
    shared = rows.sparkSession.sparkContext.broadcast((contexts.classes(), start))

    def train_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, first = shared.value
        rng = np.random.default_rng((seed, TaskContext.get().partitionId()))
        adam, held, seen, kept = _Adam(first.like(first.flat())), [], 0, []

        def learn(rows: np.ndarray) -> None:
            adam.learn(rows[:, :PLACES], rows[:, PLACES])
            if len(kept) < LEAST_STEPS:
                kept.append(rows.astype(np.int16))

        for batch in batches:
            codes = batch.column(0).to_pylist()
            for i in range(0, len(codes), 1024):
                flat = _laid(codes[i : i + 1024])
                chosen = np.flatnonzero((flat[1:-1] > 0) & (rng.random(flat.size - 2) < MASKED))
                if chosen.size:
                    held.append(np.column_stack((_windows(flat, chosen), classes[flat[chosen + 1]])))
                if sum(map(len, held)) >= BATCH:
                    rows = np.concatenate(held)
                    for at in range(0, len(rows) - BATCH + 1, BATCH):
                        learn(rows[at : at + BATCH])
                        seen += BATCH
                    held = [rows[len(rows) // BATCH * BATCH :]]
        rest = np.concatenate(held) if held else np.empty((0, PLACES + 1), np.int64)
        if len(rest):
            learn(rest)
            seen += len(rest)
        again, learned = 0, seen
        while kept and adam.step < LEAST_STEPS and learned < ENOUGH:
            rows = kept[again % len(kept)].astype(np.int64)
            adam.learn(rows[:, :PLACES], rows[:, PLACES])
            again, learned = again + 1, learned + len(rows)
        for block, weights in enumerate(np.array_split(adam.net.flat(), BLOCKS) if seen else ()):
            yield pa.RecordBatch.from_pylist([{"block": block, "n": seen, "w": weights.tobytes()}], schema=pa.schema([("block", pa.int32()), ("n", pa.int64()), ("w", pa.binary())]))

    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, tuple[int, np.ndarray]] = {}
        for part in parts:
            for block, n, w in zip(part["block"], part["n"], part["w"], strict=True):
                total, before = sums.get(int(block), (0, 0.0))
                sums[int(block)] = total + int(n), before + int(n) * np.frombuffer(w, np.float32).astype(np.float64)
        for block, (n, w) in sums.items():
            yield pd.DataFrame({"block": [block], "n": [n], "w": [w.tobytes()]})

    trained = rows.mapInArrow(train_own, "block int, n long, w binary")
    sums: dict[int, list] = {}
    for r in trained.repartition("block").mapInPandas(add, "block int, n long, w binary").toLocalIterator():
        own = sums.setdefault(r["block"], [0, 0.0])
        own[0] += r["n"]
        own[1] = own[1] + np.frombuffer(r["w"], np.float64)
    if not sums:
        return start
    return start.like(np.concatenate([sums[block][1] / sums[block][0] for block in range(BLOCKS)]))


class _Words(dict):
    """word -> number within a task, with the context symbol and hash of each number; number 0 is the edge."""

    def __init__(self, contexts: Contexts) -> None:
        super().__init__()
        self.contexts = contexts
        self.context, self.hash = array("i", [0]), array("Q", [0])

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self.context)
        self.context.append(self.contexts.of(word))
        self.hash.append(xxhash.xxh64_intdigest(word.encode("utf-8", "replace")))
        return number

    def forget(self) -> None:
        self.clear()
        del self.context[1:], self.hash[1:]


_NONE = np.zeros(1, np.int64)
_DEALT = "route int, chunk long, docs binary, words binary, n binary, ids array<long>"
_DEALT_ARROW = pa.schema([("route", pa.int32()), ("chunk", pa.int64()), ("docs", pa.binary()), ("words", pa.binary()), ("n", pa.binary()), ("ids", pa.list_(pa.int64()))])
_SUMMED = "chunk long, docs binary, sums binary, ids array<long>"
_SUMMED_ARROW = pa.schema([("chunk", pa.int64()), ("docs", pa.binary()), ("sums", pa.binary()), ("ids", pa.list_(pa.int64()))])


def score_words(docs: DataFrame, contexts: Contexts, network: Wide, totals: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As score(), of the words themselves: a word that shares its class adds log(its count in docs / totals[class]).

    totals holds the words of docs by class. Words are dealt out by a 64-bit hash, which stands for the word; each
    partition counts its own words and sends each chunk of documents the sums of their logarithms.
    """
    width = shuffle_width(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((contexts, network, np.log(np.maximum(totals, 1))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, net, log_totals = shared.value
        own, classes, chunk = _Words(known), known.classes(), TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0

        def flush() -> pa.RecordBatch:
            sizes = np.array([len(t) for t in texts], np.int64)
            flat = np.concatenate([x for t in texts for x in (_NONE, t, _NONE)])
            context, word_hash = np.array(own.context)[flat], np.array(own.hash)
            doc, number, middle = np.repeat(np.arange(len(texts)), sizes + 2)[1:-1], flat[1:-1], classes[context[1:-1]]
            gain, words_at = np.zeros(len(middle)), np.flatnonzero(middle)
            gain[words_at] = net.score(_windows(context, words_at), middle[words_at])
            shares = middle >= EDGE + FREQUENT
            gain[shares] -= log_totals[middle[shares]]
            base = np.bincount(doc, gain, len(texts))
            pair, n = np.unique(doc[shares] * len(own.context) + number[shares], return_counts=True)
            at, words = pair // len(own.context), word_hash[pair % len(own.context)]
            # Two bytes are sorted by radix.
            route = (words % np.uint64(width)).astype(np.uint16 if width <= 1 << 16 else np.int64)
            order = np.argsort(route, kind="stable")
            used, starts = np.unique(route[order], return_index=True)
            cuts = [np.split(x[order], starts[1:]) if used.size else [] for x in (at.astype(np.int32), words, n.astype(np.int32))]
            blocks = [[x.tobytes() for x in c] for c in cuts]
            # The documents themselves go along in a row that has their ids.
            rows = [[*used.tolist(), chunk % width], [chunk] * (used.size + 1), [*blocks[0], sizes.tobytes()], [*blocks[1], base.tobytes()], [*blocks[2], b""], [None] * used.size + [list(ids)]]
            ids.clear(), texts.clear()
            if len(own) > 400_000:
                own.forget()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _DEALT_ARROW, strict=True)], schema=_DEALT_ARROW)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = (text or "").split()
                ids.append(doc_id)
                texts.append(np.fromiter(map(own.__getitem__, words), np.int64, len(words)))
                size += len(words)
                if size >= CHUNK_WORDS or len(ids) >= CHUNK_DOCS:
                    yield flush()
                    chunk, size = chunk + 1, 0
        if ids:
            yield flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, docs_of, words, n = [], [], [], []
        for batch in batches:
            for row in batch.to_pylist():
                if row["ids"] is not None:
                    yield pa.RecordBatch.from_pylist([{"chunk": row["chunk"], "docs": row["docs"], "sums": row["words"], "ids": row["ids"]}], _SUMMED_ARROW)
                    continue
                chunks.append(row["chunk"])
                docs_of.append(np.frombuffer(row["docs"], np.int32))
                words.append(np.frombuffer(row["words"], np.uint64))
                n.append(np.frombuffer(row["n"], np.int32))
        if not chunks:
            return
        _, word = np.unique(np.concatenate(words), return_inverse=True)
        times = np.concatenate(n)
        weight = np.round(np.log(np.bincount(word, times)) * _FINE).astype(np.int64)
        value, at = times * weight[word], 0
        for chunk, doc in zip(chunks, docs_of, strict=True):
            # Documents ascend in a block.
            starts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
            sums = np.add.reduceat(value[at : at + len(doc)], starts)
            at += len(doc)
            yield pa.RecordBatch.from_pylist([{"chunk": chunk, "docs": doc[starts].tobytes(), "sums": sums.tobytes(), "ids": None}], _SUMMED_ARROW)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, sums = {}, {}
        for batch in batches:
            for row in batch.to_pylist():
                chunk = row["chunk"]
                if row["ids"] is not None:
                    heads[chunk] = (row["ids"], np.frombuffer(row["docs"], np.int64), np.frombuffer(row["sums"], np.float64))
                    continue
                own = sums.setdefault(chunk, np.zeros(CHUNK_DOCS, np.int64))
                own[np.frombuffer(row["docs"], np.int32)] += np.frombuffer(row["sums"], np.int64)
        for chunk, (ids, sizes, base) in heads.items():
            total = base + sums[chunk][: len(ids)] / _FINE if chunk in sums else base
            per = [s / n if n else None for s, n in zip(total.tolist(), sizes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes), pa.array(total), pa.array(per, pa.float64())], names=["doc_id", "n_words", "log_likelihood", "per_word"])

    dealt = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(deal, _DEALT)
    summed = dealt.repartition(width, "route").mapInArrow(count, _SUMMED)
    return summed.repartition(width, "chunk").mapInArrow(add, "doc_id long, n_words long, log_likelihood double, per_word double")


def fit(docs: DataFrame, text_col: str = "text") -> tuple[Contexts, Wide, np.ndarray]:
    """(words' symbols, network, words by class) of docs."""
    frequent = frequent_words(docs, text_col, CONTEXT_WORDS)
    contexts = Contexts(frequent, Symbols(frequent[:FREQUENT]))
    rows = cut(coded(docs, contexts, text_col))  # training reads words once, then two bytes for each
    counts = coded_window_counts(rows, contexts)
    return contexts, refine(rows, contexts, Wide.start(train(counts), contexts)), counts.sum((0, 1))


def masked_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Count, train and score on the same documents."""
    contexts, network, totals = fit(docs, text_col)
    release(docs.sparkSession)
    return score_words(docs, contexts, network, totals, id_col, text_col)
