"""Toxicity by a weighted finite-state pattern grammar.

Five weighted transducers are composed and run over the words of a clause:

* lexicon: letters -> INSULT, THREAT, TARGET, NEGATION, REPORT, BREAK or OTHER. Its insult part is an acceptor over
  letters with weights learned from labelled documents: whole words, and stems where several inflected forms share one;
* negation: an insult or threat in the few words after a negation becomes a negated one, up to a break;
* report: one after a verb of speech becomes a reported one, up to a break that is not the verb's own comma;
* target: an insult in a clause that also names a person, before or after it, becomes an aimed one; a threat only where
  no break lies between them;
* outcome: keeps the strongest outcome of the clause.

A break is a comma or a conjunction; a clause ends at a full stop, colon, semicolon or line end. Arcs have weights, which
add up along a path and under composition: being negated or reported lowers what a clause weighs, being aimed raises it.
A clause weighs its strongest word's lexical weight and its path's.

A document's features say how many of its clauses ended in each outcome and how much the heaviest of each weighed. They
are weighed by a logistic model whose weights start from, and are pulled to, stated priors, so that an outcome that no
labelled row shows keeps its prior.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._common import cut, fold, keep_rows
from textloom.llm.labels import training_rows

OTHER, TARGET, NEGATION, REPORT, INSULT, THREAT, BREAK = range(7)
PLAIN, AIMED, NEGATED, REPORTED, THREATENED, THREAT_AIMED = range(6)
#: Flags beside the symbol: the clause ends after the word, or a comma follows it.
_CLAUSE_END, _COMMA = 8, 16
#: Weights of arcs, in the lexicon's log odds.
NEGATED_WEIGHT, REPORTED_WEIGHT, AIMED_WEIGHT = -2.0, -1.5, 1.0

#: Closed-class words of the four languages, known without labels.
_WORDS = {
    TARGET: "you your yours yourself u he she him her they them du dich dir ihr euch er sie tu toi te vous il elle eux ils tú ti usted ustedes él ella ellos",
    NEGATION: "not never no isn't aren't wasn't don't nicht kein keine keinen nie pas jamais aucun nunca ningún ninguna tampoco",
    REPORT: "said says say told claimed claims wrote called reported according quoted sagte sagt schrieb nannte laut dit disait écrit appelé selon dijo dice escribió llamó según",
    BREAK: "and but or because so und aber oder weil denn et mais ou car donc y e pero o porque",
    THREAT: "kill murder strangle stab shoot slaughter umbringen töten erschießen tuer égorger matar apuñalar disparar",
}
_SEED_INSULTS = "idiot moron stupid worthless pathetic scum imbecile dumbass blödmann vollidiot connard abruti pendejo imbécil"
SEED_WEIGHT = 3.0
NEGATION_REACH = 3
MIN_STEM, MAX_STEM = 4, 8

_EDGE = re.compile(r"^\W+|\W+$")
_GAP = re.compile(r"[^\w']+")
_STOP, _PAUSE = re.compile(r"[.!?;:]\W*$"), re.compile(r",\W*$")


class Transducer:
    """Deterministic weighted transducer: arcs[(state, symbol)] = (state, symbol out, weight)."""

    def __init__(self, start: int, states: int, arc) -> None:
        self.start, self.states = start, states
        self.arcs = {(s, x): arc(s, x) for s in range(states) for x in _ALPHABET}

    def compose(self, after: Transducer) -> Transducer:
        """The transducer that feeds this one's output to the next, over pairs of states; weights add up."""
        n = after.states

        def arc(state: int, symbol) -> tuple:
            to, out, weight = self.arcs[state // n, symbol]
            then, last, more = after.arcs[state % n, out]
            return to * n + then, last, weight + more

        return Transducer(self.start * n + after.start, self.states * n, arc)


#: Symbols between transducers: a word class and, for an insult or threat, whether it is negated or reported.
_ALPHABET = [(c, m) for c in range(7) for m in (("", "n", "r", "nr") if c in (INSULT, THREAT) else ("",))]


def _negate(state: int, symbol: tuple) -> tuple:
    """state: words that a negation still reaches."""
    kind, mark = symbol
    if kind == NEGATION:
        return NEGATION_REACH, symbol, 0.0
    if kind == BREAK:
        return 0, symbol, 0.0
    if kind in (INSULT, THREAT) and state and "n" not in mark:
        return state - 1, (kind, "n" + mark), NEGATED_WEIGHT
    return max(0, state - 1), symbol, 0.0


def _report(state: int, symbol: tuple) -> tuple:
    """state: 2 right after a verb of speech, 1 further on in what it reports."""
    kind, mark = symbol
    if kind == REPORT:
        return 2, symbol, 0.0
    if kind == BREAK:
        return (1 if state == 2 else 0), symbol, 0.0
    if kind in (INSULT, THREAT) and state and "r" not in mark:
        return 1, (kind, mark + "r"), REPORTED_WEIGHT
    return min(state, 1), symbol, 0.0


#: Ranks of what a clause's hits came to.
_RANK = {(INSULT, "nr"): 1, (INSULT, "r"): 1, (THREAT, "nr"): 1, (THREAT, "r"): 1, (THREAT, "n"): 2, (INSULT, "n"): 2, (INSULT, ""): 3, (THREAT, ""): 4}
_AIM_STATES = 6 * 8


def _aim(state: int, symbol: tuple) -> tuple:
    """state: rank * 8, and flags: 1 a target since the last break, 2 a target at all, 4 a bare threat since the last break."""
    kind, mark = symbol
    rank, here, ever, threat = state >> 3, state & 1, state >> 1 & 1, state >> 2 & 1
    was = rank >= 5 or rank == 3 and bool(ever)
    if kind == BREAK:
        here = threat = 0
    elif kind == TARGET:
        here = ever = 1
    elif kind in (INSULT, THREAT):
        rank = max(rank, _RANK[kind, mark])
        threat |= kind == THREAT and not mark
    if here and threat:
        rank = 5
    aimed = rank >= 5 or rank == 3 and bool(ever)
    return rank << 3 | threat << 2 | ever << 1 | here, symbol, AIMED_WEIGHT if aimed and not was else 0.0


def _outcome(state: int) -> int:
    """Outcome of a clause that ended in a state of _aim."""
    return (PLAIN, REPORTED, NEGATED, AIMED if state >> 1 & 1 else PLAIN, THREATENED, THREAT_AIMED)[state >> 3]


GRAMMAR = Transducer(0, NEGATION_REACH + 1, _negate).compose(Transducer(0, 3, _report)).compose(Transducer(0, _AIM_STATES, _aim))
_STEP = {(s, x[0]): (to, weight) for (s, x), (to, _, weight) in GRAMMAR.arcs.items() if x[1] == ""}
_ENDS = [_outcome(s % _AIM_STATES) for s in range(GRAMMAR.states)]
#: A path counts for so much at most, however many hits its clause has, and a clause with a hit weighs something.
MOST_PATH, LEAST_CLAUSE = 3.0, 0.1


@dataclass
class Lexicon:
    """Letters -> symbol and weight. words and stems hold the learned insults' weights."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.closed = {w: kind for kind, ws in _WORDS.items() for w in ws.split()}
        self.seeds = set(_SEED_INSULTS.split())

    def word(self, word: str) -> tuple[int, float]:
        weight = self.words.get(word, 0.0)
        for n in range(MIN_STEM, min(MAX_STEM, len(word)) + 1):
            weight = max(weight, self.stems.get(word[:n], 0.0))
        if word in self.seeds:
            weight = max(weight, SEED_WEIGHT)
        if weight > 0:
            return INSULT, weight
        kind = self.closed.get(word, OTHER)
        return kind, SEED_WEIGHT if kind == THREAT else 0.0

    def token(self, token: str) -> tuple[int, float]:
        """Symbol (with its flags) and weight of a white-space token, in any case, with any punctuation.

        Of a token of several words the weightiest counts, then the one with a class of its own.
        """
        parts = [self.word(p) for p in _GAP.split(_EDGE.sub("", token)) if p] or [(OTHER, 0.0)]
        kind, weight = max(parts, key=lambda p: (p[1] > 0, p[0] if p[0] != BREAK or len(parts) == 1 else OTHER, p[1]))
        return kind | (_CLAUSE_END if _STOP.search(token) else _COMMA if _PAUSE.search(token) else 0), weight


class _Cache(dict):
    """token -> (symbol, weight); emptied when full, which costs time and changes nothing."""

    def __init__(self, lexicon: Lexicon, most: int = 300_000) -> None:
        super().__init__()
        self.lexicon, self.most = lexicon, most

    def __missing__(self, token: str) -> tuple[int, float]:
        if len(self) >= self.most:
            self.clear()
        self[token] = found = self.lexicon.token(token)
        return found


FEATURES = 12  # of each outcome: log of 1 + the clauses that ended in it, and the weight of the heaviest


def clauses(line: list[tuple[int, float]]) -> Iterator[tuple[int, float]]:
    """(outcome, weight) of each clause of a line's tokens that has an insult or a threat."""
    state, path, word = GRAMMAR.start, 0.0, 0.0
    for symbol, w in [*line, (_CLAUSE_END, 0.0)]:
        state, more = _STEP[state, symbol & 7]
        path += more
        if w > word:
            word = w
        if symbol & _COMMA:
            state, more = _STEP[state, BREAK]
            path += more
        elif symbol & _CLAUSE_END:
            if word:
                yield _ENDS[state], max(LEAST_CLAUSE, word + max(-MOST_PATH, min(MOST_PATH, path)))
            state, path, word = GRAMMAR.start, 0.0, 0.0


def features(text: str | None, cache: dict) -> list[float]:
    """The text's features: what the composed grammar gives for each clause that has an insult or a threat."""
    counts, most = [0] * 6, [0.0] * 6
    for line in (text or "").lower().split("\n"):
        found = [cache[t] for t in line.split()]
        if not any(x[1] for x in found):
            continue
        for end, weight in clauses(found):
            counts[end] += 1
            most[end] = max(most[end], weight)
    return [math.log1p(c) for c in counts] + most


#: Prior weights of the features; the last is the intercept.
PRIOR = np.array([0.5, 0.8, 0.1, 0.1, 0.5, 1.0, 1.0, 1.2, 0.4, 0.4, 1.0, 1.4, -2.5])


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray = PRIOR, pull: float = 2.0) -> np.ndarray:
    """Logistic weights by Newton steps, pulled to the prior; the prior itself without rows of both labels."""
    w = prior.copy()
    if not len(y) or y.min() == y.max():
        return w
    x = np.hstack([x, np.ones((len(x), 1))])
    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float(np.logaddexp(0, z).sum() - y @ z + pull / 2 * ((v - prior) ** 2).sum())

    now = loss(w)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + pull * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w)), slope)
        while (then := loss(w - step)) > now and np.abs(step).max() > 1e-9:  # a full step can overshoot
            step /= 2
        w, now = w - step, min(now, then)
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray

    def score(self, rows: list[list[float]]) -> np.ndarray:
        z = np.array(rows, float).reshape(-1, FEATURES) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def _word_counts(rows: DataFrame) -> DataFrame:
    """(kind, piece, pos, neg, forms): documents with each word ('w') or stem ('s') by label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = {_EDGE.sub("", t) for t in set(text.lower().split())}
                counts[1 if y > 0 else 0].update({w for t in tokens for w in _GAP.split(t) if len(w) > 1 and len(w) <= 40})
        keys = list(counts[0].keys() | counts[1].keys())
        for i in range(0, len(keys), 50_000):
            some = keys[i : i + 50_000]
            yield pa.RecordBatch.from_pydict({"word": some, "pos": [counts[1][k] for k in some], "neg": [counts[0][k] for k in some]})

    return rows.select("text", "y").mapInArrow(run, "word string, pos long, neg long").groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


MIN_SUPPORT, MIN_ODDS, MIN_FORMS, MAX_WEIGHT = 3, 3.0, 3, 6.0
MAX_CHANCE = 0.01


def one_of_each_copy(rows: DataFrame) -> DataFrame:
    """rows without its copies, so that a text copied often doesn't make its words look toxic.

    Near copies are told by their least shingle hash, which two texts share as often as their shingles coincide; rows
    are bounded by the sample, and so are the ids that are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for text in batch.column(1).to_pylist():
                words = text.lower().split()
                keys.append(min((zlib.crc32(" ".join(words[i : i + 3]).encode("utf-8", "replace")) for i in range(max(1, len(words) - 2))), default=0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), batch.column(2)], names=["doc_id", "least", "y"])

    keyed = rows.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, least long, y int")
    kept = keyed.groupBy("least", F.col("y") > 0).agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    return rows.join(F.broadcast(kept), "doc_id")


def learn_lexicon(rows: DataFrame, n_pos: int, n_neg: int) -> Lexicon:
    """Insult words and stems: seen in MIN_SUPPORT toxic documents, with log odds of MIN_ODDS at least.

    Of all that are learned, MAX_CHANCE is expected to be so by chance. A stem needs MIN_FORMS different words besides. The shortest stems that qualify are kept.
    """
    counts = _word_counts(rows).persist()
    odds = F.log((F.col("pos") + 0.5) / (n_pos + 1.0)) - F.log((F.col("neg") + 0.5) / (n_neg + 1.0))
    # Chernoff's bound of the chance that a word without any bearing falls so on toxic documents, against all words tried.
    total, share, rate = F.col("pos") + F.col("neg"), F.col("pos") / (F.col("pos") + F.col("neg")), n_pos / (n_pos + n_neg)
    excess = total * (share * F.log(share / rate) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - rate))).otherwise(0.0))
    sure = excess >= math.log(max(1, counts.count()) / MAX_CHANCE)
    words = counts.withColumn("odds", odds).filter((F.col("pos") >= MIN_SUPPORT) & (F.col("odds") >= MIN_ODDS)).filter(sure)
    stems = (
        counts.select(F.explode(F.transform(F.sequence(F.lit(MIN_STEM), F.lit(MAX_STEM)), lambda n: F.when(F.length("word") >= n, F.substring(F.col("word"), F.lit(1), n)))).alias("stem"), "pos", "neg")
        .filter("stem IS NOT NULL")
        .groupBy("stem")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.count_if(F.col("pos") > 0).alias("forms"))
        .withColumn("odds", odds)
        .filter((F.col("pos") >= 2 * MIN_SUPPORT) & (F.col("forms") >= MIN_FORMS) & (F.col("odds") >= MIN_ODDS + 0.5))
        .filter(sure)
    )
    # Both are bounded by the labelled sample: a piece needs MIN_SUPPORT of its toxic documents.
    lexicon = Lexicon({r["word"]: min(MAX_WEIGHT, r["odds"]) for r in words.collect()})
    for r in sorted(stems.collect(), key=lambda r: (len(r["stem"]), r["stem"])):
        if not any(r["stem"][:n] in lexicon.stems for n in range(MIN_STEM, len(r["stem"]))):
            lexicon.stems[r["stem"]] = min(MAX_WEIGHT, r["odds"])
    counts.unpersist()
    return lexicon


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_parts: int = 5, held_fold: int = 0, max_rows: int = 50_000) -> Model:
    """Learn the lexicon and the outcome weights from at most max_rows labelled rows outside the held-out fold."""
    rows = cut(one_of_each_copy(cut(training_rows(docs, labels, "toxic", id_col, text_col, held_parts, held_fold, max_rows))))
    sizes = {r["y"]: r["n"] for r in rows.groupBy((F.col("y") > 0).alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_neg = sizes.get(True, 0), sizes.get(False, 0)
    lexicon = learn_lexicon(rows, n_pos, n_neg) if n_pos and n_neg else Lexicon()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Cache(lexicon)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"x": [features(t, cache) for t in batch.column(0).to_pylist()], "y": batch.column(1)})

    got = rows.select("text", "y").mapInArrow(run, "x array<double>, y int").groupBy("x", (F.col("y") > 0).cast("double").alias("y")).count().collect() if n_pos and n_neg else []
    if not got:
        return Model(lexicon, PRIOR.copy())
    x, y, n = np.array([r["x"] for r in got]), np.array([r["y"] for r in got]), np.array([r["count"] for r in got])
    return Model(lexicon, fit_logistic(np.repeat(x, n, axis=0), np.repeat(y, n)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", held_parts: int = 5, held_fold: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Null and empty texts have no clause and get the intercept's score. A null id is never held out. Repeated rows each
    give a row; an empty table gives an empty result. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        cache = _Cache(own.lexicon)
        for batch in batches:
            p = own.score([features(t, cache) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], names=["doc_id", "score"])

    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold("doc_id", held_parts) == held_fold, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Fit on the labels outside the held-out fold, then score every document."""
    return score(docs, fit(docs, labels, **options), **{k: v for k, v in options.items() if k != "max_rows"})


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that score under the threshold, with all columns; nulls and empty texts are scored as in score()."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep():
        cache = _Cache(shared.value.lexicon)
        return lambda texts: (shared.value.score([features(t, cache) for t in texts]) < threshold).tolist()

    return keep_rows(docs, text_col, keep)
