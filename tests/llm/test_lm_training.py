"""What the masked network learns: better than unigrams on held-out text, by a gradient that agrees with differences."""

import random

import numpy as np

from textloom.llm import lm_score


def chain(rng, words):
    """Each word is followed by one of two of its own."""
    out, at = [], 0
    for _ in range(words):
        out.append(f"t{at}")
        at = (at * 2 + rng.randrange(2)) % 40
    return " ".join(out)


def test_gain_over_unigrams_on_held_out_text(spark):
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, chain(rng, 150)) for i in range(240)], "doc_id long, text string")
    learned, held = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")
    symbols = lm_score.Symbols(lm_score.frequent_words(learned))
    seen, unseen = lm_score.window_counts(learned, symbols), lm_score.window_counts(held, symbols)
    table = lm_score.train(seen).table()
    unigram = np.log((seen.sum((0, 1)) + 1) / (seen.sum() + lm_score.SYMBOLS))
    network = (unseen * np.where(unseen > 0, table, 0)).sum() / unseen.sum()
    assert network > (unseen.sum((0, 1)) * unigram).sum() / unseen.sum() + 1.0
    # No model can beat the windows' own frequencies on the text that they were counted on.
    context = seen.sum(2, keepdims=True)
    best = (seen * np.log(np.where(seen > 0, seen / np.maximum(context, 1), 1))).sum() / seen.sum()
    got = (seen * np.where(seen > 0, table, 0)).sum() / seen.sum()
    assert best - 0.25 < got <= best + 1e-6


def test_one_step_goes_downhill_as_differences_say():
    """A first step of training changes each parameter against the sign of the loss's numeric derivative."""
    rng = np.random.default_rng(9)
    counts = np.zeros((lm_score.SYMBOLS,) * 3, np.int64)
    counts[tuple(rng.integers(1, 9, (3, 200)))] = rng.integers(1, 6, 200)

    def loss(net):
        return -(counts * np.where(counts > 0, net.table().astype(np.float64), 0)).sum() / counts.sum()

    start, after = lm_score.train(counts, rounds=0), lm_score.train(counts, rounds=1)
    for name, at in (("out", (3, 4)), ("out", (7, 2)), ("left", (5, 1)), ("right", (2, 6)), ("out_bias", (6,))):
        values, step = getattr(start, name), 3e-2
        values[at] += step
        up = loss(start)
        values[at] -= 2 * step
        down = loss(start)
        values[at] += step
        slope, moved = (up - down) / (2 * step), getattr(after, name)[at] - values[at]
        if abs(slope) > 1e-4:
            assert slope * moved < 0


def test_untrained_and_empty():
    net = lm_score.train(np.zeros((lm_score.SYMBOLS,) * 3, np.int64))
    assert np.allclose(np.exp(net.table().astype(float)).sum(2), 1, atol=1e-4)


def test_the_whole_network_gains_on_the_near_one(spark):
    """Where the second neighbour tells the word, two words on a side are worth more than one."""
    rng = random.Random(10)

    def text(n):
        out = []
        while len(out) < n:
            key = rng.randrange(12)
            out += [f"k{key}", "of", f"v{key}", "and"]
        return " ".join(out)

    docs = spark.createDataFrame([(i, text(160)) for i in range(200)], "doc_id long, text string").repartition(2)
    contexts, wide, _ = lm_score.fit(docs)
    near = lm_score.Wide.start(lm_score.train(lm_score.window_counts(docs, contexts.symbols)), contexts)
    words = text(4000).split()
    read = np.array([0, 0, *map(contexts.of, words), 0, 0])
    windows = np.stack((read[:-4], read[1:-3], read[3:-1], read[4:]), axis=1)
    cache = contexts.symbols.cache()
    masked = np.array([cache[w] for w in words])
    assert wide.score(windows, masked).mean() > near.score(windows, masked).mean() + 0.3


def test_windows_are_the_neighbours():
    rng = np.random.default_rng(11)
    texts = [rng.integers(1, 9, n) for n in (5, 0, 1, 2, 7)]
    flat = np.concatenate([np.concatenate(([0], t, [0])) for t in texts])
    at = np.flatnonzero(flat[1:-1])
    got = lm_score._windows(flat, at)
    want = [tuple(np.concatenate(([0, 0], t, [0, 0]))[[k, k + 1, k + 3, k + 4]]) for t in texts for k in range(len(t))]
    assert [tuple(w) for w in got] == want


def test_gradient_of_the_whole_network():
    rng = np.random.default_rng(12)
    net = lm_score.Wide(*(rng.normal(0, 0.3, shape) for shape in ((4, lm_score.CONTEXTS, 5), 5, (5, lm_score.SYMBOLS), lm_score.SYMBOLS)))
    windows, masked = rng.integers(0, 40, (60, 4)), rng.integers(1, 30, 60)
    adam = lm_score._Adam(net)
    before = [p.copy() for p in net.parts()]
    adam.learn(windows, masked)
    for part, old in zip(net.parts(), before, strict=True):
        part[:] = old
    for part, first in zip(net.parts(), adam.first, strict=True):  # the first moment holds a tenth of the gradient
        for at in rng.permutation(np.flatnonzero(np.abs(first.ravel()) > 1e-5))[:5]:
            sides = []
            for step in (1e-4, -1e-4):
                part.ravel()[at] += step
                sides.append(-net.score(windows, masked).mean())
                part.ravel()[at] -= step
            assert abs((sides[0] - sides[1]) / 2e-4 - 10 * first.ravel()[at]) < 1e-4


def test_words_are_read_twice_at_most_for_training(spark):
    """Once to find the frequent ones and once to write all as context symbols, which the training reads."""
    rng, reads = random.Random(13), spark.sparkContext.accumulator(0)
    rows = [(i, chain(rng, 60) + f" Größe{i} un\u00e9{i}\u2003x{i % 7}longer") for i in range(90)] + [(90, None), (91, ""), (92, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)

    def read(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    contexts, _, totals = lm_score.fit(docs.mapInArrow(read, docs.schema))
    assert 0 < reads.value <= 2 * len(rows)
    counts = lm_score.window_counts(docs, contexts.symbols)
    assert np.array_equal(lm_score.coded_window_counts(lm_score.coded(docs, contexts), contexts), counts)
    assert np.array_equal(totals, counts.sum((0, 1)))
