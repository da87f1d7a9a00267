"""The language model's words, each by its own probability."""

import math
import random
from collections import Counter

import numpy as np

from textloom.llm import lm_score


def test_each_word_has_its_own_probability(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "CHUNK_WORDS", 700)
    rng = random.Random(7)
    vocab = [f"{a}{b}ing" for a in "bcdfghkl" for b in "aeiouyrstmn"] * 3 + [f"{a}{b}{c}ed" for a in "bcdf" for b in "aeiou" for c in "lmnr"]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 120))) for _ in range(80)] + [None, "", " \t"]
    texts += ["pp qqrareaxing rr"] * 3 + ["pp qqrarebxing rr"]  # one ending, in one context
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[4])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = lm_score.masked_scores(df).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words) for r in got) == sorted((i is None, i or 0, len((t or "").split())) for i, t in rows)

    contexts, network, by_class = lm_score.fit(df)
    cache = contexts.symbols.cache()
    counts = Counter(w for _, t in rows for w in (t or "").split())
    totals = Counter()
    for w, n in counts.items():
        totals[cache[w]] += n
    assert {c: int(n) for c, n in enumerate(by_class) if n} == dict(totals)
    by_id = {r.doc_id: r for r in got}
    for i, t in rows:
        words = (t or "").split()
        read = [0, 0, *map(contexts.of, words), 0, 0]
        windows = np.array([(read[k], read[k + 1], read[k + 3], read[k + 4]) for k in range(len(words))], np.int64).reshape(-1, 4)
        masked = np.array([cache[w] for w in words], np.int64)
        table = network.log_probabilities(network.hidden(windows)) if words else np.empty((0, lm_score.SYMBOLS))
        want = sum(float(table[k, m]) + math.log(counts[w] / totals[m]) for k, (w, m) in enumerate(zip(words, masked, strict=True)))
        assert math.isclose(by_id[i].log_likelihood, want, rel_tol=1e-4, abs_tol=1e-3)
        assert (by_id[i].per_word is None) == (not words)
    # Over all words of the corpus the probabilities of a masked one add up to 1, but for classes without a word.
    alone = network.log_probabilities(network.hidden(np.array([[0, 0, 0, 0]])))[0]
    every = sum(math.exp(float(alone[cache[w]])) * n / totals[cache[w]] for w, n in counts.items())
    assert math.isclose(every, np.exp(alone[sorted(totals)]).sum(), abs_tol=1e-4) and every > 0.95
    assert by_id[83].log_likelihood > by_id[86].log_likelihood  # the rarer of two words with one ending is less likely
