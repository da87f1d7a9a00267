import hashlib
import random

import numpy as np

from textloom.llm import lz_fingerprint as lz


def brute_phrases(text):
    known, phrase = set(), ""
    for c in text:
        phrase += c
        if phrase not in known:
            known.add(phrase)
            phrase = ""
    return known


def texts():
    rng = random.Random(4)
    some = ["", "a", "ab", "aaaa", "aaaaa", "é😀é😀é", "abcabcabcabc" * 50]
    return some + ["".join(rng.choice("abcd e") for _ in range(rng.randrange(400))) for _ in range(60)]


def test_phrases_match_the_plain_parse():
    for t in texts():
        known, cuts = set(), []
        lz._phrases(t, 0, len(t), known, cuts)
        assert known == brute_phrases(t)
        assert {t[a:b] for a, b in zip([0, *cuts], cuts, strict=False)} == known


def test_pair_equals_separate_signatures():
    all_texts = texts()
    for t, after in zip(all_texts, all_texts[1:], strict=False):
        a, b, other = lz.signature_pair(t, after)
        half = len(t) // 2
        assert other == t[: len(t) - half] + after[:half]
        assert (a == lz.signature(t)).all()
        assert (b == lz.signature(other)).all()


def test_likeness_estimates_jaccard():
    rng = random.Random(5)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(5)) for _ in range(500)]
    errors = []
    for _ in range(20):
        a = " ".join(rng.choice(words) for _ in range(400))
        b = a[:1200] + " ".join(rng.choice(words) for _ in range(200))
        x, y = brute_phrases(a), brute_phrases(b)
        errors.append(lz.likeness(lz.signature(a), lz.signature(b)) - len(x & y) / len(x | y))
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.07


def check(rows, got):
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for k, (i, t) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        half = len(t) // 2
        other = t[: len(t) - half] + after[:half]
        sig = lz.signature(t)
        want.append((i, len(t), hashlib.sha256(other.encode()).hexdigest(), lz.hex_of(sig), lz.hex_of(lz.signature(other)), lz.likeness(sig, lz.signature(other)), lz.likeness(sig, lz.signature(after))))
    key = lambda r: (r[0] is not None, r[0] or 0, r[2])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_every_row_against_brute_force(spark):
    rng = random.Random(6)
    rows = [(i * 7 - 50, t) for i, t in enumerate(texts())] + [(None, "null id"), (6, None), (6, "tie"), (6, "tie"), (2**60 + 1, "long id")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, bucket string, role string").repartition(5)
    check(rows, lz.lz_fingerprints(df).collect())


def test_one_row_and_none(spark):
    check([(1, "lone row")], lz.lz_fingerprints(spark.createDataFrame([(1, "lone row")], "doc_id long, text string")).collect())
    assert lz.lz_fingerprints(spark.createDataFrame([], "doc_id long, text string")).collect() == []
