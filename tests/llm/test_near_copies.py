"""The wide SimHash join against brute force."""

from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from textloom.llm import near_copies

WORDS = np.array([f"w{i}" for i in range(5000)])


def jaccard(a, b, shingle=5):
    def grams(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set()

    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def edited(rng, words, times):
    words = list(words)
    for at in rng.choice(len(words), times, replace=False):
        words[at] = str(rng.choice(WORDS))
    return words


def groups_of(texts, least=0.8):
    """Smallest index of each text's component, by brute force."""
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        if jaccard(texts[i], texts[j]) >= least:
            x, y = sorted((root(i), root(j)))
            label[y] = x
    return [root(i) for i in range(len(texts))]


def kept_ids(spark, rows, schema="doc_id long, text string", **options):
    return sorted((r["doc_id"] for r in near_copies.keep_one_of_each(spark.createDataFrame(rows, schema), **options).collect()), key=lambda x: (x is None, x))


def test_brute_force(spark):
    rng, texts = np.random.default_rng(1), []
    for _ in range(60):
        base = [str(w) for w in rng.choice(WORDS, rng.integers(30, 300))]
        texts.append(" ".join(base))
        texts += [" ".join(edited(rng, base, int(n))) for n in rng.integers(1, max(2, len(base) // 40) + 1, 3)]
    texts += [" ".join(rng.choice(WORDS, 80)) for _ in range(60)]
    order = rng.permutation(len(texts))
    texts = [texts[i] for i in order]
    label = groups_of(texts)
    got = kept_ids(spark, list(enumerate(texts)))
    want = {i for i, x in enumerate(label) if i == x}
    assert want <= set(got), "a text without a like one before it went"
    # Of the documents that are to go, the grids may miss few: pairs at the very threshold.
    assert len(set(got) - want) <= 0.03 * (len(texts) - len(want))


def at_the_threshold(rng, n):
    """Pairs of texts alike to 0.8 to 0.83, far apart in between; later ids go."""
    rows = []
    for i in range(n):
        base = [str(w) for w in rng.choice(WORDS, 104)]
        end = [f"e{i}_{j}" for j in range(11)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base[:-11] + end))]
        assert 0.8 <= jaccard(rows[-2][1], rows[-1][1]) < 0.83
    return rows


def test_none_is_missed_at_the_threshold(spark):
    rows = at_the_threshold(np.random.default_rng(6), 300)
    assert kept_ids(spark, rows) == list(range(0, 600, 2))


def test_exact_where_the_grids_find_little(spark):
    """One grid of cells that only equal fingerprints share: the exact pass alone gives brute force's groups."""
    rng, texts = np.random.default_rng(7), ["", " ", "a", "A", "a b", "b a"]
    shared = [str(w) for w in rng.choice(WORDS, 40)]  # a passage that most texts hold
    for _ in range(40):
        base = [str(w) for w in rng.choice(WORDS, rng.integers(4, 120))] + shared
        texts.append(" ".join(base))
        texts += [" ".join(edited(rng, base, int(n))) for n in rng.integers(1, max(2, len(base) // 30) + 1, 4)]
    texts = [texts[i] for i in rng.permutation(len(texts))]
    label = groups_of(texts)
    assert kept_ids(spark, list(enumerate(texts)), tables=1, segments=128) == [i for i, x in enumerate(label) if i == x]


def test_links_that_the_forest_drops(spark):
    """A cell's forest hangs texts by fingerprint bits: links it left out come back when verification takes its own away."""
    rng, texts = np.random.default_rng(8), []
    for _ in range(12):
        base = [str(w) for w in rng.choice(WORDS, 120)]
        texts += [" ".join(edited(rng, base, int(n))) for n in rng.integers(1, 5, 20)]
    label = groups_of(texts)
    assert kept_ids(spark, list(enumerate(texts))) == [i for i, x in enumerate(label) if i == x]


@pytest.mark.parametrize("common", [0, 3, 40])
def test_prefixes_of_alike_sets_meet(common):
    rng = np.random.default_rng(common)
    often = rng.permutation(np.arange(1, common + 1, dtype=np.uint64))
    place = np.argsort(often)
    for n in [1, 2, 4, 5, 9, 30, 61]:
        for _ in range(40):
            x = np.unique(np.concatenate((often[: n // 2], rng.integers(100, 2**63, n, dtype=np.uint64))))
            y = np.unique(np.concatenate((x[rng.permutation(x.size)[: max(1, round(0.87 * x.size))]], rng.integers(100, 2**63, n // 12, dtype=np.uint64))))
            if np.intersect1d(x, y).size >= 0.8 * np.union1d(x, y).size:
                p, q = (near_copies._prefix(s, 0.8, often[place], place) for s in (x, y))
                rows = [(t, label, label, s.size, i) for label, s, f in ((0, x, p), (1, y, q)) for i, t in enumerate(f.view(np.int64))]
                rows = pd.DataFrame(rows, columns=["token", "label", "node", "size", "pos"]).sort_values(["token", "label"], ignore_index=True)
                assert any(len(found) for found in near_copies._across(rows, 0.8))


def test_pairs_across_labels(monkeypatch):
    rng = np.random.default_rng(9)
    rows = pd.DataFrame({"token": rng.integers(0, 12, 300), "label": rng.integers(0, 5, 300), "node": np.arange(300), "size": 10, "pos": 0})
    rows = rows.sort_values(["token", "label"], ignore_index=True)
    want = {(max(x.node, y.node), min(x.node, y.node)) for x, y in combinations(list(rows.itertuples()), 2) if x.token == y.token and x.label != y.label}
    for most in (1, 50, 10**6):
        monkeypatch.setattr(near_copies, "PAIRS", most)
        got = [tuple(r) for part in near_copies._across(rows, 0.8) for r in part.itertuples(index=False)]
        assert len(got) == len(want) and set(got) == want


def test_copies_in_other_case_or_space(spark):
    """Copies in capitals or with other white space are near copies in every alphabet, not in ASCII alone."""
    rng, rows = np.random.default_rng(10), []
    for i, letters in enumerate(("été élève naïve où", "größe über schön straßen", "año señal ímpetu ñandú", "мир слово дорога")):
        own = letters.split()
        words = [f"{rng.choice(own)}{n}" for n in rng.integers(0, 50, 60)]
        rows += [(10 * i, " ".join(words)), (10 * i + 1, " ".join(words).upper().replace("SS", "ß")), (10 * i + 2, "\u00a0".join(words)), (10 * i + 3, "\u2003 ".join(words) + "\u3000")]
    rows += [(90, ""), (91, "\u00a0"), (92, "\u3000\u2028")]
    label = groups_of([t for _, t in rows])
    assert kept_ids(spark, rows) == [rows[i][0] for i, x in enumerate(label) if i == x] == [0, 10, 20, 30, 90]


def test_crowd_around_one_text(spark):
    """Hundreds of variants, alike to their base but not to each other, hang together through it."""
    rng = np.random.default_rng(2)
    base = [str(w) for w in rng.choice(WORDS, 200)]
    rows = [(i, " ".join(edited(rng, base, 3))) for i in range(600)] + [(900, " ".join(base))]
    assert len(kept_ids(spark, rows)) <= 6


def test_rows_not_ids(spark):
    rng = np.random.default_rng(3)
    a, b, c = (" ".join(rng.choice(WORDS, 60)) for _ in range(3))
    rows = [(3, b), (5, a), (5, b), (7, c), (7, a + " " + c), (None, c), (None, a + b), (8, None), (9, "  "), (9, "  ")]
    got = near_copies.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(3, b), (5, a), (7, c), (7, a + " " + c), (None, a + b), (8, None)], key=str)


def test_columns_and_empty(spark):
    schema = "`id` long, text string, row string, __id int, h int, node int, more string, `f0` int, label int, doc_id long"
    rows = [(1, "a b c d e f", "x", 1, 1, 1, "m", 1, 1, 4), (1, "A b c d e f", "x", 1, 1, 1, "m", 1, 1, 2), (1, "A b c d e f", "x", 1, 1, 1, "m", 1, 1, 2)]
    docs = spark.createDataFrame(rows, schema)
    got = near_copies.keep_one_of_each(docs)
    assert got.schema == docs.schema and [tuple(r) for r in got.collect()] == [rows[1]]
    assert near_copies.keep_one_of_each(docs.limit(0)).collect() == []


def test_long_text(spark):
    rng = np.random.default_rng(4)
    long = " ".join(rng.choice(WORDS, 200_000))
    assert kept_ids(spark, [(2, long), (1, long + " more"), (3, "short one")]) == [1, 3]


@pytest.mark.parametrize("n", [2, 40, 300])
def test_forest_spans_and_is_least(n):
    rng = np.random.default_rng(n)
    a, b = np.nonzero(np.triu(rng.random((n, n)) < 0.2, 1))
    far = rng.integers(0, 12, a.size)
    kept, _ = near_copies._forest(n, a, b, far)

    def kruskal(edges):
        label, total = list(range(n)), 0

        def root(i):
            while label[i] != i:
                i = label[i]
            return i

        used = 0
        for e in sorted(edges, key=lambda e: far[e]):
            x, y = root(a[e]), root(b[e])
            if x != y:
                label[x], total, used = y, total + far[e], used + 1
        return total, used

    assert kruskal(kept) == kruskal(range(a.size)) and len(kept) == kruskal(kept)[1]


def test_large_cell_connects_what_is_near():
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**63, (6, 2), dtype=np.uint64)
    fp = np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, (n, 2), dtype=np.uint64)) for c, n in zip(centres, (500, 90, 20, 3, 1, 1), strict=True)])
    fp = fp[rng.permutation(len(fp))]
    a, b = near_copies._large(fp, 28)
    assert (near_copies._far(fp[a], fp[b]) <= 28).all()
    assert len(np.unique(near_copies._forest(len(fp), a, b, np.zeros(a.size))[1])) == 6
