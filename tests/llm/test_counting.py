"""Packing, mixing, token counts, language-model scores and nearest neighbours, against brute force."""

import itertools
import math
import os
import random

import duckdb
import numpy as np
import pytest

from textloom.llm import ann, lm_score, mixing, packing, token_counts

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def test_bounds_are_optimal():
    rng = random.Random(1)
    for _ in range(150):
        lengths = sorted(rng.sample(range(40), rng.randrange(1, 9)))
        counts = [rng.randrange(1, 9) for _ in lengths]
        k = rng.randrange(1, 6)

        def cost(bounds):
            return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts, strict=True))

        best = min(cost([*c, lengths[-1]]) for r in range(min(k, len(lengths))) for c in itertools.combinations(lengths[:-1], r))
        got = packing.optimal_bounds(lengths, counts, k)
        assert len(got) <= k and got == sorted(got) and got[-1] == lengths[-1]
        assert cost(got) == best
    assert packing.optimal_bounds([], [], 4) == []


def test_packing_fills_batches(spark, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK_ROWS", 50)
    rng = random.Random(2)
    rows = [(i if i % 50 else None, " ".join("w" * rng.randrange(1, 40)) if i % 30 else None, "en", "s", 1) for i in range(400)] + [(9, "dup", "en", "s", 3)] * 3 + [(1000, "w " * 20_000, "en", "s", 1)]
    got = packing.pack(spark.createDataFrame(rows, DOC), buckets=5, budget=100).collect()
    assert len(got) == len(rows)
    assert sorted(r.n_tokens for r in got) == sorted(len((t or "").split()) for _, t, *_ in rows)
    batches = {}
    for r in got:
        assert r.n_tokens <= r.bucket_tokens
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for (bucket, batch), members in batches.items():
        room = max(1, 100 // max(1, members[0].bucket_tokens))
        last = max(b for k, b in batches if k == bucket)
        assert len(members) == room or batch == last and len(members) < room
        assert sorted(r.position for r in members) == list(range(len(members)))
    assert packing.pack(spark.createDataFrame([], DOC)).collect() == []


def test_mixing_matches_its_sql(spark):
    rng = random.Random(3)
    rows = [(i, "t", "en", rng.choice(["a", "a", "a", "b", None]), 1) for i in range(300)] + [(5, "t", "en", "rare", 1), (5, "t", "en", "rare", 1), (None, "t", "en", "a", 1)]
    docs = spark.createDataFrame(rows, DOC)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, str(r["source"]), r["__copy"], r["__order"]) for r in mixing.mix(docs).collect())
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    want = sorted((i is None or i != i, 0 if i is None or i != i else int(i), str(s), c, u) for i, s, _, c, u in con.execute(mixing.ORACLE_SQL).fetchall())
    assert got == want and len(got) > 100
    salted = mixing.mix(docs, most_broadcast=0).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, str(r["source"]), r["__copy"], r["__order"]) for r in salted) == want


def test_mixing_reaches_its_targets(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "'t' AS text", "CASE WHEN id % 10 = 0 THEN 'few' WHEN id % 1000 = 1 THEN 'rare' ELSE 'many' END AS source")
    got = mixing.mix(docs, weights={"few": 1.0, "rare": 1.0, "other": 2.0}, epoch=2.0)
    sizes = {r["source"]: r["count"] for r in got.groupBy("source").count().collect()}
    assert set(sizes) == {"few", "rare"}
    assert all(abs(n - 6000) < 6 * math.sqrt(6000) for n in sizes.values())
    order = [r["__order"] for r in got.select("__order").collect()]
    assert order == sorted(order)
    assert mixing.mix(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        mixing.mix(docs.withColumn("__copy", docs.doc_id))


def plain_count(pieces, word):
    text = token_counts.MARK + word
    worst = min(pieces.values()) - 10
    best = [(0.0, 0)]
    for end in range(1, len(text) + 1):
        size = len(text[end - 1].encode())
        options = [(best[end - 1][0] + size * worst, best[end - 1][1] + size)]
        options += [(best[s][0] + pieces[text[s:end]], best[s][1] + 1) for s in range(end) if text[s:end] in pieces]
        best.append(max(options, key=lambda o: (o[0], -o[1])))
    return best[-1][1]


def test_token_counts_match_one_by_one_segmentation(spark):
    rng = random.Random(4)
    letters = "abcé"
    pieces = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 5))): -rng.random() * 9 for _ in range(60)} | {token_counts.MARK: -3.0, token_counts.MARK + "a": -2.0}
    words = ["".join(rng.choice(letters + "z😀") for _ in range(rng.randrange(1, 12))) for _ in range(500)]
    texts = [None, "", " \n", *(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(40)), "z" * 300]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "ab", "x")], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r for r in token_counts.token_counts(df, pieces).collect()}
    assert len(got) == len(texts) + 1
    for i, t in enumerate(texts):
        assert got[i].n_words == len((t or "").split())
        assert got[i].n_tokens == sum(plain_count(pieces, w) for w in (t or "").split())
    assert token_counts.token_counts(df.limit(0), pieces).collect() == []


def test_a_full_cache_changes_nothing():
    pieces = {"a": -1.0, "ab": -1.5, token_counts.MARK: -1.0}
    texts = ["ab ba a", "b ab", "a a a", "abab"] * 200
    assert token_counts.Segmenter(pieces, most=1).count(texts) == token_counts.Segmenter(pieces).count(texts)


def test_a_shared_prefix_is_scored_once():
    asked = []

    class Pieces(dict):
        def get(self, piece, *default):
            asked.append(piece)
            return super().get(piece, *default)

    segmenter = token_counts.Segmenter(Pieces({"ab": -1.0, "abc": -2.0, token_counts.MARK: -1.0}))
    segmenter.learn(["abcab"])
    before = len(asked)
    segmenter.learn(["abcab", "abc"])
    assert len(asked) == before and len(segmenter.scores) == 7  # the root and one node a prefix
    segmenter.learn(["abcx"])
    assert 0 < len(asked) - before <= segmenter.longest and len(segmenter.scores) == 8
    assert segmenter.ends == {"abcab": 3, "abc": 2, "abcx": 3}


@pytest.mark.skipif(not os.path.exists(token_counts.VOCABULARY), reason="no vocabulary file")
def test_vocabulary_file():
    pieces = token_counts.load_pieces()
    assert len(pieces) > 30_000 and token_counts.Segmenter(pieces).count(["the the"])[0] == (2, 2)


def test_lm_counts_and_scores(spark):
    rng = random.Random(5)
    texts = [None, "", "alone", *(" ".join(rng.choice("the cat sat on a mat".split()) for _ in range(rng.randrange(2, 80))) for _ in range(60)), " ".join(f"w{rng.randrange(10**6)}" for _ in range(3000))]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_words int").repartition(4)
    symbols = lm_score.Symbols(lm_score.frequent_words(df))
    counts = lm_score.window_counts(df, symbols)
    cache, want = symbols.cache(), np.zeros_like(counts)
    for t in texts:
        c = [0, *(cache[w] for w in (t or "").split()), 0]
        for a, m, b in zip(c, c[1:], c[2:], strict=False):
            want[a, b, m] += 1
    assert (counts == want).all()
    network = lm_score.train(counts, rounds=20)
    table = network.table()
    assert np.allclose(np.exp(table.astype(float)).sum(2), 1, atol=1e-4)
    got = {r.doc_id: r for r in lm_score.score(df, symbols, network).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        c = [0, *(cache[w] for w in (t or "").split()), 0]
        total = sum(float(table[a, b, m]) for a, m, b in zip(c, c[1:], c[2:], strict=False))
        assert math.isclose(got[i].log_likelihood, total, rel_tol=1e-5, abs_tol=1e-6)
        assert (got[i].per_word is None) == (len(c) == 2)
    even = -math.log(lm_score.SYMBOLS - 1)
    assert (counts * np.where(counts > 0, table, 0)).sum() / counts.sum() > even + 0.5  # it has learned
    assert lm_score.masked_scores(df.limit(0)).collect() == []


def brute_neighbours(rows, every, k):
    real = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = []
    for q, x in real.items():
        if q % every == 0:
            near = sorted((-float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), i) for i, y in real.items() if i != q)
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(near[:k])]
    return out


def vectors():
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(400)]
    rows += [(i, rows[0][1]) for i in range(400, 500)]  # a hot vector
    rows += [(500, None), (550, [0.0] * 8), (600, [float("nan")] * 8), (650, [float("inf")] + [1.0] * 7), (700, [1.0] * 4), (750, [None] + [1.0] * 7), (None, [1.0] * 8), (50, rows[50][1])]
    return rows


def test_neighbours_are_exact_when_all_is_probed(spark):
    rows = vectors()
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(4)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(df, candidates=10**6).collect())
    want = sorted(brute_neighbours(dict(r for r in rows if r[0] is not None).items(), 50, 5))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-12)
    few = df.filter("vec_id IN (0, 1, 2)")
    assert sorted((r.query_id, r.vec_id) for r in ann.nearest(few).collect()) == [(0, 1), (0, 2)]
    assert ann.nearest(df.limit(0)).collect() == []


def test_recall(spark):
    """At the defaults, over every query: the recall, and how much of the table is probed for it."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    x, ids = np.array([v for _, v in rows], float), np.array([i for i, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    books = ann.codebook(x[:, :32], 500), ann.codebook(x[:, 32:], 500)
    limit, sizes = ann.reach_limit(x, books, 5, 0.94), np.zeros((500, 500), int)
    np.add.at(sizes, (ann._nearest_centroid(x[:, :32], books[0]), ann._nearest_centroid(x[:, 32:], books[1])), 1)
    probed = [sum(sizes[tuple(c)] for c in ann.walk(((books[0] - q[:32]) ** 2).sum(1), ((books[1] - q[32:]) ** 2).sum(1), sizes, 6, limit)) for q in x[ids % 50 == 0]]
    assert np.mean(probed) < 0.25 * len(x)
    found = {}
    for r in ann.nearest(df).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = []
    for at in np.flatnonzero(ids % 50 == 0):
        s = x @ x[at]
        s[at] = -9
        hits.append(len(found[ids[at]] & set(ids[np.lexsort((ids, -s))[:5]])) / 5)
    assert np.mean(hits) >= 0.9


def test_walk_is_in_order():
    rng = np.random.default_rng(7)
    a, b, sizes = rng.random(6), rng.random(7), rng.integers(0, 4, (6, 7))
    pairs = list(map(tuple, ann.walk(a, b, sizes, 10**9).tolist()))
    sums = [a[i] + b[j] for i, j in pairs]
    assert sums == sorted(sums) and {*pairs} == {(i, j) for i in range(6) for j in range(7) if sizes[i, j]}


def test_hot_cells_and_crowds_of_queries_are_cut(spark):
    rows = vectors() + [(i, [1.0, 1e-6 * i, *[0.0] * 6]) for i in range(1000, 1300)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int").repartition(4)
    got = sorted((r.query_id, r.rank, r.vec_id) for r in ann.nearest(df, every=2, candidates=10**6, block=16).collect())
    assert got == sorted((r.query_id, r.rank, r.vec_id) for r in ann.nearest(df, every=2, candidates=10**6).collect()) and len(got) == 5 * 400
    first, parts = ann._blocks(np.array([3, 0, 40, 5, 12, 9]), 16)
    assert parts.tolist() == [1, 1, 3, 1, 1, 1] and first[[0, 2, 3, 4, 5]].tolist() == [0, 1, 4, 5, 6]


def test_a_very_long_word():
    assert token_counts.Segmenter({"a": -1.0, token_counts.MARK: -1.0}).count(["z" * 50_000, "a" * 50_000]) == [(50_001, 1), (50_001, 1)]
