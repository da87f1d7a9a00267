import random

import numpy as np
import xxhash

from textloom.llm import simhash
from textloom.llm.components import components

SCHEMA = "doc_id long, text string, fp string, label int, component_id string"


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """doc ids -> smallest reachable id, all pairs."""
    label = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 4 and label[b] < label[a]:
                    label[a] = label[b]
                    changed = True
    return label


def test_fingerprint_matches_definition():
    rng = random.Random(1)
    texts = ["", None, "  \t\n", "One", "One two\x0bthree", "É A b C d e f", "x " * 700]
    texts += [" ".join(rng.choice(["ab", "CD", "é", "zz"]) for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    for t in texts:
        assert simhash.fingerprint(t) == brute_fingerprint(t)


def test_result_matches_brute_force(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(25):
        words = [rng.choice(vocab) for _ in range(rng.choice([3, 12, 60, 150]))]
        for _ in range(4):
            edited = list(words)
            if rng.random() < 0.7:
                edited[rng.randrange(len(edited))] = rng.choice(vocab)
            rows.append(" ".join(edited))
    rows += ["", "", None, "   ", "Hello THERE", "hello there"]
    data = [(i, t, "clash", i, "clash") for i, t in enumerate(rows)]
    data.append((3, rows[3], "clash", 0, "clash"))  # a repeated row
    got = simhash.simhash_near_duplicates(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == len(data)
    fps = {i: brute_fingerprint(t) for i, t in enumerate(rows)}
    want = brute_components(fps)
    assert len(set(want.values())) < len(rows)
    for r in got:
        assert r.fingerprint == f"{fps[r.doc_id]:016x}"
        assert r.component_id == want[r.doc_id]


def test_links_keep_all_connections_of_a_dense_group(spark):
    rng = np.random.default_rng(3)
    centre = np.uint64(0x0123456789ABCDEF)
    fps = {int(centre)}
    while len(fps) < 300:
        flips = rng.choice(64, rng.integers(1, 7), replace=False)
        fps.add(int(centre) ^ sum(1 << int(b) for b in flips))
    fps |= {int(x) for x in rng.integers(0, 1 << 63, 300)}
    ordered = sorted(fps)
    ids = {f: i for i, f in enumerate(ordered)}
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in ordered], "fp long")
    links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.fingerprint_links(df).collect()]
    assert links and all((a ^ b).bit_count() <= 4 for a, b in links)
    assert len(set(links)) < 300 * 40
    label = brute_components({ids[f]: f for f in ordered})
    root = list(range(len(ordered)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(ids[a]), find(ids[b])
        root[max(x, y)] = min(x, y)
    assert [find(i) for i in range(len(ordered))] == [label[i] for i in range(len(ordered))]


def test_empty_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_near_duplicates(empty).collect() == []
    df = spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (5, "a b c d e"), (9, "q r s t u v w")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.simhash_near_duplicates(df).collect()}
    assert got == {None: 5, 7: 5, 5: 5, 9: 9}


def test_components_of_a_long_chain(spark):
    n = 200
    df = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(500, 501), (501, 501), (None, 3)], "a long, b long")
    got = {r.node: r.label for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 500: 500, 501: 500}
