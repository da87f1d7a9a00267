"""Held-out accuracy and edge cases of the operators that learn from labels, and of page extraction."""

import zlib

import numpy as np

from textloom.llm import main_text, quality, toxicity

SF = "/root/testdata/sf0.01"
DOC = "doc_id long, text string, lang string, source string, n_chars long, score string"
ODD = [(1, None, None, None, None, "x"), (2, "", "en", "s", 0, "x"), (3, "  \n", "en", "s", 3, "x"), (None, "some words here", "en", "s", 5, "x"), (4, "w " * 60_000, "en", "s", 120_000, "x"), (4, "w " * 60_000, "en", "s", 120_000, "x")]


def held_out(spark, rows, label):
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in rows if r.held_out and r.doc_id in labels]
    return np.mean([r.predicted == labels[r.doc_id] for r in rows]), len(rows)


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.quality(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    accuracy, n = held_out(spark, rows, "quality")
    assert n > 80 and accuracy > 0.97


def test_toxicity_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    accuracy, n = held_out(spark, rows, "toxic")
    assert n > 50 and accuracy > 0.95


def test_odd_rows_and_empty_tables(spark):
    docs, labels = spark.createDataFrame(ODD, DOC), spark.createDataFrame([(2, 1, 0), (2, 0, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    nothing, no_labels = docs.limit(0), labels.limit(0)
    for score in (quality.quality, toxicity.toxicity):
        for own in (labels, no_labels):
            got = score(docs, own).collect()
            assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
            assert [r.held_out for r in got if r.doc_id is None] == [False]
        assert score(nothing, labels).collect() == []
    kept = toxicity.keep_clean(docs, toxicity.fit(docs, no_labels))
    assert kept.schema == docs.schema and kept.count() == len(ODD)


def test_factorisation_identity():
    rng = np.random.default_rng(0)
    x, w, v = rng.random((5, 12)), rng.normal(size=12), rng.normal(size=(12, 3))
    plain = [0.3 + r @ w + sum(v[i] @ v[j] * r[i] * r[j] for i in range(12) for j in range(i + 1, 12)) for r in x]
    assert np.allclose(quality.Machine(0.3, w, v).logit(x), plain)


def outcomes(text, lexicon=None):
    found = toxicity.features(text, toxicity._Cache(lexicon or toxicity.Lexicon()))
    return {i for i in range(6) if found[i]}


def test_grammar_outcomes():
    assert outcomes("What a fine day. The cat sat.") == set()
    assert outcomes("that was an idiot move") == {toxicity.PLAIN}
    assert outcomes("you are an idiot.") == outcomes("An IDIOT like you!") == {toxicity.AIMED}
    assert outcomes("you are not an idiot.") == {toxicity.NEGATED}
    assert outcomes("the paper quoted him as an idiot.") == {toxicity.REPORTED}
    assert outcomes("i will kill the process") == {toxicity.THREATENED}
    assert outcomes("i will kill you") == {toxicity.THREAT_AIMED}
    assert outcomes("not now. you idiot") == {toxicity.AIMED}
    assert outcomes("you there. that idiot") == {toxicity.PLAIN}
    assert outcomes("a grolk***", toxicity.Lexicon(stems={"grol": 4.0})) == {toxicity.PLAIN}


def test_scopes_end_at_breaks():
    assert outcomes("He said hello, you are an idiot") == {toxicity.AIMED}
    assert outcomes('He said, "you are an idiot"') == outcomes("she says you are an idiot") == {toxicity.REPORTED}
    assert outcomes("you said it and I kill you") == {toxicity.THREAT_AIMED}
    assert outcomes("kill the lights, you") == {toxicity.THREATENED}
    assert outcomes("it is not here, idiot") == {toxicity.PLAIN}
    assert outcomes("you are, frankly, an idiot") == {toxicity.AIMED}
    weigh = lambda text: max(toxicity.features(text, toxicity._Cache(toxicity.Lexicon()))[6:])
    assert weigh("he said you are not an idiot") < weigh("you are not an idiot") < weigh("what an idiot") < weigh("you are an idiot")


def test_composition_against_one_after_the_other():
    """The composed grammar and its three parts run in turn give the same outcome and path weight."""
    rng = np.random.default_rng(3)
    parts = [toxicity.Transducer(0, toxicity.NEGATION_REACH + 1, toxicity._negate), toxicity.Transducer(0, 3, toxicity._report), toxicity.Transducer(0, toxicity._AIM_STATES, toxicity._aim)]
    for _ in range(2000):
        words = [(int(k), "") for k in rng.integers(0, 7, rng.integers(1, 12))]
        state, total = toxicity.GRAMMAR.start, 0.0
        for x in words:
            state, weight = toxicity._STEP[state, x[0]]
            total += weight
        passed, plain = words, 0.0
        for part in parts:
            at, out = part.start, []
            for x in passed:
                at, y, weight = part.arcs[at, x]
                out.append(y)
                plain += weight
            passed = out
        assert toxicity._ENDS[state] == toxicity._outcome(at) and abs(total - plain) < 1e-9


def test_lexicon_against_a_direct_count(spark):
    """Each learned word passes the stated thresholds by a plain count, and each word that passes them is learned."""
    import math
    import re

    rng = np.random.default_rng(4)
    rows = []
    for i in range(400):
        words = [f"w{x}" for x in rng.integers(0, 60, 12)] + (["grunk"] if i % 4 == 0 else []) + (["snarl"] if i % 8 == 0 or i % 5 == 1 else [])
        rows.append((i, " ".join(rng.permutation(words)), int(i % 4 == 0)))
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(rows, "doc_id long, text string, y int"), 100, 300)
    pos, neg = {}, {}
    for _, text, y in rows:
        for w in set(re.findall(r"\w+", text)):
            (pos if y else neg)[w] = (pos if y else neg).get(w, 0) + 1
    every, want = set(pos) | set(neg), {}
    for w in every:
        p, n = pos.get(w, 0), neg.get(w, 0)
        odds, share = math.log((p + 0.5) / 101) - math.log((n + 0.5) / 301), p / (p + n)
        excess = (p + n) * ((share * math.log(share / 0.25) if share else 0.0) + ((1 - share) * math.log((1 - share) / 0.75) if share < 1 else 0.0))
        if p >= toxicity.MIN_SUPPORT and odds >= toxicity.MIN_ODDS and excess >= math.log(len(every) / toxicity.MAX_CHANCE):
            want[w] = min(toxicity.MAX_WEIGHT, odds)
    assert "grunk" in want and set(lexicon.words) == set(want) and all(abs(lexicon.words[w] - x) < 1e-9 for w, x in want.items())


def test_best_region_against_all_regions():
    rng = np.random.default_rng(1)
    for _ in range(200):
        scores = rng.integers(-4, 5, rng.integers(0, 14)).tolist()
        a, b = main_text.best_region(scores)
        best = max([0, *(sum(scores[i:j]) for i in range(len(scores)) for j in range(i, len(scores) + 1))])
        assert sum(scores[a:b]) == best


def test_pages_of_the_table(spark):
    """On these pages the main text is what stands inside <article>."""
    import html
    import re

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = main_text.extract(pages, main_text.learn(pages)).collect()
    gold = {r.page_id: " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.search(r"<article>(.*?)</article>", r.html, re.S)[1])).split()) for r in pages.collect()}
    assert len(got) == len(gold)
    assert all(r.text == gold[r.page_id] and r.n_chars == len(r.text) for r in got)


PAGE = """<html><head><title>T</title></head><body><header><h1>Site</h1><p>Welcome to our site today friend</p></header>
<div id="sidebar-left"><p>Some side text that is fairly long here</p></div><div class="content"><h2>Real title</h2><p>One &lt;two&gt; three four five &eacute;.
<p>Six <b>se</b>ven&nbsp; eight<script>var a = "<p>no</p>";</script><div class="ad-box">Buy this now please</div><p>Nine ten eleven<form><label>Your email</label><input></form>
<p>Twelve.</div><div class="comments"><p>Nice post you wrote there man</p></div><div class="cookie-notice">We use cookies on this site</div><footer>bye"""


def test_other_templates():
    want = "Real title One <two> three four five é. Six seven eight Nine ten eleven Twelve."
    assert main_text.main_text(PAGE, main_text.Weights()) == want
    assert main_text.main_text(PAGE.replace('<div class="content">', "<main>").replace("Twelve.</div>", "Twelve.</main>"), main_text.Weights()) == want
    for odd in (None, "", "<", "<!-- ", "<p", "&amp;&#0;", "<script>x", "<nav>only menu</nav>"):
        assert isinstance(main_text.main_text(odd, main_text.Weights()), str)
    assert main_text.main_text("<nav>only menu</nav>", main_text.Weights()) == ""


def test_odd_pages(spark):
    rows = [(None, None, None, "t"), (1, "u", "", "t"), (2, "u", "<p>a b c</p>", "t"), (2, "u", "<p>a b c</p>", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = main_text.extract(pages, main_text.learn(pages)).collect()
    assert sorted(r.text for r in got) == ["", "", "a b c", "a b c"]
    assert main_text.extract(pages.limit(0), main_text.learn(pages.limit(0))).collect() == []
