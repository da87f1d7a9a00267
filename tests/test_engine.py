"""Unit tests of the scanning engine, with texts of our own wording."""

import json
import re

import pytest
from pyspark.sql import functions as F

from textloom.functions import regex as R
from textloom.functions import text as T
from textloom.operators import corpus, fixer, house, prose, resume, scoring
from textloom.plans import scan
from textloom.plans.samples import TEXTS


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def test_ascii_boundaries_and_spaces(spark):
    df = texts(spark, "caférobust robust, robustness robust", "")
    row = df.select(R.count(F.col("text"), "(?i)\\brobust\\b").alias("n"), T.token_count(F.col("text")).alias("t"), R.trim(F.lit("  x\t\n")).alias("x")).first()
    assert (row.n, row.t, row.x) == (3, 4, "x")


def test_offsets_match_a_plain_search(spark):
    patterns = ["the", "(?i)t\\w+", "(?<=e) \\w", "a+b?"]
    rows = ["the cat, the thé; aab The end", "", "no match", "aaab ab a"]
    df = texts(spark, *rows)
    for p in patterns:
        got = {r.doc_id: [(s.start, s.end, s.text) for s in r.x] for r in df.select("doc_id", R.spans(F.col("text"), p).alias("x")).collect()}
        for i, t in enumerate(rows):
            assert got[i] == [(m.start(), m.end(), m[0]) for m in re.finditer(p, t, re.ASCII)]


def test_measurements(spark):
    m = T.measure(texts(spark, 'Dr. Roe ran 3.5 miles. "It\'s late!" he said; nobody minded. Fine\n\nA second paragraph (short) ends here, yes.', None)).orderBy("doc_id").collect()
    assert m[0].m.sentences == ["Dr. Roe ran 3.5 miles.", '"It\'s late!', "he said; nobody minded.", "Fine\n\nA second paragraph (short) ends here, yes."]
    assert m[0].m.openers == ["dr", "it's", "he", "fine"] and m[0].m.para_openers == ["dr", "a"]
    assert m[1].m.words == 0 and m[1].m["values"].sentenceLength is None and m[1].m["values"].readingLevel == 0.0


def test_syllables(spark):
    def plain(word):
        w = re.sub("[^a-z]", "", word.lower())
        if len(w) <= 3:
            return 1
        w = re.sub("^y", "", re.sub("(?:[^laeiouy]es|ed|[^laeiouy]e)$", "", w))
        return max(1, len(re.findall("[aeiouy]{1,2}", w)))

    words = "Makes needed yes yellow table the queue don't rhythm shed bakes ydes a I'm state-of-the-art created".split()
    got = T.measure(texts(spark, " ".join(words), *words)).orderBy("doc_id").collect()
    assert [r.m.syllables for r in got] == [sum(map(plain, words)), *map(plain, words)]


def test_calibration_curve(spark):
    rows = [(0, 5.0, 1, 120), (0, 15.0, 3, 200), (0, 75.0, 15, 1000), (60, 0.0, 0, 30), (60, 0.0, 0, 300), (None, None, None, None)]
    df = spark.createDataFrame(rows, "base int, weighted double, n int, words int")
    got = [r.c for r in df.select(scoring.calibrate(F.col("base"), F.col("weighted"), F.col("n"), F.col("words")).alias("c")).collect()]
    assert got[0].score <= 15 and got[0].band == "clean"  # a lone finding
    assert abs(got[1].score - got[2].score) <= 2  # the same density
    assert (got[3].score, got[4].score, got[4].band, got[5].score) == (15, 60, "assisted", 0)
    edges = spark.createDataFrame([(x,) for x in (15.4, 15.5, 40.4, 40.5, 70.5, 120.0, -3.0)], "s double").select(scoring.band(F.col("s")).alias("b")).collect()
    assert [r.b for r in edges] == ["clean", "some", "some", "assisted", "machine", "machine", "clean"]


HOUSE = [
    ("We leverage it.", "leverage-verb", 1), ("Their financial leverage grew.", "leverage-verb", 0), ("Robustness is not it.", "robust", 0), ("A ROBUST and robust thing.", "robust", 2),
    ("Delving in.", "delve", 1), ("He paid 6,000 or 6k.", "six-thousand", 2), ("After two years of programming", "two-years-coding", 1), ("one — two — three", "em-dash", 2),
]


def test_house_rules(spark):
    got = {}
    for r in house.check(texts(spark, *(t for t, _, _ in HOUSE))).collect():
        got[r.doc_id, r.rule_id] = got.get((r.doc_id, r.rule_id), 0) + r.cnt
    for i, (_, rule, n) in enumerate(HOUSE):
        assert got.get((i, rule), 0) == n, HOUSE[i]
    assert house.check(texts(spark, "robust"), []).count() == 0
    assert house.check(texts(spark, "robust"), [{"pattern": "robust", "enabled": False}]).count() == 0
    many = house.check(texts(spark, "x " * 300), [{"pattern": "x"}]).collect()
    assert [r.cnt for r in many] == [200]


def test_house_rule_validation(spark):
    for bad in ([{"pattern": ""}], [{"pattern": "("*3, "match": "regex"}], [{"pattern": "x*", "match": "regex"}], ["no"], {"a": 1}, [{"pattern": "x"}] * 501, [{"pattern": "x" * 201}]):
        with pytest.raises(house.RuleError):
            house.normalize(bad, spark)
    assert [r["id"] for r in house.normalize([{"pattern": "Big one"}] * 3)] == ["big-one", "big-one-2", "big-one-3"]
    told = house.from_json(house.to_json(house.DEFAULT_RULES), spark)
    assert [r["pattern"] for r in told] == [r["pattern"] for r in house.DEFAULT_RULES]
    assert "severity" not in json.loads(house.to_json([{"pattern": "x"}]))["rules"][0]
    with pytest.raises(house.RuleError):
        house.from_json('{"format": "other", "rules": []}')


def test_resume_structure(spark):
    rows = {r.doc_id: r for r in resume.analyze(spark.createDataFrame(TEXTS, "doc_id long, text string")).select("*", resume.detect_mode(F.col("r")).alias("mode")).collect()}
    good, ai = rows[-5], rows[-7]
    assert good.mode == "resume" and [len(b.body.split()) for b in good.r.bullets] == [11, 13, 8, 6, 7] and good.r.blocks == 2
    assert good.a.ai_score == 0 and good.a.craft_score >= 80
    types = {i.type for i in ai.a.issues}
    assert {"resume-llm-verb", "resume-round-metrics", "resume-triad", "resume-uniform-bullets", "resume-missing-contact"} <= types and ai.a.ai_score > 60
    soft = {i.type for i in rows[-6].a.issues}
    assert {"resume-weak-verb", "resume-pronoun", "resume-cliche", "resume-llm-verb"} <= soft
    assert rows[-4].a.score == 0 and not rows[-4].a.scorable and rows[-4].a.issues == []
    assert all(len({(i.type, i.text.lower()) for i in r.a.issues}) == len(r.a.issues) for r in rows.values())


MACHINE = (
    "In today's rapidly evolving world, the town library stands as a testament to robust planning. Moreover, experts believe that it is poised to revolutionize the landscape of learning. "
    "It is important to note that the new wing leverages cutting-edge design. Furthermore, its staff foster a transformative journey for readers. In conclusion, the future of reading is bright."
)
PLAIN = (
    "The library shut early on Friday because a pipe burst in the back room. Two of us carried the wet boxes up to the street and laid the books out on a tarp. "
    "About forty were past saving. The plumber came at six, swore at the valve, and had it fixed in ten minutes. We open again on Tuesday, a bit damp but in good order."
)


def test_scan_bands_order_and_fix(spark):
    scanned = scan.scan(texts(spark, MACHINE, PLAIN, None))
    got = scanned.orderBy("doc_id").collect()
    assert [r.band for r in got] == ["machine", "clean", "clean"] and got[0].ai_score >= 85 and got[1].prose_issues == []
    assert [r.mode for r in got] == ["essay"] * 3 and got[0].craft_score is None
    bare = scan.scan(texts(spark, MACHINE), rules=False).first()
    assert bare.ai_score == got[0].ai_score and bare.house_issues == []  # house rules never move the score
    shown = [r for r in scan.all_issues(scanned).collect() if r.doc_id == 0]
    assert [r.issue_id for r in shown] == [f"f{i}" for i in range(len(shown))]
    rank = {"house": 0, "resume": 1, "prose": 1}
    assert [rank[r.source] for r in shown] == sorted(rank[r.source] for r in shown)
    fixed = scan.fix(scanned).orderBy("doc_id").collect()
    assert fixed[1].fixed_text == PLAIN and fixed[1].applied == 0
    assert not re.search("Moreover|Furthermore|important to note|robust", fixed[0].fixed_text) and "In today's rapidly evolving world" in fixed[0].fixed_text
    edits = fixed[0].edits
    assert all(a.end <= b.start for a, b in zip(edits, edits[1:], strict=False))
    assert scan.over(scanned, 70) and not scan.over(scanned, 100)


FIXES = [
    ("All is well. Moreover, the tests pass.", "All is well. The tests pass."),
    ("However the weather turns, we go.", "However the weather turns, we go."),
    ("A ROBUST tool and cutting-edge parts.", "A STRONG tool and latest parts."),
    ("It was a testament to skill.", "It was a testament to skill."),
    ("the start  of it .", "The start of it."),
    ("We navigate here.", "We navigate here."),
    ("one — two", "One, two"),
]


def test_fixer(spark):
    got = scan.fix(scan.scan(texts(spark, *(t for t, _ in FIXES)))).orderBy("doc_id").collect()
    assert [r.fixed_text for r in got] == [want for _, want in FIXES]


def test_replacements():
    assert fixer.parse_replacement("strong, solid") == ("swap", "strong") and fixer.parse_replacement("ran / coordinated") == ("swap", "ran")
    assert fixer.parse_replacement("cut — or show it") == ("delete", "") and fixer.parse_replacement("turning point, shift") == ("swap", "turning point")
    assert [fixer.parse_replacement(x) for x in ("name the result", "", None, "say what changed", "x" * 41)] == [None] * 5


def test_corpus_validation():
    ok = {"text": "word " * 120, "label": "One"}
    assert [s["id"] for s in corpus.normalize([ok, ok])] == ["one", "one-2"]
    for bad in ({}, [{"text": "short"}], [ok] * 13, ["x"], [{"text": "w " * 20_001}]):
        with pytest.raises(corpus.SampleError):
            corpus.normalize(bad)
    assert corpus.from_json(corpus.to_json([{**ok, "type": "spoken"}]))[0]["type"] == "spoken"


def test_prose_clusters(spark):
    rows = prose.analyze(texts(spark, "We had to navigate the road.", "We navigate a transformative realm. Nobody else would.")).orderBy("doc_id").collect()
    assert rows[0].p.issues == [] and {i.type for i in rows[1].p.issues} == {"tier2-word"}


def test_stream(spark, tmp_path):
    from textloom.streaming.scan_stream import scan_stream, write_parquet

    texts(spark, MACHINE, PLAIN).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    write_parquet(scan_stream(stream).select("doc_id", "band"), str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    assert {r.doc_id: r.band for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {0: "machine", 1: "clean"}
