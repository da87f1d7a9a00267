"""The full record of a scan, and what it is shown as."""

import json

import pytest
from pyspark.sql import functions as F

from test_voice import PARTS
from textloom.operators import house, profile
from textloom.plans import report, scan
from textloom.plans.samples import TEXTS


@pytest.fixture(scope="module")
def scanned(spark):
    docs = spark.createDataFrame([(i, "src1", t) for i, t in TEXTS] + [(9, None, None)], "doc_id long, author string, text string")
    samples = spark.createDataFrame([("src1", i, f"doc {i}", "written" if i else "spoken", "\n\n".join([PARTS[i % 4]] * 24)) for i in range(5)], "author string, sample long, label string, type string, text string")
    built = profile.build(samples).cache()
    return scan.scan(docs, profiles=built).cache(), built


def test_profile_states_what_it_was_built_from(scanned):
    (p,) = scanned[1].collect()
    assert (p.samples, p.written_samples, p.spoken_samples) == (5, 4, 1) and p.labels == [f"doc {i}" for i in range(5)]
    assert p.spoken_words == p.total_words - p.written_words > 0
    assert set(p.evidence) >= {"sentenceLength", "commaRate"} and len(p.evidence["sentenceLength"]) == 3
    values = [e.value for e in p.evidence["sentenceLength"]]
    assert values == sorted(values) and p.evidence["commaRate"][0].text.startswith(p.evidence["commaRate"][0].sample + ": ")
    assert p.paragraph_openers_available == (p.written_words >= 1500)


def test_record(scanned):
    rows = {r.doc_id: r for r in scanned[0].collect()}
    assert len(rows) == len(TEXTS) + 1
    plain = {r.doc_id: r for r in scan.scan(scanned[0].select("doc_id", "text")).select("doc_id", "ai_score").collect()}
    for i, r in rows.items():
        assert r.ai_score == plain[i].ai_score  # voice never moves it
        assert abs(sum(r.probabilities) - 1) < 1e-9 and r.house_error is None
        assert (r.sections is None) == (r.mode != "resume") == (r.stats.bullet_count is None)
        assert r.voice.available or r.voice.reason and not r.voice_issues
    assert any("Moreover" in s for s in rows[-2].regions) and rows[-3].regions == []
    assert rows[9].voice.reason.startswith("No voice profile")
    long = scanned[0].filter("voice.available").select(F.explode("voice_issues").alias("x")).select("x.*").collect()
    assert all(x.metric != "sentenceLength" or len(x.evidence) == 2 for x in long)


def test_unusable_rules(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    bad = [{"pattern": "(", "match": "regex"}]
    with pytest.raises(house.RuleError):
        scan.scan(docs, rules=bad)
    (r,) = scan.scan(docs, rules=bad, strict_rules=False).collect()
    assert "compile" in r.house_error and r.house_issues == []


def test_json_and_reports(scanned, tmp_path, spark):
    whole = scanned[0]
    docs = [json.loads(r.value) for r in report.as_json(whole).collect()]
    assert len(docs) == whole.count() and all("text" not in d and set(d) >= {"mode", "ai_score", "house_error", "voice"} for d in docs)
    shown = {r.doc_id: r.t for r in whole.select("doc_id", report.report(whole).alias("t")).collect()}
    assert all("of 100" in t and "no proof" in t for t in shown.values())
    assert "House rules: " in shown[-1] and "Resume craft" in shown[-5] and "No findings." in shown[-4]
    quiet = {r.doc_id: r.t for r in whole.select("doc_id", report.report(whole, quiet=True).alias("t")).collect()}
    assert all(len(quiet[i]) <= len(t) for i, t in shown.items()) and "Prose: " not in quiet[-2]
    report.write_json(whole, f"{tmp_path}/json")
    report.write_reports(whole, f"{tmp_path}/reports")
    assert spark.read.json(f"{tmp_path}/json").count() == spark.read.parquet(f"{tmp_path}/reports").count() == whole.count()


def test_truncate(spark):
    got = spark.range(1).select(report.truncate(F.lit(" a \n b  c "), 9).alias("a"), report.truncate(F.lit("x" * 20), 5).alias("b"), report.truncate(F.lit(""), 5).alias("c")).first()
    assert tuple(got) == ("a b c", "xxxx…", "")


def test_manifest(scanned, spark):
    rows = {r.doc_id: r for r in scanned[0].select("doc_id", "mode", "band").collect()}
    manifest = spark.createDataFrame([(-3, "essay", rows[-3].band), (-5, "resume", "machine"), (77, "essay", "clean")], "doc_id long, mode string, band string")
    assert {r.doc_id: r.ok for r in report.check_bands(scanned[0], manifest).collect()} == {-3: True, -5: rows[-5].band == "machine", 77: False}
