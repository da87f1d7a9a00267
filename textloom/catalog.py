"""Registered queries of the document-scanning engine, and the same queries as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom import oracle, oracle_scan, oracle_voice
from textloom.functions import text as T
from textloom.functions.barrier import settle
from textloom.functions.regex import js_round
from textloom.operators import corpus, house, profile, resume, scoring, voice
from textloom.plans import extras, scan
from textloom.plans.samples import TEXTS
from textloom.sources import extract

#: House rules made of words that the driver's texts have.
RULES = [
    {"id": "the", "pattern": "the"},
    {"id": "der-die", "pattern": "\\b(?:der|die|das)\\b", "match": "regex"},
    {"id": "comma-and", "pattern": ", and", "match": "literal"},
    {"id": "robust", "pattern": "robust"},
    {"id": "six", "pattern": "\\b6[,.]?000\\b|\\b6k\\b", "match": "regex"},
    {"id": "off", "pattern": "of", "enabled": False},
]


def text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = T.measure(extras.texts(spark, sf_dir), fields=("words", "sentences", "syllables", "values"))
    n = lambda c: c.cast("long")
    values = [js_round(F.col(f"m.values.{x}"), 1).alias(name) for x, name in oracle.METRIC_COLUMNS.items()]
    return m.select("doc_id", n(F.col("m.words")).alias("words"), n(T.token_count(F.coalesce(F.col("text"), F.lit("")))).alias("tokens"), n(F.size("m.sentences")).alias("sentences"), n(F.col("m.syllables")).alias("syllables"), *values)


def sentence_openers_per_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = T.measure(extras.texts(spark, sf_dir), fields=("openers", "para_openers"))
    return m.select("doc_id", F.array_join("m.openers", " ").alias("openers"), F.array_join("m.para_openers", " ").alias("para_openers"))


def word_freq_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = extras.documents(spark, sf_dir, "text")
    each = settle(docs, [], words=F.transform(T.words(F.coalesce(F.col("text"), F.lit(""))), F.lower)).select(F.explode("words").alias("word"))
    return each.groupBy("word").agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.desc("cnt"), "word").limit(50)


def contact_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.coalesce(F.col("text"), F.lit(""))
    flags = [has(x).alias(has.__name__) for has in (resume.has_email, resume.has_phone, resume.has_url, resume.has_date, resume.has_metric)]
    return extras.texts(spark, sf_dir).select("doc_id", *flags)


def rule_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = house.check(extras.texts(spark, sf_dir), RULES)
    n = lambda c: F.col(c).cast("long").alias(c)
    return found.select("doc_id", "rule_id", F.lower("text").alias("match_key"), n("cnt"), n("start"), n("end"), n("line"), F.element_at("spans", -1)["start"].cast("long").alias("last_start"))


def calibrate_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    c = scoring.calibrate((F.col("doc_id") * 7) % 131, (F.col("doc_id") % 13) * 1.5, F.col("doc_id") % 6, F.col("n_chars") / 8)
    step = docs.select("doc_id", c.alias("c"))
    return step.select("doc_id", F.col("c.score").cast("long").alias("score"), F.col("c.band").alias("band"), js_round(F.col("c.evidence"), 3).alias("evidence"), scoring.band((F.col("doc_id") * 3) % 140 - 20, scoring.VOICE_BANDS).alias("voice_band"))


def _screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sample with the prose detector's verdict. The documents state no override, so none has one."""
    return corpus.screen(extras.author_samples(spark, sf_dir))


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples that the prose detector doesn't flag."""
    return corpus.usable(_screened(spark, sf_dir))


def profile_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = profile.bands(profile.measured(_samples(spark, sf_dir), "bands"))
    return b.select("author", "metric", "available", "have", F.col("samples").cast("long").alias("samples"), "mean", "sd", "low", "high")


def openers_top12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.openers(profile.measured(_samples(spark, sf_dir), "openers"))


def paragraph_openers_top12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.openers(profile.measured(_samples(spark, sf_dir), "para_openers"), "para_openers")


def profile_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.evidence(profile.measured(_samples(spark, sf_dir), "evidence"))


def signature_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.signature_words(profile.measured(_samples(spark, sf_dir), "signature"))


def absent_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absence over the sample texts and the documents, by source; the sample texts are an author of their own."""
    own = spark.createDataFrame([("samples", t) for _, t in TEXTS], "source string, text string")
    x = extras.documents(spark, sf_dir, "source", "text").unionByName(own)
    m = x.select(F.coalesce("source", F.lit("samples")).alias("author"), F.struct(T.clean_for_prose(F.coalesce(F.col("text"), F.lit(""))).alias("clean")).alias("m"))
    return profile.absent_words(m)


def corpus_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.status(_screened(spark, sf_dir))


def _voice(spark: SparkSession, sf_dir: str) -> DataFrame:
    screened = _samples(spark, sf_dir).select("author", "sample", "label", "type", "text").persist()  # read by each part of a profile
    return voice.compare(extras.drafts(spark, sf_dir), profile.build(screened))


def voice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _voice(spark, sf_dir).select("doc_id", "author", "available", F.col("score").cast("long").alias("score"), "band", F.col("deducted").cast("long").alias("deducted"))


def voice_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _voice(spark, sf_dir).select("doc_id", F.explode("findings").alias("x")).select("doc_id", "x.*")
    return x.select("doc_id", "metric", "severity", "direction", "draft_value", F.col("penalty").cast("long").alias("penalty"), "text")


def resume_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = settle(extras.texts(spark, sf_dir), ["doc_id"], lines=resume.lines(F.coalesce(F.col("text"), F.lit("")))).select("doc_id", F.inline("lines"))
    return x.select("doc_id", F.col("index").cast("long").alias("line"), F.col("words").cast("long").alias("words"), "blank", "glyph", "heading", "body")


def resume_bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = resume.parse(extras.texts(spark, sf_dir))
    return settle(x, ["doc_id"], b=F.col("r.bullets")).select("doc_id", F.inline("b")).select("doc_id", F.col("index").cast("long").alias("line"), "body")


def resume_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = resume.parse(extras.texts(spark, sf_dir))
    n = lambda c, name: F.col(c).cast("long").alias(name)
    return x.select("doc_id", n("r.blocks", "blocks"), n("r.date_lines", "date_lines"), F.size("r.bullets").cast("long").alias("bullets"), *[n(f"r.sections.{s}", s) for s in resume.SECTIONS], F.col("r.used_glyphs").alias("used_glyphs"), resume.detect_mode(F.col("r")).alias("mode"))


def resume_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every resume finding of every text, whatever its mode."""
    x = resume.analyze(extras.texts(spark, sf_dir))
    return x.select("doc_id", F.inline("a.issues")).select("doc_id", "type", "severity", "text", F.col("line").cast("long").alias("line"))


def resume_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = resume.analyze(extras.texts(spark, sf_dir))
    return x.select("doc_id", *[F.col(f"a.{c}").cast("long").alias(c) for c in ("score", "ai_score", "craft_score", "word_count", "bullet_count")], F.col("a.label").alias("label"))


def scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = scan.scan(extras.texts(spark, sf_dir))
    return x.select("doc_id", "mode", "ai_score", "band", "words", "craft_score", F.size("prose_issues").alias("prose"), F.size("house_issues").alias("house"))


def all_issues_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.all_issues(scan.scan(extras.texts(spark, sf_dir)))


def fix_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = scan.fix(scan.scan(extras.texts(spark, sf_dir)))
    return x.select("doc_id", "applied", "manual", "fixed_text")


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", extract.xml_text(F.coalesce(F.col("html"), F.lit("")), paragraph="p").alias("text"))


_ALL = (
    text_stats, sentence_openers_per_text, word_freq_topk, contact_predicates, rule_matches, calibrate_bands, profile_bands, openers_top12, paragraph_openers_top12, profile_evidence, signature_words, absent_words, corpus_status,
    voice_scores, voice_findings, resume_lines, resume_bullets, resume_structure, resume_findings, resume_scores, scan_documents, all_issues_order, fix_text, html_text,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return oracle.all_sql(RULES) | oracle_scan.all_sql() | oracle_voice.all_sql()
