"""The scan: mode, prose, resume and house findings, calibrated score, and the fixed text, a row a document.

Nothing is shuffled: every step is a projection of its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import regex as R
from textloom.functions import text as T
from textloom.functions.barrier import settle
from textloom.operators import fixer, house, prose, resume, scoring, voice


def _house(rules: list | bool | None, docs: DataFrame, strict: bool) -> tuple[list, str | None]:
    """(rules, error): no rules and a message where they can't be used, unless strict."""
    if rules is False:
        return [], None
    try:
        return house.normalize(house.DEFAULT_RULES if rules is None else rules, docs.sparkSession), None
    except house.RuleError as e:
        if strict:
            raise
        return [], str(e)


def _regions(text: Column, issues: Column) -> Column:
    """Sentences that hold a prose finding's words; looked for only where there is a finding."""
    hit = lambda s: F.exists(issues, lambda x: F.lower(F.regexp_replace(s, f"[{R.SPACE}]+", " ")).contains(F.lower(x["text"])))
    return F.when(F.size(issues) > 0, F.filter(T.sentences(T.clean_for_prose(text)), hit)).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame, rules: list | bool | None = None, mode: str = "auto", context: str = "general", text_col: str = "text", profiles: DataFrame | None = None, author_col: str = "author", strict_rules: bool = True) -> DataFrame:
    """docs with mode, ai_score, band, label, prose_score, craft_score (null for essays), words, density, evidence,
    classification, confidence, probabilities, prose_issues, resume_issues, house_issues, house_error, regions, sections
    (null for essays) and stats; with profiles also voice and voice_issues.

    rules: None for the shipped house rules, False or an empty list for none; unusable ones raise an error, or with
    strict_rules off are told in house_error. profiles: rows of profile.build(), met on author_col, the one step that
    shuffles (a profile a row of docs at most). House, craft and voice findings never move the score. A null text counts
    as empty.
    """
    own, wrong = _house(rules, docs, strict_rules)
    if profiles is not None:
        compared = voice.compare(docs, profiles, tuple(docs.columns), author_col, text_col)
        told = F.struct(*[F.col(c) for c in ("available", "score", "band", "reason", "unavailable")])
        docs = compared.select(*[F.col(f"`{c}`") for c in docs.columns], told.alias("voice"), F.col("findings").alias("voice_issues"))
    cols = [c for c in docs.columns]
    text = F.coalesce(F.col(text_col), F.lit(""))
    told = resume.detect_mode(F.col("r")) if mode == "auto" else F.lit(mode)
    step = resume.analyze(docs, text_col, active=told == "resume").select(*cols, told.alias("mode"), "a", F.col("r.sections").alias("__sections"))
    technical = F.lit(True) if context == "technical" else F.col("mode") == "resume"
    step = prose.analyze(step, text_col, technical)
    ai = F.concat(F.col("p.issues"), F.filter(F.col("a.issues"), lambda x: x["grp"] == "ai"))
    weighted = F.aggregate(ai, F.lit(0.0), lambda acc, x: acc + scoring.weigh(x["severity"], x["weight"]))
    step = step.select("*", scoring.calibrate(F.col("p.score"), weighted, F.size(ai), F.col("p.words")).alias("__c"), (F.col("mode") == "resume").alias("__resume"))
    share = F.col("p.score") / 100.0
    return settle(
        step,
        cols,
        mode=F.col("mode"),
        ai_score=F.col("__c.score"),
        band=F.col("__c.band"),
        label=scoring.band(F.col("__c.score"), field=3),
        prose_score=F.col("p.score"),
        craft_score=F.when(F.col("__resume"), F.col("a.craft_score")),
        words=F.col("p.words"),
        density=F.col("__c.density"),
        evidence=F.col("__c.evidence"),
        classification=F.col("p.classification"),
        confidence=F.col("p.confidence"),
        probabilities=F.struct(((1 - share) * (1 - share)).alias("human"), (2 * share * (1 - share)).alias("mixed"), (share * share).alias("machine")),
        prose_issues=F.col("p.issues"),
        resume_issues=F.col("a.issues"),
        house_issues=house.findings_column(text, own),
        house_error=F.lit(wrong).cast("string"),
        regions=_regions(text, F.col("p.issues")),
        sections=F.when(F.col("__resume"), F.col("__sections")),
        stats=F.struct(F.col("p.words").alias("words"), *[F.when(F.col("__resume"), F.col(f"a.{c}")).alias(c) for c in ("bullet_count", "bullets_with_metrics")]),
    )


def _label(x: Column, labels: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(v) for kv in labels.items() for v in kv])
    return F.coalesce(F.element_at(table, x), x)


def all_issues(scanned: DataFrame, id_col: str = "doc_id", voice_col: str | None = None) -> DataFrame:
    """A row a finding in display order: doc_id, issue_id (f0, f1, ...), source, type, severity, label, text, suggestion.

    House first, then voice, then resume and prose together; then by severity. Equals keep the order voice, house,
    resume, prose and, within, their own. voice_col names an array of voice findings, if there is one.
    """
    def flat(source: str, issues: Column, type_, label) -> Column:
        rank = {"house": 0, "voice": 1}.get(source, 2)
        order = {"voice": 0, "house": 1, "resume": 2, "prose": 3}[source]
        return F.transform(
            issues,
            lambda x, i: F.struct(F.lit(rank).alias("a"), (-scoring.severity_rank(x["severity"])).alias("b"), F.lit(order).alias("c"), i.alias("d"), F.lit(source).alias("source"), type_(x).alias("type"), x["severity"].alias("severity"), label(x).alias("label"), x["text"].alias("text"), x["suggestion"].alias("suggestion")),
        )

    parts = [
        flat("house", F.col("house_issues"), lambda x: F.lit("house-rule"), lambda x: x["label"]),
        flat("resume", F.col("resume_issues"), lambda x: x["type"], lambda x: _label(x["type"], resume.LABELS)),
        flat("prose", F.col("prose_issues"), lambda x: x["type"], lambda x: _label(x["type"], prose.TYPE_LABELS)),
    ]
    if voice_col:
        parts.append(flat("voice", F.col(voice_col), lambda x: F.lit("voice"), lambda x: x["label"]))
    out = settle(scanned.withColumnRenamed(id_col, "doc_id"), ["doc_id"], xs=F.array_sort(F.concat(*parts))).select("doc_id", F.posexplode("xs").alias("n", "x"))
    return out.select("doc_id", F.concat(F.lit("f"), F.col("n").cast("string")).alias("issue_id"), *[F.col(f"x.{c}").alias(c) for c in ("source", "type", "severity", "label", "text", "suggestion")])


def fix(scanned: DataFrame, text_col: str = "text") -> DataFrame:
    """scanned with edits, fixed_text, applied (edits) and manual (findings without an edit)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    issues = F.concat(F.col("resume_issues"), F.col("prose_issues"))
    step = scanned.select("*", fixer.plan(text, issues, F.col("house_issues")).alias("edits"))
    touched = F.size(F.array_distinct(F.transform("edits", lambda e: e["issue"])))
    return step.select("*", fixer.apply(text, F.col("edits")).alias("fixed_text"), F.size("edits").alias("applied"), (F.size("house_issues") + F.size("resume_issues") + F.size("prose_issues") - touched).alias("manual"))


def over(scanned: DataFrame, limit: float) -> bool:
    """The gate: whether any score is strictly above limit."""
    return not scanned.filter(F.col("ai_score") > limit).select("ai_score").limit(1).isEmpty()
