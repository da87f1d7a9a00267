"""What a scan is shown as: a JSON document or a readable report a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import regex as R
from textloom.operators import prose, resume, scoring
from textloom.plans.scan import _label

#: Findings of one group that a report shows.
SHOWN, TEXT_CHARS, ADVICE_CHARS = 40, 64, 92


def truncate(x: Column, most: int) -> Column:
    """x on one line, with an ellipsis in place of what exceeds so many characters."""
    flat = R.trim(F.regexp_replace(x.cast("string"), f"[{R.SPACE}]+", " "))
    return F.when(F.length(flat) > most, F.concat(F.left(flat, F.lit(most - 1)), F.lit("…"))).otherwise(flat)


def as_json(scanned: DataFrame, text_col: str = "text") -> DataFrame:
    """value: every column but the text as a JSON document, nulls included."""
    return scanned.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in scanned.columns if c != text_col]), {"ignoreNullFields": "false"}).alias("value"))


def _group(title: str, issues: Column, label) -> Column:
    def line(x: Column) -> Column:
        where = F.when(x["line"].isNotNull(), F.concat(F.lit(" (line "), x["line"].cast("string"), F.lit(")"))).otherwise("")
        advice = F.when(F.coalesce(x["suggestion"], F.lit("")) != "", F.concat(F.lit("\n      "), truncate(x["suggestion"], ADVICE_CHARS))).otherwise("")
        return F.concat(F.lit("\n    "), x["severity"], F.lit("  "), label(x), where, F.lit(": "), truncate(x["text"], TEXT_CHARS), advice)

    more = F.when(F.size(issues) > SHOWN, F.concat(F.lit("\n    and "), (F.size(issues) - SHOWN).cast("string"), F.lit(" others"))).otherwise("")
    head = F.concat(F.lit(f"\n\n  {title}: "), F.size(issues).cast("string"))
    return F.when(F.size(issues) > 0, F.concat(head, F.array_join(F.transform(F.slice(issues, 1, SHOWN), line), ""), more)).otherwise("")


def report(scanned: DataFrame, quiet: bool = False) -> Column:
    """The report of a row of scan.scan(): scores first, then (unless quiet) the findings by group."""
    number = lambda c: F.col(c).cast("string")
    parts = [F.lit("  AI-writing score "), number("ai_score"), F.lit(" of 100: "), F.col("label"), F.lit("\n  "), F.col("classification"), F.lit(", "), F.col("confidence"), F.lit(" confidence")]
    parts += [F.when(F.size("house_issues") > 0, F.concat(F.lit("\n  House rules broken: "), F.size("house_issues").cast("string"))).otherwise("")]
    parts += [F.when(F.col("house_error").isNotNull(), F.concat(F.lit("\n  House rules not checked: "), F.col("house_error"))).otherwise("")]
    parts += [F.when(F.col("craft_score").isNotNull(), F.concat(F.lit("\n  Resume craft "), number("craft_score"), F.lit(" of 100; bullets with a number: "), number("stats.bullets_with_metrics"), F.lit(" of "), number("stats.bullet_count"))).otherwise("")]
    voiced = "voice" in scanned.columns
    if voiced:
        matched = F.concat(F.lit("\n  Voice match "), number("voice.score"), F.lit(" of 100: "), scoring.band(F.col("voice.score"), scoring.VOICE_BANDS, 3))
        parts += [F.when(F.col("voice.available"), matched).otherwise(F.concat(F.lit("\n  Voice match unavailable. "), F.col("voice.reason")))]
    if not quiet:
        if voiced:
            plain = F.transform("voice_issues", lambda x: F.struct(x["severity"], x["label"], x["text"], x["suggestion"], F.lit(None).cast("int").alias("line")))
            parts.append(_group("Voice", plain, lambda x: x["label"]))
        kind = lambda grp: F.filter("resume_issues", lambda x: x["grp"] == grp)
        parts += [_group("House rules", F.col("house_issues"), lambda x: x["label"]), _group("Signs of generated text", kind("ai"), lambda x: _label(x["type"], resume.LABELS)), _group("Resume craft", kind("craft"), lambda x: _label(x["type"], resume.LABELS)), _group("Prose", F.col("prose_issues"), lambda x: _label(x["type"], prose.TYPE_LABELS))]
        none = (F.size("prose_issues") + F.size("resume_issues") + F.size("house_issues")) == 0
        parts.append(F.when(none, "\n\n  No findings.").otherwise(""))
    return F.concat(*parts, F.lit("\n\n  A score is a hint for revising this draft and no proof of who wrote it."))


def write_json(scanned: DataFrame, path: str, text_col: str = "text") -> None:
    as_json(scanned, text_col).write.text(path)


def write_reports(scanned: DataFrame, path: str, id_col: str = "doc_id", quiet: bool = False) -> None:
    scanned.select(id_col, report(scanned, quiet).alias("report")).write.parquet(path)


def check_bands(scanned: DataFrame, manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A manifest (id, mode, band) of fixtures against their scan: id, mode, band, got_mode, got_band, ok.

    A fixture that was not scanned is not ok. A manifest is small and is broadcast by Spark where it is.
    """
    got = scanned.select(id_col, F.col("mode").alias("got_mode"), F.col("band").alias("got_band"))
    return manifest.select(id_col, "mode", "band").join(got, id_col, "left").withColumn("ok", F.coalesce((F.col("band") == F.col("got_band")) & (F.col("mode") == F.col("got_mode")), F.lit(False)))
