"""Reference samples of a writer: validation, screening, readiness."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import regex as R
from textloom.functions import text as T
from textloom.functions.barrier import settle
from textloom.operators import prose, scoring
from textloom.operators.house import slug

# Sizes a corpus must have.
MIN_SAMPLES, TARGET_SAMPLES, MAX_SAMPLES = 4, 6, 12
MIN_SAMPLE_WORDS, MAX_SAMPLE_WORDS = 100, 20_000
MIN_TOTAL_WORDS, STRONG_TOTAL_WORDS = 1_500, 3_000
FLAGGED_FROM = 41  # the first score above the band "some"
FORMAT, VERSION = "textloom/corpus", 1


class SampleError(ValueError):
    """A corpus that can't be used, with a message for a person."""


def normalize(samples: list, most: int = MAX_SAMPLES) -> list[dict]:
    """Checked samples of one writer with all fields and distinct ids, on the driver."""
    if not isinstance(samples, list):
        raise SampleError("Samples come as a list; this is something else.")
    if len(samples) > most:
        raise SampleError(f"{len(samples)} samples are more than the {most} that are used.")
    out, seen = [], set()
    for i, raw in enumerate(samples):
        if not isinstance(raw, dict):
            raise SampleError(f"Entry {i + 1} of the samples isn't a JSON object.")
        told = lambda key, raw=raw: raw[key].strip() if isinstance(raw.get(key), str) else ""
        text = re.sub("\r\n?", "\n", told("text"))
        if not text:
            raise SampleError(f"Entry {i + 1} of the samples lacks a text.")
        n = len(text.split())
        if n < MIN_SAMPLE_WORDS:
            raise SampleError(f"Entry {i + 1} has {n} words; a style shows from {MIN_SAMPLE_WORDS} words on.")
        if n > MAX_SAMPLE_WORDS:
            raise SampleError(f"Entry {i + 1} has {n} words, more than the {MAX_SAMPLE_WORDS} that are read.")
        label = told("label")[:120] or f"Sample {i + 1}"
        sample = {"type": "spoken" if raw.get("type") == "spoken" else "written", "id": told("id") or slug(label, fallback="sample"), "label": label, "text": text, "words": n, "unassisted": raw.get("unassisted") is not False, "overrideScreen": raw.get("overrideScreen") is True, "note": told("note")[:300]}
        own, k = sample["id"], 2
        while sample["id"] in seen:
            sample["id"] = f"{own}-{k}"
            k += 1
        seen.add(sample["id"])
        out.append(sample)
    return out


def to_json(samples: list, pretty: bool = True) -> str:
    shown = []
    for s in normalize(samples):
        one = {"label": s["label"], "text": s["text"]}
        one |= {k: s[k] for k, plain in (("type", "written"), ("note", ""), ("overrideScreen", False), ("unassisted", True)) if s[k] != plain}
        shown.append(one)
    note = "Use only what the writer wrote alone: a text drafted with an assistant profiles the assistant."
    return json.dumps({"format": FORMAT, "version": VERSION, "note": note, "samples": shown}, indent=2 if pretty else None, ensure_ascii=False)


def from_json(source) -> list[dict]:
    try:
        doc = json.loads(source) if isinstance(source, str) else source
    except ValueError as e:
        raise SampleError(f"The samples can't be parsed as JSON ({e}).") from None
    if isinstance(doc, list):
        return normalize(doc)
    if not isinstance(doc, dict):
        raise SampleError("Samples come as a list or as an object that holds one.")
    if doc.get("format") and not str(doc["format"]).endswith("/corpus"):
        raise SampleError(f'Not the format of a corpus: "{doc["format"]}".')
    if not isinstance(doc.get("samples"), list):
        raise SampleError('The object holds no list named "samples".')
    return normalize(doc["samples"])


def valid(samples: DataFrame) -> DataFrame:
    """Many writers' samples (author, sample, label, type, text, override) at once: those of a usable size, with words.

    Line ends are normalised and texts trimmed. Null texts and other types than 'spoken' count as empty and 'written'.
    """
    text = R.trim(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), "\r\n?", "\n"))
    out = samples.withColumn("text", text).withColumn("type", F.when(F.col("type") == "spoken", "spoken").otherwise("written")).withColumn("override", F.coalesce(F.col("override"), F.lit(False)))
    out = settle(out, [c for c in out.columns if c != "words"], words=T.token_count(F.col("text")))
    return out.filter(F.col("words").between(MIN_SAMPLE_WORDS, MAX_SAMPLE_WORDS))


def screen(samples: DataFrame) -> DataFrame:
    """samples with screen_score and flagged: whether the prose detector puts a sample above the band "some"."""
    cols = samples.columns
    step = prose.analyze(samples, "text")
    weighted = F.aggregate(F.col("p.issues"), F.lit(0.0), lambda a, x: a + scoring.weigh(x["severity"], x["weight"]))
    score = scoring.calibrate(F.col("p.score"), weighted, F.size("p.issues"), F.col("p.words"))["score"]
    return settle(step.select(*cols, score.alias("__score")), cols, screen_score=F.col("__score"), flagged=F.col("__score") >= FLAGGED_FROM)


def usable(screened: DataFrame) -> DataFrame:
    return screened.filter(~F.col("flagged") | F.col("override"))


def status(screened: DataFrame) -> DataFrame:
    """Readiness of each author's corpus: counts, words, ok, confidence and reasons."""
    good = ~F.col("flagged") | F.col("override")
    w = F.col("words").cast("long")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, w)), F.lit(0)).cast("long")
    out = screened.groupBy("author").agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.count_if(good).alias("usable_count"),
        F.count_if(good & (F.col("type") == "written")).alias("written_count"),
        F.sum(w).alias("total_words"),
        total(good).alias("usable_words"),
        total(good & (F.col("type") == "written")).alias("written_words"),
        F.count_if(~good).alias("flagged_count"),
    )
    enough, many, long = (F.col("usable_count") >= MIN_SAMPLES) & (F.col("usable_words") >= MIN_TOTAL_WORDS), F.col("usable_count") >= TARGET_SAMPLES, F.col("usable_words") >= STRONG_TOTAL_WORDS
    reasons = F.filter(
        F.array(
            F.when(F.col("usable_count") < MIN_SAMPLES, F.concat(F.col("usable_count").cast("string"), F.lit(f" of {MIN_SAMPLES} samples. Add "), (MIN_SAMPLES - F.col("usable_count")).cast("string"), F.lit(" more."))),
            F.when(F.col("usable_words") < MIN_TOTAL_WORDS, F.concat(F.col("usable_words").cast("string"), F.lit(f" of {MIN_TOTAL_WORDS} words. Sentence statistics are noise below that."))),
            F.when(F.col("flagged_count") > 0, F.concat(F.col("flagged_count").cast("string"), F.lit(" samples read as AI-assisted and are excluded."))),
        ),
        lambda x: x.isNotNull(),
    )
    return out.select(
        "*",
        (F.col("usable_words") - F.col("written_words")).alias("spoken_words"),
        enough.alias("ok"),
        F.when(~enough, "none").when(long & many, "high").when(long | many, "medium").otherwise("low").alias("confidence"),
        F.array_join(reasons, " ").alias("reasons"),
    )
