"""Calibration of findings to a 0-100 score with bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.regex import js_round

# Fixed values of the published scale: bands, curve and severity weights.
BANDS = (
    ("clean", 0, 15, "Reads as human", "low"),
    ("some", 16, 40, "Some AI signals", "low"),
    ("assisted", 41, 70, "Reads as AI-assisted", "mid"),
    ("machine", 71, 100, "Reads as machine-written", "high"),
)
VOICE_BANDS = (
    ("close", 80, 100, "Sounds like you", "low"),
    ("near", 60, 79, "Mostly like you", "low"),
    ("off", 35, 59, "Drifting from your voice", "mid"),
    ("far", 0, 34, "Doesn't sound like you", "high"),
)
DENSITY_SCALE, EVIDENCE_FULL, MIN_WORDS, CLEAN_MAX = 26, 3, 40, 15
SEVERITY_WEIGHT = {"critical": 6.0, "high": 5.0, "medium": 3.0, "low": 1.5}
UNKNOWN_WEIGHT = 2.0
SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1}


def clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0)), F.lit(100))


def _pick(key: Column, table: dict[str, float | int], other: float | int) -> Column:
    out = F.lit(other)
    for k, v in reversed(table.items()):
        out = F.when(key == k, v).otherwise(out)
    return out


def weigh(severity: Column, weight: Column | None = None) -> Column:
    """A stated weight wins over the severity's."""
    by_severity = _pick(severity, SEVERITY_WEIGHT, UNKNOWN_WEIGHT)
    return by_severity if weight is None else F.coalesce(weight.cast("double"), by_severity)


def severity_rank(severity: Column) -> Column:
    return _pick(severity, SEVERITY_RANK, 0)


def band(score: Column, bands: tuple = BANDS, field: int = 0) -> Column:
    """The id (or another field) of the band of a score: rounded and clamped, null and NaN counting as 0."""
    n = clamp(js_round(F.nanvl(F.coalesce(score.cast("double"), F.lit(0.0)), F.lit(0.0))))
    out = F.lit(None).cast("string")
    for b in reversed(bands):
        out = F.when(n.between(b[1], b[2]), F.lit(b[field])).otherwise(out)
    return out


def calibrate(base: Column, weighted: Column, n: Column, words: Column) -> Column:
    """struct(score, band, density, evidence, density_score): from a base score, the sum of weights and the number of
    findings, and the number of words. Nulls count as 0. Nothing is rounded before the score itself.
    """
    number = lambda c: F.nanvl(F.coalesce(c.cast("double"), F.lit(0.0)), F.lit(0.0))
    base, weighted, n, words = clamp(number(base)), number(weighted), number(n), F.greatest(number(words), F.lit(0.0))
    judged = (words >= MIN_WORDS) & (n > 0)
    density = F.when(judged, weighted / words * 100).otherwise(0.0)
    evidence = F.when(judged, F.least(F.lit(1.0), F.pow(n / EVIDENCE_FULL, F.lit(2.0)))).otherwise(0.0)
    density_score = 100 * (1 - F.exp(-density / DENSITY_SCALE)) * evidence
    score = F.when(words < MIN_WORDS, F.least(base, F.lit(float(CLEAN_MAX)))).otherwise(F.greatest(base, density_score))
    return F.struct(
        clamp(js_round(score)).cast("int").alias("score"),
        band(score).alias("band"),
        density.alias("density"),
        evidence.alias("evidence"),
        density_score.alias("density_score"),
    )
