"""Voice comparison: where a draft leaves its author's observed range. Every point of the score has a finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.barrier import settle
from textloom.functions.regex import js_round
from textloom.operators import profile, scoring

# Gates, penalties and wording.
MIN_DRAFT_WORDS, TOLERANCE, BASE_PENALTY, MAX_PENALTY = 80, 0.25, 8, 22
PHRASING = {
    "sentenceLength": ("your sentences run ", "", " words, this draft averages ", ""),
    "paragraphLength": ("your paragraphs run ", "", " sentences, this draft averages ", ""),
    "commaRate": ("you use ", "", " commas per 100 words, this draft ", ""),
    "semicolonRate": ("you use ", "", " semicolons per 100 words, this draft ", ""),
    "dashRate": ("you use ", "", " dashes per 100 words, this draft ", ""),
    "parentheticalRate": ("you use ", "", " parentheticals per 100 words, this draft ", ""),
    "contractionRate": ("you use contractions in ", "%", "% of sentences, this draft ", "%"),
    "readingLevel": ("you write at grade ", "", ", this draft reads at grade ", ""),
}
HINTS = {
    "sentenceLength": ("Longer sentences than you write.", "Shorter and clippier than you write."),
    "paragraphLength": ("Denser paragraphs than yours.", "More fragmented than you write."),
    "commaRate": ("More subclauses than you use.", "Fewer pauses than you use."),
    "semicolonRate": ("You rarely reach for semicolons.", ""),
    "dashRate": ("More dashes than you use.", ""),
    "parentheticalRate": ("More asides than you use.", ""),
    "contractionRate": ("Looser than you usually write.", "More formal than you write."),
    "readingLevel": ("Heavier going than your writing.", "Plainer than you write."),
}
LABELS = {mid: label for mid, label, _, _, _ in profile.METRICS}
FINDING = "array<struct<metric:string,label:string,severity:string,text:string,suggestion:string,word:string,low:double,high:double,draft_value:double,direction:string,penalty:int,evidence:array<struct<sample:string,value:double,text:string>>>>"


def number(x: Column) -> Column:
    """A one-decimal number as text, without a trailing .0."""
    return F.regexp_replace(x.cast("string"), "\\.0$", "")


def _finding(metric: str, label: str, severity: Column, text: Column, suggestion: Column, word: Column, low: Column, high: Column, value: Column, direction: Column, penalty: Column, evidence: Column | None = None) -> Column:
    none = F.array().cast("array<struct<sample:string,value:double,text:string>>")
    return F.struct(F.lit(metric).alias("metric"), F.lit(label).alias("label"), severity.alias("severity"), text.alias("text"), suggestion.alias("suggestion"), word.cast("string").alias("word"), low.cast("double").alias("low"), high.cast("double").alias("high"), value.cast("double").alias("draft_value"), direction.cast("string").alias("direction"), penalty.cast("int").alias("penalty"), (none if evidence is None else F.coalesce(evidence, none)).alias("evidence"))


def _band(metric: str, values: Column, bands: Column, evidence: Column) -> Column:
    b, v = F.element_at(bands, F.lit(metric)), js_round(values[metric], 1)
    low, high = b["low"], b["high"]
    width = F.greatest(high - low, F.abs(high) * 0.15, F.lit(0.5))
    above, below = v > high + width * TOLERANCE, v < low - width * TOLERANCE
    ratio = F.when(above, v - high).otherwise(low - v) / width
    start, unit, middle, end = PHRASING[metric]
    text = F.concat(F.lit(start), number(low), F.lit(unit + " to "), number(high), F.lit(middle), number(v), F.lit(end))
    up, down = HINTS[metric]
    made = _finding(
        metric, LABELS[metric], F.when(ratio >= 1.5, "high").when(ratio >= 0.6, "medium").otherwise("low"), text, F.when(above, up).otherwise(down), F.lit(None), low, high, v,
        F.when(above, "above").otherwise("below"), F.least(F.lit(MAX_PENALTY), js_round(BASE_PENALTY * (1 + ratio))), F.slice(F.element_at(evidence, F.lit(metric)), 1, 2),
    )
    return F.when(F.coalesce(b["available"] & (above | below), F.lit(False)), F.array(made).cast(FINDING)).otherwise(F.array().cast(FINDING))


def compare(drafts: DataFrame, profiles: DataFrame, keep: tuple[str, ...] = ("doc_id", "author"), author_col: str = "author", text_col: str = "text") -> DataFrame:
    """drafts against their authors' profiles: the columns keep of drafts, and available, reason, score, band,
    deducted, findings (by penalty, descending, each with excerpts of the author's as evidence), unavailable (metric ids).

    A draft is declined (no score, no findings) without a profile, under 80 words, or where no metric is available. A
    null text counts as empty. Drafts of one author meet that author's profile in a join; hot authors are split by the
    skew handling of adaptive execution.
    """
    m = T.measure(drafts.select(F.struct(*[f"`{c}`" for c in keep]).alias("kept"), F.col(f"`{author_col}`").alias("author"), F.col(f"`{text_col}`").alias("text")), fields=("words", "values", "openers", "clean"))
    m = m.select("kept", "author", F.col("m.words").alias("words"), F.col("m.values").alias("values"), F.col("m.openers").alias("draft_openers"), profile.absence_counts(F.col("m.clean")).alias("uses"))
    step = m.join(profiles.select("author", "bands", "openers", "openers_available", "top_opener", "paragraph_openers_available", "absent", "absent_available", "signature_available", "total_words", "written_words", "evidence"), "author", "left")
    any_band = F.exists(F.map_values(F.coalesce("bands", F.create_map().cast("map<string,struct<available:boolean,low:double,high:double,mean:double,sd:double,samples:bigint,have:bigint,need:int>>"))), lambda b: b["available"])
    some = any_band | F.col("openers_available") | F.col("absent_available") | F.col("signature_available")
    reason = (
        F.when(F.col("bands").isNull(), "No voice profile. Add samples of your own writing first.")
        .when(F.col("words") < MIN_DRAFT_WORDS, F.concat(F.col("words").cast("string"), F.lit(f" words is too short to compare; {MIN_DRAFT_WORDS} is the minimum.")))
        .when(~some, 'No metric has enough corpus behind it yet. Add more of your own writing — a score here would mean "nothing was checked", not "sounds like you".')
        .otherwise("")
    )
    step = step.select("*", reason.alias("reason"))
    on = F.col("reason") == ""
    total = F.size("draft_openers")
    tops = F.transform(F.array_distinct("draft_openers"), lambda w: F.struct(w.alias("w"), F.size(F.filter("draft_openers", lambda x: x == w)).alias("n")))

    def opener(x: Column) -> Column:
        rate, yours = js_round(x["n"] / total * 100, 1), F.coalesce(F.element_at("openers", x["w"]), F.lit(0.0))
        text = F.concat(F.lit("you open "), number(yours), F.lit('% of sentences with "'), x["w"], F.lit('", this draft opens '), number(rate), F.lit("% of them that way"))
        return _finding("sentenceOpeners", "Sentence openers", F.lit("medium"), text, F.lit("Vary how the sentences start."), x["w"], F.lit(None), F.lit(None), rate, F.lit(None), F.lit(BASE_PENALTY), F.array("top_opener"))

    heavy = lambda x: (x["n"] >= 3) & (js_round(x["n"] / total * 100, 1) >= 20) & (js_round(x["n"] / total * 100, 1) >= 2.5 * F.coalesce(F.element_at("openers", x["w"]), F.lit(0.0)))

    def absent(x: Column) -> Column:
        quoted = F.when(x["label"].rlike(" \\(.+\\)$"), F.regexp_replace(x["label"], "^(.+?) (\\(.+\\))$", '"$1" $2')).otherwise(F.concat(F.lit('"'), x["label"], F.lit('"')))
        times = F.when(x["n"] == 1, "once").when(x["n"] == 2, "twice").otherwise(F.concat(x["n"].cast("string"), F.lit(" times")))
        text = F.concat(F.lit("you never write "), quoted, F.lit(" across "), F.col("total_words").cast("string"), F.lit(" words, this draft uses it "), times)
        return _finding("absentWords", "Word you never use", F.lit("high"), text, F.lit(""), x["label"], F.lit(None), F.lit(None), x["n"], F.lit(None), F.least(F.lit(MAX_PENALTY), BASE_PENALTY + (x["n"] - 1) * 3))

    empty = F.array().cast(FINDING)
    words = F.array_sort(F.filter("uses", lambda x: F.array_contains("absent", x["label"])), lambda a, b: F.when(a["label"] < b["label"], -1).otherwise(1))
    found = F.concat(
        *[_band(metric, F.col("values"), F.col("bands"), F.col("evidence")) for metric in PHRASING],
        F.when(F.col("absent_available"), F.transform(words, absent).cast(FINDING)).otherwise(empty),
        F.when(F.col("openers_available") & (total >= 5), F.transform(F.filter(tops, heavy), opener).cast(FINDING)).otherwise(empty),
    )
    ranked = F.array_sort(F.transform(found, lambda x, i: F.struct((-x["penalty"]).alias("a"), i.alias("i"), x.alias("x"))))
    step = step.select("*", F.when(on, F.transform(ranked, lambda z: z["x"])).otherwise(empty).alias("findings"))
    deducted = F.aggregate("findings", F.lit(0), lambda acc, x: acc + x["penalty"])
    missing = F.filter(
        F.array(
            *[F.when(~F.coalesce(F.element_at("bands", F.lit(x))["available"], F.lit(False)), x) for x in PHRASING],
            F.when(~F.coalesce("absent_available", F.lit(False)), "absentWords"),
            F.when(~F.coalesce("openers_available", F.lit(False)), "sentenceOpeners"),
            F.when(~F.coalesce("paragraph_openers_available", F.lit(False)), "paragraphOpeners"),
            F.when(~F.coalesce("signature_available", F.lit(False)), "signatureWords"),
        ),
        lambda x: x.isNotNull(),
    )
    score = F.when(on, scoring.clamp(100 - deducted).cast("int"))
    out = settle(
        step, ["kept"], available=on, reason=F.col("reason"), score=score, band=F.when(on, scoring.band(score, scoring.VOICE_BANDS)), deducted=F.when(on, deducted), findings=F.col("findings"),
        unavailable=F.when(F.col("bands").isNotNull(), missing).otherwise(F.array().cast("array<string>")), words=F.col("words"),
    )
    return out.select("kept.*", *[c for c in out.columns if c != "kept"])
