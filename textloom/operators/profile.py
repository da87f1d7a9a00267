"""Style profiles: what an author's own samples show, metric by metric, each only with enough words behind it."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import regex as R
from textloom.functions import text as T
from textloom.functions.barrier import settle
from textloom.functions.regex import js_round
from textloom.operators.house import slug

# Metrics, as id, label, unit, written only, words needed.
METRICS = (
    ("sentenceLength", "Sentence length", "words", True, 400),
    ("paragraphLength", "Paragraph length", "sentences", True, 800),
    ("commaRate", "Commas", "per 100 words", True, 500),
    ("semicolonRate", "Semicolons", "per 100 words", True, 1000),
    ("dashRate", "Dashes", "per 100 words", True, 1000),
    ("parentheticalRate", "Parentheticals", "per 100 words", True, 1000),
    ("contractionRate", "Contractions", "% of sentences", True, 500),
    ("readingLevel", "Reading level", "grade", True, 400),
    ("sentenceOpeners", "Sentence openers", "% of sentences", True, 600),
    ("paragraphOpeners", "Paragraph openers", "% of paragraphs", True, 1500),
    ("signatureWords", "Words you lean on", "per 100k words", False, 1500),
    ("absentWords", "Words you never use", "absent", False, 3000),
)
# Words whose absence is worth reporting; a pair has a label and a pattern.
ABSENCE_CANDIDATES = [
    "furthermore", "moreover", "additionally", "consequently", "subsequently", "nevertheless", "nonetheless", "notwithstanding", "albeit", "whilst",
    "amongst", "hence", "thereby", "therein", "whereby", "heretofore", "insofar", "thus", "therefore", "accordingly", "likewise", "essentially",
    "fundamentally", "ultimately", "arguably", "undoubtedly", "indeed", "certainly", "obviously", "clearly", "notably", "importantly",
    "significantly", "substantially", "considerably", "remarkably", "genuinely", "precisely", "plainly", "materially", "crucially", "concretely",
    "structurally", "worth noting", "utilize", "leverage", "delve", "robust", "myriad", "plethora", "paradigm", "holistic", "synergy", "seamless",
    "pivotal", "crucial", "vital", "comprehensive", "innovative", "cutting-edge", "state-of-the-art", "landscape", "ecosystem", "framework",
    "methodology", "stakeholder", "actionable", "impactful", "transformative", "unprecedented", "orthogonal", "adjacent", "nuance", "framing",
    "unpack", "load-bearing", "at scale", "lean into",
]
SURFACE = ("surface-verb", "surface (as a verb)", "(?i)\\bsurfac(?:ed|ing)\\b|\\bsurfaces?\\b(?=\\s+(?:the|a|an|it|this|that|these|those|any|some|all|more|issues?|problems?|risks?|concerns?|questions?|tensions?|tradeoffs?|trade-offs?|assumptions?|disagreements?)\\b)")
# Rates per million words of general English, and further words that are never a signature.
BASELINE = {
    "the": 56000, "of": 33000, "and": 29000, "to": 26000, "a": 21000, "in": 18000, "is": 10000, "it": 10000, "you": 9500, "that": 9000, "he": 8000,
    "was": 7000, "for": 7000, "on": 6500, "are": 6000, "with": 5800, "as": 5500, "i": 5500, "his": 5000, "they": 4800, "be": 4600, "at": 4500,
    "one": 4000, "have": 3900, "this": 3800, "from": 3700, "or": 3600, "had": 3400, "by": 3300, "not": 3200, "but": 3100, "what": 3000, "all": 2900,
    "were": 2800, "we": 2700, "when": 2600, "your": 2500, "can": 2400, "said": 2300, "there": 2200, "use": 2100, "an": 2000, "each": 1900,
    "which": 1900, "she": 1800, "do": 1800, "how": 1700, "their": 1700, "if": 1700, "will": 1600, "up": 1600, "other": 1500, "about": 1500,
    "out": 1400, "many": 1300, "then": 1300, "them": 1300, "these": 1200, "so": 1200, "some": 1200, "her": 1100, "would": 1100, "make": 1000,
    "like": 1000, "him": 1000, "into": 950, "time": 950, "has": 900, "look": 850, "two": 850, "more": 850, "write": 800, "go": 800, "see": 800,
    "number": 750, "no": 750, "way": 750, "could": 700, "people": 700, "my": 700, "than": 650, "first": 650, "been": 650, "call": 600, "who": 600,
    "its": 600, "now": 600, "find": 550, "long": 550, "down": 550, "day": 550, "did": 500, "get": 500, "come": 500, "made": 500, "may": 500,
    "part": 450, "over": 450, "new": 450, "sound": 400, "take": 400, "only": 400, "little": 400, "work": 400, "know": 400, "place": 350,
    "years": 350, "live": 350, "me": 350, "back": 350, "give": 300, "most": 300, "very": 300, "after": 300, "thing": 300, "our": 300, "just": 300,
    "name": 250, "good": 250, "sentence": 250, "man": 250, "think": 250, "say": 250, "great": 200, "where": 200, "help": 200, "through": 200,
    "much": 200, "before": 200, "line": 200, "right": 200, "too": 200, "mean": 150, "old": 150, "any": 150, "same": 150, "tell": 150, "boy": 150,
    "follow": 150, "came": 150, "want": 150, "show": 150, "also": 150, "around": 100, "form": 100, "three": 100, "small": 100, "set": 100,
    "put": 100, "end": 100, "does": 100, "another": 100, "well": 100, "large": 100, "must": 100, "big": 100, "even": 100, "such": 100,
    "because": 100, "turn": 100, "here": 100, "why": 100, "ask": 100, "went": 100, "men": 100, "read": 100, "need": 100, "land": 100,
    "different": 100, "home": 100, "us": 100, "move": 100, "try": 100, "kind": 100, "hand": 100, "picture": 100, "again": 100, "change": 100,
    "off": 100, "play": 100, "spell": 100, "air": 100, "away": 100, "animal": 100, "house": 100, "point": 100, "page": 100, "letter": 100,
    "mother": 100, "answer": 100, "found": 100, "study": 100, "still": 100, "learn": 100, "should": 100, "america": 100, "world": 100,
}
BASELINE_FLOOR = 20
MORE_STOPWORDS = [
    "am", "been", "being", "both", "during", "few", "further", "having", "itself", "myself", "nor", "once", "own", "same", "themselves", "those",
    "under", "until", "while", "yourself", "ours", "yours", "theirs",
]
STOPWORDS = sorted({*BASELINE, *MORE_STOPWORDS})
FORMAT, VERSION = "textloom/fingerprint", 1
TOP_OPENERS, TOP_SIGNATURE, ABSENCE_STOP = 12, 15, 501
MAX_LABELS = 1_000


class ProfileError(ValueError):
    """A profile that can't be read, with a message for a person."""


def candidates() -> list[tuple[str, str, str]]:
    """(id, label, Java pattern) of every absence candidate."""
    out = []
    for label in ABSENCE_CANDIDATES:
        lead, tail = "\\b" if label[0].isalnum() else "", "\\b" if label[-1].isalnum() else ""
        body = label.replace("-", "\\-").replace(" ", "\\s+")
        out.append((slug(label, None), label, R.java(f"(?i){lead}{body}{tail}")))
    return [*out, (SURFACE[0], SURFACE[1], R.java(SURFACE[2]))]


def absence_counts(clean: Column) -> Column:
    """array<struct<label, n>> of a cleaned text, for the candidates that occur; one test for all of them comes first."""
    rows = candidates()
    heads = [label.replace("-", "\\-").replace(" ", "\\s+") for label in ABSENCE_CANDIDATES] + ["surfac"]
    gate = R.java(f"(?i)(?<![A-Za-z0-9_])(?:{'|'.join(heads)})")  # all begin a word; what follows is for the counts
    counted = F.array(*[F.struct(F.lit(label).alias("label"), F.least(F.regexp_count(clean, F.lit(p)), F.lit(ABSENCE_STOP)).alias("n")) for _, label, p in rows])
    return F.when(clean.rlike(gate), F.filter(counted, lambda x: x["n"] > 0)).otherwise(F.array().cast("array<struct<label:string,n:int>>"))


#: What each part of a profile is made of.
NEEDS = {"counts": ("words",), "evidence": ("sentences", "values"), "bands": ("words", "values"), "openers": ("openers",), "para_openers": ("para_openers",), "signature": ("word_list",), "absent": ("clean",)}


def measured(samples: DataFrame, *parts: str) -> DataFrame:
    """(author, sample, label, type, m) of usable samples, m with what these parts of a profile need (all, if none is named)."""
    fields = {f for part in parts or NEEDS for f in NEEDS[part]}
    return T.measure(samples.select("author", "sample", "label", "type", "text"), fields=tuple(fields)).select("author", "sample", "label", "type", "m")


def words_by_author(m: DataFrame) -> DataFrame:
    n = F.col("m.words").cast("long")
    written = F.col("type") == "written"
    return m.groupBy("author").agg(F.count(F.lit(1)).alias("samples"), F.count_if(written).alias("written_samples"), F.count_if(~written).alias("spoken_samples"), F.sum(n).alias("total_words"), F.coalesce(F.sum(F.when(F.col("type") == "written", n)), F.lit(0)).cast("long").alias("written_words"))


def bands(m: DataFrame) -> DataFrame:
    """author, metric, available, have, need, samples, mean, sd, low, high: the eight numeric metrics, spoken samples aside.

    An unavailable metric has no numbers. sd is the sample one, 0 for one value; numbers have one decimal. One shuffle,
    of one row an author from each task.
    """
    facts = {mid: need for mid, _, _, _, need in METRICS}
    written = lambda c: F.when(F.col("type") == "written", c)
    made = {"n": F.count, "mean": F.avg, "sd": F.stddev_samp, "low": F.min, "high": F.max}
    pooled = m.groupBy("author").agg(
        F.coalesce(F.sum(written(F.col("m.words").cast("long"))), F.lit(0)).cast("long").alias("have"),
        *[F.struct(*[f(written(F.col(f"m.values.{x}"))).alias(name) for name, f in made.items()]).alias(x) for x in T.BAND_METRICS],
    )
    every = pooled.select("author", "have", F.inline(F.array(*[F.struct(F.lit(x).alias("metric"), F.lit(facts[x]).alias("need"), F.col(x).alias("v")) for x in T.BAND_METRICS])))
    ok = (F.col("have") >= F.col("need")) & (F.col("v.n") >= 2)
    numbers = [("mean", F.col("v.mean")), ("sd", F.coalesce("v.sd", F.lit(0.0))), ("low", F.col("v.low")), ("high", F.col("v.high"))]
    return every.select("author", "metric", ok.alias("available"), "have", "need", F.col("v.n").alias("samples"), *[F.when(ok, js_round(c, 1)).alias(name) for name, c in numbers])


def openers(m: DataFrame, field: str = "openers", most: int = TOP_OPENERS) -> DataFrame:
    """author, word, cnt, total, distinct_words, rate, rank: the commonest first words of sentences (or paragraphs).

    Ties keep the order of first appearance, over samples and then places.
    """
    each = settle(m.filter(F.col("type") == "written"), ["author", "sample"], words=F.col(f"m.{field}")).select("author", "sample", F.posexplode("words").alias("pos", "word"))
    counts = each.groupBy("author", "word").agg(F.count(F.lit(1)).alias("cnt"), F.min(F.struct("sample", "pos")).alias("first"))
    # Totals come from the same counts, so that the texts are gone through once.
    own = Window.partitionBy("author")
    ranked = counts.withColumns({"rank": F.row_number().over(own.orderBy(F.desc("cnt"), "first")), "total": F.sum("cnt").over(own), "distinct_words": F.count(F.lit(1)).over(own)}).filter(F.col("rank") <= most)
    return ranked.select("author", "word", "cnt", "total", "distinct_words", js_round(F.col("cnt") / F.col("total") * 100, 1).alias("rate"), "rank")


EXCERPT, CONTRACTION_EXCERPT = 220, 200


def _excerpt(x: Column, most: int) -> Column:
    return F.when(F.length(x) > most, F.concat(F.left(x, F.lit(most - 1)), F.lit("…"))).otherwise(x)


def _sentence_picks(m: DataFrame) -> DataFrame:
    """author, place (0 to 2), sample, label, value, text: the shortest, the middle and the longest sentence.

    All sentences of an author in order of their length, then sample, then place. Lengths are counted first, so that only
    the places of three of them are looked for: no author's sentences are brought together.
    """
    lengths = settle(m, ["author", "sample", "label"], sents=F.col("m.sentences"), lens=F.transform("m.sentences", T.word_count))
    counted = lengths.select("author", F.explode("lens").alias("v")).groupBy("author", "v").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("author").orderBy("v")
    counted = counted.withColumn("before", F.sum("n").over(ahead) - F.col("n")).withColumn("total", F.sum("n").over(Window.partitionBy("author")))
    asked = F.array(F.lit(0).cast("long"), F.floor(F.col("total") / 2), F.col("total") - 1)
    wanted = counted.select("author", "v", "before", "n", F.posexplode(asked).alias("place", "at")).filter("at >= before AND at < before + n").select("author", "place", "v", (F.col("at") - F.col("before")).alias("k"))
    own = F.size(F.filter("lens", lambda x: x == F.col("v")))
    there = lengths.select("author", "sample", "lens").join(wanted, "author").select("author", "place", "v", "k", "sample", own.alias("c")).filter("c > 0")
    there = there.withColumn("passed", F.sum("c").over(Window.partitionBy("author", "place").orderBy("sample")) - F.col("c")).filter("k >= passed AND k < passed + c")
    found = lengths.join(there.select("author", "place", "sample", "v", (F.col("k") - F.col("passed")).cast("int").alias("i")), ["author", "sample"])
    text = F.filter(F.arrays_zip("sents", "lens"), lambda z: z["lens"] == F.col("v"))[F.col("i")]["sents"]
    return found.select("author", "place", "label", F.col("v").cast("double").alias("value"), _excerpt(text, EXCERPT).alias("text"))


def evidence(m: DataFrame) -> DataFrame:
    """author, metric, place, label, value, text: excerpts of written samples behind each numeric metric.

    For sentence length three sentences, for contractions the first three sentences that have one, otherwise the samples
    with the lowest and the highest value.
    """
    own = m.filter(F.col("type") == "written")
    units = {mid: unit for mid, _, unit, _, _ in METRICS}
    ends = [x for x in T.BAND_METRICS if x not in ("sentenceLength", "contractionRate")]
    entry = lambda x: F.when(F.col(f"m.values.{x}").isNotNull(), F.struct(F.col(f"m.values.{x}").alias("v"), "sample", "label"))
    pooled = own.groupBy("author").agg(*[F.array(F.min(entry(x)), F.max(entry(x))).alias(x) for x in ends])
    rows = pooled.select("author", F.inline(F.array(*[F.struct(F.lit(x).alias("metric"), F.lit(units[x]).alias("unit"), F.col(x).alias("ends")) for x in ends]))).select("author", "metric", "unit", F.posexplode("ends").alias("place", "x")).filter("x IS NOT NULL")
    value = js_round(F.col("x.v"), 1)
    shown = F.regexp_replace(value.cast("string"), "\\.0$", "")
    rows = rows.select("author", "metric", "place", F.col("x.label").alias("label"), value.alias("value"), F.concat("x.label", F.lit(": "), shown, F.lit(" "), "unit").alias("text"))
    has = lambda s: (s.contains("'") | s.contains("’")) & R.matches(s, T.CONTRACTION)
    first = settle(own, ["author", "sample", "label"], hits=F.slice(F.filter("m.sentences", has), 1, 3)).select("author", "sample", "label", F.posexplode("hits").alias("pos", "text"))
    first = first.withColumn("place", F.row_number().over(Window.partitionBy("author").orderBy("sample", "pos")) - 1).filter("place < 3")
    first = first.select("author", F.lit("contractionRate").alias("metric"), "place", "label", F.lit(None).cast("double").alias("value"), _excerpt(F.col("text"), CONTRACTION_EXCERPT).alias("text"))
    picks = _sentence_picks(own).select("author", F.lit("sentenceLength").alias("metric"), "place", "label", "value", "text")
    return rows.unionByName(first).unionByName(picks)


def signature_words(m: DataFrame, most: int = TOP_SIGNATURE) -> DataFrame:
    """author, word, cnt, spread, per100k, ratio, rank: words far above their baseline rate, in two samples at least."""
    spark = m.sparkSession
    each = settle(m, ["author", "sample"], words=F.col("m.word_list")).select("author", "sample", F.explode("words").alias("word"))
    by_sample = each.groupBy("author", "sample", "word").agg(F.count(F.lit(1)).alias("n"))
    counts = by_sample.groupBy("author", "word").agg(F.sum("n").alias("cnt"), F.count(F.lit(1)).alias("spread"))
    stop = F.broadcast(spark.createDataFrame([(w,) for w in STOPWORDS], "word string"))  # a fixed list
    base = F.broadcast(spark.createDataFrame(list(BASELINE.items()), "word string, base int"))  # a fixed list
    counts = counts.withColumn("total_words", F.sum("cnt").over(Window.partitionBy("author")))  # of the same pass over the texts
    kept = counts.filter((F.length("word") >= 4) & (F.col("spread") >= 2) & (F.col("cnt") >= 3)).join(stop, "word", "left_anti")
    kept = kept.join(base, "word", "left")
    ratio = F.col("cnt") / F.col("total_words") * 1e6 / F.coalesce(F.col("base"), F.lit(BASELINE_FLOOR))
    kept = kept.filter(ratio >= 3).select("author", "word", "cnt", "spread", js_round(F.col("cnt") / F.col("total_words") * 1e5, 1).alias("per100k"), js_round(ratio, 1).alias("ratio"))
    order = Window.partitionBy("author").orderBy(F.desc("ratio"), F.desc("cnt"), "word")
    return kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def absent_words(m: DataFrame) -> DataFrame:
    """author, word: candidates that no sample of the author has, a row each."""
    spark = m.sparkSession
    labels = F.array(*[F.lit(label) for _, label, _ in candidates()])
    used = settle(m, ["author"], uses=absence_counts(F.col("m.clean"))).select("author", F.explode("uses.label").alias("word")).distinct()
    authors = m.select("author").distinct()
    return authors.select("author", F.explode(labels).alias("word")).join(used, ["author", "word"], "left_anti")


def build(samples: DataFrame) -> DataFrame:
    """A row an author: what it was built from and its metrics, as the profile that voice.compare reads.

    bands: map metric -> struct(available, low, high, mean, sd, samples, have, need); openers and paragraph_openers: map
    word -> rate (top 12); absent: sorted labels; signature: array of struct; evidence: map metric -> array of struct.
    A part that has too few words behind it is null, and its *_available false. labels names the samples, in their order,
    the MAX_LABELS first of them. Each part reads samples for itself and measures no more than it needs: samples whose
    making is dear (a screening, say) are better persisted or stored before.
    """
    need = {mid: n for mid, _, _, _, n in METRICS}
    counts = words_by_author(measured(samples, "counts"))
    named = samples.select("author", "sample", "label").withColumn("n", F.row_number().over(Window.partitionBy("author").orderBy("sample"))).filter(F.col("n") <= MAX_LABELS)
    labels = named.groupBy("author").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "label"))), lambda x: x["label"]).alias("labels"))
    b = bands(measured(samples, "bands")).groupBy("author").agg(F.map_from_entries(F.collect_list(F.struct("metric", F.struct("available", "low", "high", "mean", "sd", "samples", "have", "need")))).alias("bands"))
    rated = lambda field, name: openers(measured(samples, field), field).groupBy("author").agg(F.map_from_entries(F.collect_list(F.struct("word", "rate"))).alias(name), F.min_by("word", "rank").alias(f"{name}_word"), F.min_by("cnt", "rank").alias(f"{name}_cnt"), F.first("total").alias(f"{name}_total"))
    s = signature_words(measured(samples, "signature")).groupBy("author").agg(F.sort_array(F.collect_list(F.struct("rank", "word", "cnt", "spread", "per100k", "ratio"))).alias("signature"))
    a = absent_words(measured(samples, "absent")).groupBy("author").agg(F.sort_array(F.collect_list("word")).alias("absent"))
    e = evidence(measured(samples, "evidence")).groupBy("author", "metric").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "label", "value", "text"))), lambda x: F.struct(x["label"].alias("sample"), x["value"].alias("value"), x["text"].alias("text"))).alias("x"))
    e = e.groupBy("author").agg(F.map_from_entries(F.collect_list(F.struct("metric", "x"))).alias("evidence"))
    out = counts
    for part in (labels, b, rated("openers", "openers"), rated("para_openers", "paragraph_openers"), s, a, e):
        out = out.join(part, "author", "left")
    has = lambda metric, col: F.col(col) >= need[metric]
    opened = has("sentenceOpeners", "written_words") & F.col("openers").isNotNull()
    top = F.struct(F.lit(None).cast("string").alias("sample"), F.element_at("openers", F.col("openers_word")).alias("value"), F.concat(F.lit('"'), "openers_word", F.lit('" opens '), F.col("openers_cnt").cast("string"), F.lit(" of "), F.col("openers_total").cast("string"), F.lit(" ("), F.regexp_replace(F.element_at("openers", F.col("openers_word")).cast("string"), "\\.0$", ""), F.lit("%)")).alias("text"))
    return out.select(
        "author", "samples", "written_samples", "spoken_samples", "total_words", "written_words", (F.col("total_words") - F.col("written_words")).alias("spoken_words"), "labels", "bands",
        opened.alias("openers_available"),
        F.when(opened, F.col("openers")).alias("openers"),
        F.when(opened, top).alias("top_opener"),
        (has("paragraphOpeners", "written_words") & F.col("paragraph_openers").isNotNull()).alias("paragraph_openers_available"),
        F.when(has("paragraphOpeners", "written_words"), F.col("paragraph_openers")).alias("paragraph_openers"),
        has("signatureWords", "total_words").alias("signature_available"),
        F.when(has("signatureWords", "total_words"), F.coalesce("signature", F.array().cast("array<struct<rank:int,word:string,cnt:bigint,spread:bigint,per100k:double,ratio:double>>"))).alias("signature"),
        has("absentWords", "total_words").alias("absent_available"),
        F.when(has("absentWords", "total_words"), F.coalesce("absent", F.array().cast("array<string>"))).alias("absent"),
        "evidence",
    )


def to_json(profile_row) -> str:
    """A profile row as JSON, with format and version."""
    return json.dumps({"format": FORMAT, "version": VERSION, "metrics": profile_row.asDict(recursive=True)}, ensure_ascii=False)


def from_json(source) -> dict:
    try:
        doc = json.loads(source) if isinstance(source, str) else source
    except ValueError as e:
        raise ProfileError(f"The profile can't be parsed as JSON ({e}).") from None
    if not isinstance(doc, dict):
        raise ProfileError("A profile must be a JSON object.")
    if not str(doc.get("format")).endswith("/fingerprint"):
        raise ProfileError(f'Not the format of a profile: "{doc.get("format")}".')
    if not isinstance(doc.get("metrics"), dict):
        raise ProfileError("The profile lacks its metrics.")
    return doc
