"""Linguistic measurements of a text, as Spark columns."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import regex as R

WORD = "[A-Za-z][A-Za-z'’-]*"
CLOSERS = "[\"'”’)\\]]*"
ABBREVIATIONS = "Mr|Mrs|Ms|Dr|Prof|Sr|Jr|St|vs|etc|e\\.g|i\\.e|approx|Inc|Ltd|Co"
CONTRACTION = "(?i)\\b\\w+['’](?:t|s|re|ve|ll|d|m)\\b"
BAND_METRICS = ("sentenceLength", "paragraphLength", "commaRate", "semicolonRate", "dashRate", "parentheticalRate", "contractionRate", "readingLevel")


def words(x: Column) -> Column:
    return R.find(x, WORD)


def word_count(x: Column) -> Column:
    """Number of ASCII-letter words."""
    return R.count(x, WORD)


def has_wide_space(x: Column) -> Column:
    """Whether x has white space beyond ASCII: searches for the few such characters, which cost next to nothing."""
    return reduce(or_, [x.contains(c) for c in R.WIDE_SPACES])


def token_count(x: Column, wide: Column | None = None) -> Column:
    """Number of white-space tokens, another count than word_count. wide: whether to look for spaces beyond ASCII.

    A class of Unicode spaces is several times as slow as Java's own, so it is only used where there are any.
    """
    return F.when(has_wide_space(x) if wide is None else wide, R.count(x, "\\S+")).otherwise(F.regexp_count(x, F.lit("\\S+")))


def clean_for_prose(x: Column) -> Column:
    """Without fenced and indented code, headings, quote and list markers and back-ticks."""
    steps = (
        ("```[\\s\\S]*?```", " "),
        ("(?md)^[ \\t]{4,}\\S.*$", " "),
        ("(?md)^\\s*#{1,6}\\s.*$", " "),
        ("(?md)^\\s*>+\\s?", ""),
        ("(?md)^\\s*(?:[-*+•]|\\d+[.)])\\s+", ""),
        ("`([^`]*)`", "$1"),
    )
    for pattern, by in steps:
        x = R.replace(x, pattern, by)
    return x


_DOT = "\ue000"  # stands for a full stop that ends no sentence


def sentences(x: Column) -> Column:
    """Sentences: split after terminal punctuation, closing quotes and white space; fragments under four words go."""
    # Looked for from the full stop backwards, as full stops are rare.
    x = F.regexp_replace(x, f"(?i)\\.(?<=(?<![A-Za-z0-9_])(?:{ABBREVIATIONS})\\.)", _DOT)
    x = F.regexp_replace(x, "\\.(?<=(?<![A-Za-z0-9_])[A-Z]\\.)", _DOT)
    parts = F.transform(R.split(x, f"(?<=[.!?]){CLOSERS}\\s+"), lambda s: R.trim(F.translate(s, _DOT, ".")))
    ends = lambda s: F.right(s, F.lit(1)).isin(".", "!", "?") | R.matches(s, f"[.!?]{CLOSERS}$")
    return F.filter(parts, lambda s: F.when(ends(s), s.rlike("[A-Za-z]")).otherwise(word_count(s) >= 4))


def paragraphs(x: Column) -> Column:
    return F.filter(F.transform(R.split(x, "\\n\\s*\\n+"), R.trim), lambda p: R.matches(p, "[A-Za-z]"))


def _silent_endings(longs: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(longs, "(?:[^laeiouy ]es|ed|[^laeiouy ]e)(?![a-z])", ""), "(?<![a-z])y", "")


def mean(lengths: Column) -> Column:
    """Mean of an integer array as a double; null when it is empty."""
    return F.when(F.size(lengths) > 0, F.aggregate(lengths, F.lit(0).cast("long"), lambda a, b: a + b).cast("double") / F.size(lengths))


def first_words(parts: Column) -> Column:
    found = F.transform(parts, lambda s: F.lower(F.regexp_extract(s, WORD, 0)))
    return F.filter(found, lambda w: w != "")


FIELDS = ("clean", "word_list", "words", "sentences", "openers", "para_openers", "syllables", "values")


def measure(docs: DataFrame, text_col: str = "text", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """docs with a struct column m: what one text gives before pooling. A null text counts as empty.

    m has the fields asked for: clean, word_list, words, sentences, openers, para_openers, syllables and values, a struct
    of the eight band metrics (null where a text has no sentence or paragraph). Only what they need is worked out, in one
    pass over the rows, without a shuffle.
    """
    cols, asked = [c for c in docs.columns if c != "m"], set(fields)
    counted = bool(asked & {"word_list", "words", "syllables", "values"})
    parted, stacked = bool(asked & {"sentences", "openers", "values"}), bool(asked & {"para_openers", "values"})
    clean = F.col("__clean")
    step = docs.select(*cols, clean_for_prose(F.coalesce(F.col(text_col), F.lit(""))).alias("__clean"))
    more = [(counted, words(clean), "__words"), (parted, sentences(clean), "__sents"), (stacked, paragraphs(clean), "__paras")]
    step = step.select("*", *[made.alias(name) for needed, made, name in more if needed])
    n, s = F.size("__words"), F.size("__sents")
    if asked & {"syllables", "values"}:
        # Syllables, by passes over all words at once. A word of up to three letters has one. Of others a silent ending
        # and a leading y go, and runs of one or two vowels count, one at least.
        step = step.select("*", F.translate(F.lower(F.array_join("__words", " ")), "'’-", "").alias("__letters"))
        step = step.select("*", F.regexp_replace("__letters", "(?<![a-z])[a-z]{1,3}(?![a-z])", "").alias("__longs"))
        step = step.select("*", _silent_endings(F.col("__longs")).alias("__stems"))
        vowelless = F.regexp_count("__longs", F.lit("[a-z]+")) - F.regexp_count("__stems", F.lit("[a-z]*[aeiouy][a-z]*"))
        short = n - F.regexp_count("__longs", F.lit("[a-z]+"))
        step = step.select("*", (short + F.regexp_count("__stems", F.lit("[aeiouy]{1,2}")) + vowelless).alias("__syllables"))
    made = {"clean": clean, "words": n, "sentences": F.col("__sents"), "syllables": F.col("__syllables"), "openers": first_words(F.col("__sents")), "para_openers": first_words(F.col("__paras")), "word_list": F.transform("__words", F.lower)}
    if "values" in asked:
        # A lone paragraph has the sentences of the text.
        para_lengths = F.when(F.size("__paras") == 1, F.array(s)).otherwise(F.transform("__paras", lambda p: F.size(sentences(p))))
        step = step.select("*", mean(F.transform("__sents", word_count)).alias("__sentence"), mean(para_lengths).alias("__paragraph"), n.alias("__n"))
        contracted = F.size(F.filter("__sents", lambda x: (x.contains("'") | x.contains("’")) & R.matches(x, CONTRACTION)))
        per100 = lambda pattern: F.when(F.col("__n") > 0, 100.0 * R.count(clean, pattern) / F.col("__n")).otherwise(0.0)
        grade = F.when((F.col("__n") > 0) & (s > 0), 0.39 * (F.col("__n") / s) + 11.8 * (F.col("__syllables") / F.col("__n")) - 15.59).otherwise(0.0)
        made["values"] = F.struct(
            F.col("__sentence").alias("sentenceLength"),
            F.col("__paragraph").alias("paragraphLength"),
            per100(",").alias("commaRate"),
            per100(";").alias("semicolonRate"),
            per100("—|–|\\s-\\s").alias("dashRate"),
            per100("\\([^)]*\\)").alias("parentheticalRate"),
            F.when(s > 0, 100.0 * contracted / s).alias("contractionRate"),
            F.greatest(F.lit(0.0), grade).alias("readingLevel"),
        )
    return step.select(*cols, F.struct(*[made[f].alias(f) for f in FIELDS if f in asked]).alias("m"))
