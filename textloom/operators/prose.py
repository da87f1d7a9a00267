"""Prose detector: phrase and word tells of generated text, and stylometric ones, as findings and a base score.

The lexicons are this engine's own. Weights follow severity; the base score is their sum over the deduplicated
findings, divided by max(1, log2(words / 50)).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import regex as R
from textloom.functions import text as T
from textloom.operators.resume import ISSUE
from textloom.operators.scoring import SEVERITY_WEIGHT, clamp, weigh

#: (type, severity, pattern, suggestion). One hit is enough.
PHRASES = (
    ("tier1-word", "high", "delv(?:e|es|ed|ing)", "dig, look"),
    ("tier1-word", "high", "leverag(?:e|es|ed|ing)", "use"),
    ("tier1-word", "high", "utiliz(?:e|es|ed|ing)", "use"),
    ("tier1-word", "high", "robust", "strong, reliable, solid"),
    ("tier1-word", "high", "cutting-edge", "latest, newest"),
    ("tier1-word", "high", "watershed(?: moment)?", "turning point, shift"),
    ("tier1-word", "high", "poised", "ready"),
    ("tier1-word", "high", "cornerstone", "foundation"),
    ("tier1-word", "high", "testament to", "shows"),
    ("tier1-word", "high", "tapestry", "mix"),
    ("tier1-word", "high", "revolutioni[sz](?:e|es|ed|ing)", "change"),
    ("tier1-word", "high", "spearhead(?:s|ed|ing)?", "lead"),
    ("tier1-word", "high", "landscapes?", "field"),
    ("tier1-word", "high", "multifaceted", "complex"),
    ("tier1-word", "high", "holistic", "whole"),
    ("tier1-word", "high", "synerg(?:y|ies|istic)", "say what combined"),
    ("tier1-word", "high", "esteemed", "cut"),
    ("transition", "medium", "moreover", ""),
    ("transition", "medium", "furthermore", ""),
    ("transition", "medium", "additionally", ""),
    ("transition", "medium", "nevertheless", ""),
    ("transition", "medium", "in conclusion", ""),
    ("transition", "medium", "in summary", ""),
    ("filler", "high", "it(?:'s| is) (?:important|worth|crucial) (?:to note|noting|to remember) that", ""),
    ("filler", "medium", "it(?:'s| is) (?:important to note|worth noting)(?! that)", ""),
    ("filler", "high", "in today['’]s(?: (?:rapidly|fast|ever)[- ]?(?:evolving|changing|paced))?", "name the time or the change"),
    ("filler", "medium", "when it comes to", "for"),
    ("filler", "medium", "at the end of the day", ""),
    ("chatbot", "critical", "as an ai(?: language)? model", ""),
    ("chatbot", "high", "i hope this helps", ""),
    ("chatbot", "high", "certainly!", ""),
    ("acknowledgment-loop", "high", "great question", ""),
    ("vague-attribution", "high", "(?:experts|scholars|critics|analysts) (?:believe|agree|argue|suggest)", "name the expert"),
    ("vague-attribution", "high", "studies (?:show|suggest|have shown)", "name the study"),
    ("generic-conclusion", "high", "(?:the )?future (?:of [\\w ]{1,40} )?(?:is|looks) bright", "say what happens next"),
    ("generic-conclusion", "medium", "only time will tell", "say what would tell"),
    ("future-narrative", "medium", "nothing short of", "say what it is"),
    ("future-narrative", "medium", "(?:journey|road|path) ahead", "say what comes next"),
    ("future-narrative", "medium", "embark(?:s|ed|ing)? (?:up)?on", "start"),
    ("hedge-stack", "low", "(?:may|might|could) (?:possibly|potentially|perhaps)", "pick one hedge"),
    ("emotional-flatline", "medium", "(?:excited|thrilled|honored) to (?:embark|announce|share)", "say what you did"),
    ("stock-phrase", "medium", "(?:far )?more than (?:just )?a", "say what it is"),
    ("stock-phrase", "medium", "not (?:merely|just|only) an? [\\w-]+ but", "say what it is"),
    ("stock-phrase", "medium", "throughout my (?:career|journey)", "name the years"),
    ("stock-phrase", "medium", "(?:valuable asset|proven track record|unique blend)", "show it"),
    ("stock-phrase", "medium", "meaningful (?:impact|improvements?|change)", "give the number"),
    ("stock-phrase", "medium", "deep (?:understanding|appreciation)", "show it"),
    ("stock-phrase", "medium", "unlock(?:s|ed|ing)? (?:the|unprecedented|new)", "open"),
)
#: Words that tell only together: TIER2_CLUSTER different ones in one text.
TIER2 = (
    ("navigat(?:e|es|ed|ing)", "handle"),
    ("foster(?:s|ed|ing)?", "build"),
    ("journeys?", "work"),
    ("transformative", "big"),
    ("transformation", "change"),
    ("boast(?:s|ed|ing)?", "offer"),
    ("unprecedented", "new"),
    ("embrac(?:e|es|ed|ing)", "accept"),
    ("intricate", "detailed"),
    ("invaluable", "useful"),
    ("seamless(?:ly)?", "smooth"),
    ("myriad", "many"),
    ("pivotal", "key"),
    ("flourish(?:es|ed|ing)?", "grow"),
    ("realm", "area"),
    ("paradigm", "model"),
    ("stakeholders?", "name who"),
    ("ecosystems?", "tools"),
    ("showcas(?:e|es|ed|ing)", "show"),
    ("underscor(?:e|es|ed|ing)", "show"),
)
TIER2_CLUSTER = 3
#: Not looked for in technical contexts.
GENERAL_ONLY = (
    ("copula", "medium", "(?:serves?|served|stands?|stood) as an?", "say is or are"),
    ("copula", "medium", "represents? an?", "say is or are"),
)
TITLE_CASE = "(?md)^#{1,6}[ \\t]+(?:(?:[A-Z][\\w'’-]*|of|the|and|in|to|for|a|an|on|with)(?:[ \\t]+|$)){4,}$"
TYPE_LABELS = {
    "tier1-word": "Overused word",
    "tier2-word": "Clustered word",
    "transition": "Stock transition",
    "filler": "Filler",
    "chatbot": "Chatbot phrase",
    "acknowledgment-loop": "Acknowledgment",
    "vague-attribution": "Vague attribution",
    "generic-conclusion": "Generic conclusion",
    "future-narrative": "Future narrative",
    "hedge-stack": "Stacked hedges",
    "emotional-flatline": "Stock emotion",
    "stock-phrase": "Stock phrase",
    "copula": "Inflated 'is'",
    "title-case-header": "Title Case header",
    "uniformity": "Uniform sentences",
    "low-ttr": "Small vocabulary",
    "punct-distribution": "Dash density",
    "cross-para-burstiness": "Even paragraphs",
}


def _issue(type_: str, severity: str, text: Column, suggestion: str) -> Column:
    return F.struct(F.lit(type_).alias("type"), F.lit("ai").alias("grp"), F.lit(severity).alias("severity"), F.lit(SEVERITY_WEIGHT[severity]).alias("weight"), text.alias("text"), F.lit(suggestion).alias("suggestion"), F.lit(None).cast("int").alias("line"))


def _word_pattern(pattern: str) -> str:
    tail = "\\b" if pattern[-1] not in "!)" or pattern.endswith(("e)", "g)", "d)", "s)?", "c)", "e)?")) else ""
    spaced = pattern.replace(" ", "\\s+") if "[\\w " not in pattern else pattern
    return f"(?i)\\b(?:{spaced}){tail}"


def _hits(text: Column, rows: tuple) -> Column:
    """Issues of every match of rows, after one test of all patterns together."""
    told = R.table([{"java": R.java(_word_pattern(pattern)), "type": type_, "severity": severity, "weight": SEVERITY_WEIGHT[severity], "suggestion": suggestion} for type_, severity, pattern, suggestion in rows])

    def issue(row: Column, match: Column) -> Column:
        return F.struct(row["type"].alias("type"), F.lit("ai").alias("grp"), row["severity"].alias("severity"), row["weight"].alias("weight"), F.regexp_replace(match, f"[{R.SPACE}]+", " ").alias("text"), row["suggestion"].alias("suggestion"), F.lit(None).cast("int").alias("line"))

    found = F.flatten(F.transform(told, lambda row: F.transform(F.regexp_extract_all(text, row["java"], F.lit(0)), lambda m: issue(row, m))))
    gate = f"(?i)(?<![A-Za-z0-9_])(?:{'|'.join(_word_pattern(r[2]).removeprefix('(?i)').removeprefix(chr(92) + 'b') for r in rows)})"  # all begin a word
    return F.when(R.matches(text, gate), found.cast(ISSUE)).otherwise(F.array().cast(ISSUE))


def _one(when: Column, issue: Column) -> Column:
    return F.when(when, F.array(issue).cast(ISSUE)).otherwise(F.array().cast(ISSUE))


def analyze(docs: DataFrame, text_col: str = "text", technical: Column | None = None) -> DataFrame:
    """docs with a struct column p: score (base), issues, words, classification, confidence.

    technical (a boolean over docs) suppresses the header and copula findings. issues are deduplicated by type and
    lower-cased text, the first staying. A null text counts as empty. One pass over the rows, no shuffle.
    """
    cols = [c for c in docs.columns if c != "p"]
    text = F.coalesce(F.col(text_col), F.lit(""))
    general = F.lit(True) if technical is None else ~technical
    tier2 = tuple(("tier2-word", "medium", p, fix) for p, fix in TIER2)
    step = docs.select(*cols, T.token_count(text).alias("__wc"), _hits(text, tier2).alias("__tier2"), T.sentences(T.clean_for_prose(text)).alias("__sents"), general.alias("__general"))
    step = step.select("*", F.transform("__sents", T.word_count).alias("__len"), R.count(text, "—").alias("__dashes"), T.paragraphs(text).alias("__ps"), F.size(F.array_distinct(F.transform(T.words(text), F.lower))).alias("__distinct"))
    # The rhythm of paragraphs is only looked at where there are enough of them.
    rhythm = F.transform("__ps", lambda p: T.mean(F.transform(T.sentences(p), T.word_count)))
    step = step.select("*", F.when(F.size("__ps") >= 5, rhythm).otherwise(F.array().cast("array<double>")).alias("__paras"))
    lengths, n = F.col("__len"), F.size("__len")
    spread = lambda xs, avg: F.try_divide(F.sqrt(F.try_divide(F.aggregate(xs, F.lit(0.0), lambda a, x: a + (x - avg) * (x - avg)), F.size(xs))), avg)
    average = T.mean(lengths)
    paras = F.filter("__paras", lambda x: x.isNotNull())
    para_mean = F.try_divide(F.aggregate(paras, F.lit(0.0), lambda a, x: a + x), F.size(paras))
    distinct = F.col("__distinct")
    clustered = F.size(F.array_distinct(F.transform("__tier2", lambda x: F.lower(x["text"])))) >= TIER2_CLUSTER
    issues = F.concat(
        _hits(text, PHRASES),
        F.when(clustered, F.col("__tier2")).otherwise(F.array().cast(ISSUE)),
        F.when(F.col("__general"), F.concat(_hits(text, GENERAL_ONLY), F.transform(R.find(text, TITLE_CASE), lambda m: _issue("title-case-header", "low", R.trim(m), "Use sentence case.")).cast(ISSUE))).otherwise(F.array().cast(ISSUE)),
        _one((n >= 8) & (average >= 8) & (spread(lengths, average) < 0.12), _issue("uniformity", "medium", F.concat(n.cast("string"), F.lit(" sentences of nearly one length")), "Let some run short and some long.")),
        _one((F.col("__wc") >= 200) & (distinct / F.sqrt(F.col("__wc").cast("double")) < 3.0), _issue("low-ttr", "low", F.concat(distinct.cast("string"), F.lit(" different words")), "Say fewer things more exactly.")),
        _one((F.col("__dashes") >= 6) & (F.col("__dashes") * 100.0 / F.greatest(F.col("__wc"), F.lit(1)) > 3.0), _issue("punct-distribution", "low", F.concat(F.col("__dashes").cast("string"), F.lit(" em dashes")), "Use commas and full stops.")),
        _one((F.size(paras) >= 5) & (para_mean >= 8) & (spread(paras, para_mean) < 0.05), _issue("cross-para-burstiness", "low", F.concat(F.size(paras).cast("string"), F.lit(" paragraphs of one rhythm")), "Vary the paragraphs.")),
    )
    step = step.select(*cols, "__wc", issues.alias("__all"))
    key = lambda x: F.concat(x["type"], F.lit("::"), F.lower(x["text"]))
    step = step.select("*", F.transform("__all", key).alias("__keys"))
    step = step.select("*", F.filter("__all", lambda x, i: F.array_position("__keys", key(x)) == i + 1).alias("__kept"))
    raw = F.aggregate("__kept", F.lit(0.0), lambda a, x: a + weigh(x["severity"], x["weight"]))
    score = clamp(raw / F.greatest(F.lit(1.0), F.log2(F.greatest(F.col("__wc"), F.lit(1)) / 50.0)))
    p = F.struct(
        score.alias("score"),
        F.col("__kept").alias("issues"),
        F.col("__wc").alias("words"),
        F.when(score > 60, "machine").when(score > 25, "mixed").otherwise("human").alias("classification"),
        F.when(F.col("__wc") < 40, "low").when((score > 75) | (score < 10), "high").otherwise("medium").alias("confidence"),
    )
    return step.select(*cols, p.alias("p"))
