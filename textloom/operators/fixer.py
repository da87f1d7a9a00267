"""Conservative edits from findings: a plan of non-overlapping edits, and their application with seam repair.

Only a deletion of a self-contained connective, a swap for a stated plain word, or a house rule's own replacement is
applied; everything else stays for the writer.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import regex as R
from textloom.operators import house, prose, resume

# Openers that mark advice, types that may be deleted, types that are never edited.
INSTRUCTION_VERBS = [
    "describe", "name", "say", "give", "show", "explain", "state", "list", "pick", "drop", "replace", "attach", "put", "add", "aim", "keep", "split",
    "start", "group", "aimfor", "human", "every", "rule", "over",
]
DELETABLE = ("transition", "filler", "chatbot", "acknowledgment-loop")
NEVER_AUTO = [
    "vague-attribution", "uniformity", "low-ttr", "punct-distribution", "fnword-trigram-entropy", "cross-para-burstiness", "resume-unquantified",
    "resume-uniform-bullets", "resume-round-metrics", "resume-triad", "resume-missing-contact", "resume-missing-dates", "resume-missing-section",
    "resume-tense-mix", "resume-long-bullet", "resume-skill-dump", "generic-conclusion", "future-narrative", "hedge-stack", "emotional-flatline",
]
STANDALONE = "(?i)^(certainly|sure|absolutely|of course|great question)!?$"

_EDIT = "array<struct<start:int,end:int,replacement:string,kind:string,was:string,issue:int>>"


def parse_replacement(suggestion: str | None) -> tuple[str, str] | None:
    """('delete', ''), ('swap', text), or None for advice."""
    raw = (suggestion or "").strip()
    if not raw:
        return None
    if re.match(r"cut\b", raw, re.I):
        return "delete", ""
    head = re.split(r"\s+—\s+", raw)[0].strip()
    first = re.split(r"\s*[,/]\s*", head)[0].strip()
    if not first or len(first) > 40:
        return None
    if re.sub("[^a-z]", "", first.split()[0].lower()) in INSTRUCTION_VERBS:
        return None
    if re.search(r"\b(what|which|the actual|instead|rather)\b", head, re.I):
        return None
    return "swap", first


def known_suggestions() -> dict[str, tuple[str, str]]:
    """Suggestion -> parsed replacement, for all rule tables; what isn't in it is advice."""
    tables = (resume.CLICHES, resume.STRONG_VERBS, resume.SOFT_VERBS, resume.VAGUE_IMPACT, resume.WEAK_OPENERS)
    told = {fix for t in tables for _, fix in t} | {r[3] for r in (*prose.PHRASES, *prose.GENERAL_ONLY)} | {fix for _, fix in prose.TIER2}
    return {s: p for s in sorted(told) if (p := parse_replacement(s))}


def match_case(original: Column, replacement: Column) -> Column:
    letters = F.regexp_replace(original, "[^A-Za-z]", "")
    shouting = (F.length(letters) > 1) & (letters == F.upper(letters))
    capital = F.left(letters, F.lit(1)) == F.upper(F.left(letters, F.lit(1)))
    raised = F.concat(F.upper(F.left(replacement, F.lit(1))), F.substr(replacement, F.lit(2)))
    return F.when((replacement == "") | (letters == ""), replacement).when(shouting, F.upper(replacement)).when(capital, raised).otherwise(replacement)


def inflect(original: Column, replacement: Column) -> Column:
    """The -ing participle carried over to a one-word replacement; nothing else."""
    needs = ~replacement.contains(" ") & F.lower(original).endswith("ing") & ~replacement.endswith("ing")
    return F.when(needs, F.concat(F.regexp_replace(replacement, "e$", ""), F.lit("ing"))).otherwise(replacement)


def occurrences(text: Column, needle: Column) -> Column:
    """array<struct<start, end>> of the needle as whole words, in any case."""
    pattern = F.concat(F.lit("(?i)(?<![A-Za-z0-9])"), F.regexp_replace(needle, "([.*+?^${}()|\\[\\]\\\\])", "\\\\$1"), F.lit("(?![A-Za-z0-9])"))
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"))
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + F.length(pair["gap"])
        end = begin + F.coalesce(F.length(pair["hit"]), F.lit(0))
        grown = F.when(pair["hit"].isNotNull(), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"))))).otherwise(acc["out"])
        return F.struct(end.alias("at"), grown.alias("out"))

    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])


def _sub(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def _deletion_end(text: Column, spot: Column) -> Column:
    """Where a safe deletion of a span ends; null if it isn't safe."""
    before, span, rest = F.left(text, spot["start"]), _sub(text, spot["start"], spot["end"]), F.substr(text, spot["end"] + 1)
    comma, space = F.length(F.regexp_extract(rest, R.java("^\\s*,\\s*"), 0)), F.length(F.regexp_extract(rest, R.java("^\\s+"), 0))
    stop = F.when(comma > 0, comma).when(R.matches(span, "(?i)\\b(that|to note that)$"), space).when((space > 0) & R.trim(span).rlike(STANDALONE), space)
    return F.when(R.matches(before, "(?:^|[.!?:;]\\s*|\\n\\s*)\\z"), spot["end"] + stop)


def plan(text: Column, issues: Column, house_findings: Column) -> Column:
    """Kept edits of one text: array<struct<start, end, replacement, kind, was, issue>>, in order, none overlapping.

    issue is the index of the finding among house_findings and then issues. Earliest start wins, then the longest.
    """
    known = known_suggestions()
    table = F.create_map(*[F.lit(x) for s, (kind, swap) in known.items() for x in (s, f"{kind}:{swap}")])

    def of_house(f: Column, i: Column) -> Column:
        target = R.trim(f["suggestion"])
        pick = F.when(target.rlike("[A-Za-z0-9]"), R.trim(F.split(target, R.java("\\s*[,/]\\s*"), -1)[0])).otherwise(target)
        edits = F.transform(f["spans"], lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), match_case(_sub(text, s["start"], s["end"]), pick).alias("replacement"), F.lit("house").alias("kind"), _sub(text, s["start"], s["end"]).alias("was"), i.alias("issue")))
        return F.when(~f["directive"] & (target != "") & (pick != ""), edits.cast(_EDIT)).otherwise(F.array().cast(_EDIT))

    def of_issue(x: Column, i: Column) -> Column:
        quoted = R.trim(x["text"])
        parsed = F.coalesce(F.element_at(table, x["suggestion"]), F.lit(""))
        kind, swap = F.regexp_extract(parsed, "^([a-z]*)", 1), F.regexp_extract(parsed, "^[a-z]+:(.*)$", 1)
        index = F.size(house_findings) + i
        spots = occurrences(text, quoted)
        deletions = F.transform(
            F.filter(F.transform(spots, lambda s: F.struct(s["start"].alias("start"), _deletion_end(text, s).alias("end"), _sub(text, s["start"], s["end"]).alias("was"))), lambda e: e["end"].isNotNull()),
            lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), F.lit("").alias("replacement"), F.lit("delete").alias("kind"), e["was"].alias("was"), index.alias("issue")),
        )

        def swapped(s: Column) -> Column:
            was = _sub(text, s["start"], s["end"])
            return F.struct(s["start"].alias("start"), s["end"].alias("end"), match_case(was, inflect(was, swap)).alias("replacement"), F.lit("swap").alias("kind"), was.alias("was"), index.alias("issue"))

        noun_slot = lambda e: R.matches(_sub(text, F.greatest(F.lit(0), e["start"] - 6), e["start"]), "(?i)\\b(a|an|the)\\s+$") & swap.rlike("^\\w+s$")
        swaps = F.filter(F.transform(spots, swapped), lambda e: (F.lower(e["replacement"]) != F.lower(e["was"])) & ~noun_slot(e))
        usable = ~x["type"].isin(NEVER_AUTO) & F.length(quoted).between(2, 120)
        delete = (kind == "delete") | ((kind == "") & x["type"].isin(list(DELETABLE)))
        return F.when(usable & delete, deletions.cast(_EDIT)).when(usable & (kind == "swap"), swaps.cast(_EDIT)).otherwise(F.array().cast(_EDIT))

    edits = F.concat(F.flatten(F.transform(house_findings, of_house)), F.flatten(F.transform(issues, of_issue)))
    return resolve(edits)


def resolve(edits: Column) -> Column:
    """Edits in order of start (the longest of equals first), each one that starts after those kept have ended."""
    numbered = F.transform(edits, lambda e, i: F.struct(e["start"].alias("s"), (-e["end"]).alias("e"), i.alias("i"), e.alias("edit")))
    start = F.struct(F.array().cast(_EDIT).alias("out"), F.lit(-1).alias("cursor"))
    step = lambda acc, z: F.when(z["s"] < acc["cursor"], acc).otherwise(F.struct(F.concat(acc["out"], F.array(z["edit"])).alias("out"), z["edit"]["end"].alias("cursor")))
    return F.aggregate(F.array_sort(numbered), start, step, lambda acc: acc["out"])


def splice(text: Column, edits: Column) -> Column:
    """text with ordered, non-overlapping edits (start, end, replacement) applied."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda acc, e: F.struct(F.concat(acc["out"], _sub(text, acc["at"], e["start"]), e["replacement"]).alias("out"), e["end"].alias("at"))
    return F.aggregate(edits, start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))


def repair(x: Column) -> Column:
    """Seams: no space before punctuation, no doubled blanks or blanks at line ends, and a capital after a full stop."""
    x = F.regexp_replace(x, "[ \\t]+([,.;:!?])", "$1")
    x = F.regexp_replace(x, "[ \\t]{2,}", " ")
    x = F.regexp_replace(x, "(?md)[ \\t]+$", "")
    lower = R.spans(x, R.java("(?:\\A|[.!?][\"')\\]]?\\s+|\\n[ \\t]*\\n[ \\t]*)[a-z]"))
    return splice(x, F.transform(lower, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.left(s["text"], F.length(s["text"]) - 1), F.upper(F.right(s["text"], F.lit(1)))).alias("replacement"))))


def apply(text: Column, edits: Column) -> Column:
    """The repaired text; repairs are made even without edits."""
    return repair(splice(text, edits))


def house_column(text: Column, rules: list[dict]) -> Column:
    return house.findings_column(text, rules)
