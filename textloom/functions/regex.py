"""Regular expressions with ASCII word boundaries and Unicode white space, on Spark's (Java's) engine.

The rules are written for a dialect where \\b and \\w are ASCII and \\s takes in the Unicode spaces. Java's \\b is
Unicode-aware and its \\s is ASCII, so both are spelled out here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Inside of a character class: white space as trim() and \s understand it.
SPACE = r"\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
_WORD = "[A-Za-z0-9_]"
_BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def _starts_a_word(rest: str) -> bool:
    """Whether whatever rest matches begins with a word character: a letter, \\w, or a group of such alternatives."""
    if not rest:
        return False
    if rest[0] != "(":
        return rest[0].isascii() and (rest[0].isalnum() or rest[0] == "_" or rest[:2] in ("\\w", "\\d")) and rest[1:2] not in ("?", "*")
    body = rest[3:] if rest.startswith("(?:") else rest[1:]
    if body[:1] == "?":
        return False
    depth, heads, at_head = 0, [], True
    for i, c in enumerate(body):
        if at_head:
            heads.append(body[i:])
        at_head = c == "|" and depth == 0
        if c == "\\" or c == "[":
            return False  # not worth reading further
        depth += (c == "(") - (c == ")")
        if depth < 0:
            return body[i + 1 : i + 2] not in ("?", "*") and all(h[0].isascii() and h[0].isalnum() for h in heads)
    return False


def java(pattern: str) -> str:
    """Spell out \\b, \\s and \\S of a pattern for Java."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            e = pattern[i + 1]
            if e == "s":
                out.append(SPACE if in_class else f"[{SPACE}]")
            elif e == "S" and not in_class:
                out.append(f"[^{SPACE}]")
            elif e == "b" and not in_class:
                out.append(f"(?<!{_WORD})" if _starts_a_word(pattern[i + 2 :]) else _BOUNDARY)
            else:
                out.append(c + e)
            i += 2
            continue
        if c == "[" and not in_class:
            in_class = True
        elif c == "]" and in_class:
            in_class = False
        elif c == "[" and in_class:
            c = r"\["
        out.append(c)
        i += 1
    return "".join(out)


def let(value: Column, body) -> Column:
    """body(x) with x bound to value, which is then worked out once however often body has it."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def js_round(x: Column, digits: int = 0) -> Column:
    """Half up towards positive infinity."""
    k = float(10**digits)
    return F.floor(x * k + 0.5) / k if digits else F.floor(x + 0.5)


WIDE_SPACES = "\xa0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200B)))
_SPACES = " \t\n\x0b\f\r" + WIDE_SPACES


def trim(x: Column) -> Column:
    return F.btrim(x, F.lit(_SPACES))


def count(x: Column, pattern: str) -> Column:
    return F.regexp_count(x, F.lit(java(pattern)))


def find(x: Column, pattern: str, group: int = 0) -> Column:
    """All matches (or one group of them), in order."""
    return F.regexp_extract_all(x, F.lit(java(pattern)), F.lit(group))


def matches(x: Column, pattern: str) -> Column:
    return x.rlike(java(pattern))


def replace(x: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(x, java(pattern), by)


def split(x: Column, pattern: str) -> Column:
    return F.split(x, java(pattern), -1)


_SPANS = "array<struct<start:int,end:int,text:string>>"


def spans(text: Column, pattern: str | Column, most: int | None = None) -> Column:
    """array<struct<start, end, text>>: every match with its offsets, in code points from 0; most caps their number.

    The offsets come from the lengths of what lies between the matches, so the pattern must not match an empty text.
    """
    told = F.lit(pattern) if isinstance(pattern, str) else pattern
    return F.when(F.rlike(text, told), _spans(text, told, most)).otherwise(F.array().cast(_SPANS))


def _spans(text: Column, pattern: Column, most: int | None) -> Column:
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    if most is not None:
        found = F.slice(found, 1, most)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["hit"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), pair["hit"].alias("text")))).alias("out"))

    def place(hits: Column) -> Column:
        pairs = F.slice(F.arrays_zip(F.split(text, pattern, F.lit(-1)).alias("gap"), hits.alias("hit")), F.lit(1), F.size(hits))
        return F.aggregate(pairs, start, step, lambda acc: acc["out"])

    return let(found, place)


def table(rows: list[dict]) -> Column:
    """Rows of constants as one array of structs: rules that are read as data leave a plan small, however many they are."""
    return F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in row.items()]) for row in rows])
