"""The registered queries as DuckDB SQL, written apart from the Spark expressions.

DuckDB's RE2 has ASCII word boundaries and no lookaround, so sentences are split at a mark that is put in after
terminal punctuation.
"""

from __future__ import annotations

from textloom.operators import profile, resume
from textloom.operators.scoring import BANDS, VOICE_BANDS
from textloom.plans.samples import values_sql

METRIC_COLUMNS = {"sentenceLength": "sentence_length", "paragraphLength": "paragraph_length", "commaRate": "comma_rate", "semicolonRate": "semicolon_rate", "dashRate": "dash_rate", "parentheticalRate": "parenthetical_rate", "contractionRate": "contraction_rate", "readingLevel": "reading_level"}
WORD = "[A-Za-z][A-Za-z''’-]*"
_CLOSE = "[\"''”’)\\]]*"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _texts() -> str:
    return f"texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents UNION ALL SELECT doc_id::BIGINT, text FROM (VALUES {values_sql()}) AS v(doc_id, text))"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _clean(x: str) -> str:
    for pattern, by in (("```[\\s\\S]*?```", " "), ("(?m)^[ \\t]{4,}\\S.*$", " "), ("(?m)^\\s*#{1,6}\\s.*$", " "), ("(?m)^\\s*>+\\s?", ""), ("(?m)^\\s*(?:[-*+•]|\\d+[.)])\\s+", ""), ("`([^`]*)`", "\\1")):
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return x


def _n_words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{WORD}'))"


def _sentences(x: str) -> str:
    x = f"regexp_replace({x}, '\\b(Mr|Mrs|Ms|Dr|Prof|Sr|Jr|St|vs|etc|e\\.g|i\\.e|approx|Inc|Ltd|Co)\\.', '\\1<DOT>', 'gi')"
    x = f"regexp_replace({x}, '\\b([A-Z])\\.', '\\1<DOT>', 'g')"
    parts = f"string_split(regexp_replace({x}, '([.!?]){_CLOSE}\\s+', '\\1<SEP>', 'g'), '<SEP>')"
    parts = f"list_transform({parts}, lambda s: {_trim('replace(s, ' + _q('<DOT>') + ', ' + _q('.') + ')')})"
    return f"list_filter({parts}, lambda s: CASE WHEN regexp_matches(s, '[.!?]{_CLOSE}$') THEN {_n_words('s')} > 0 ELSE {_n_words('s')} >= 4 END)"


_SYLLABLES = (
    "CASE WHEN length(w) <= 3 THEN 1 ELSE greatest(1, len(regexp_extract_all("
    "regexp_replace(regexp_replace(w, '(?:[^laeiouy]es|ed|[^laeiouy]e)$', ''), '^y', ''), '[aeiouy]{1,2}'))) END"
)


def measured(source: str, out: str, keys: str = "doc_id") -> str:
    """CTEs that measure the texts of source (keys, text) into out."""
    per100 = lambda p: f"CASE WHEN n > 0 THEN 100.0::DOUBLE * len(regexp_extract_all(clean, '{p}')) / n ELSE 0.0::DOUBLE END"
    first = lambda xs: f"list_filter(list_transform({xs}, lambda s: lower(regexp_extract(s, '{WORD}'))), lambda w: w <> '')"
    return f"""
{out}_a AS (SELECT {keys}, text, {_clean("text")} AS clean FROM {source}),
{out}_b AS (SELECT *, regexp_extract_all(clean, '{WORD}') AS ws, {_sentences("clean")} AS sents,
  list_filter(list_transform(string_split_regex(clean, '\\n\\s*\\n+'), lambda p: {_trim("p")}), lambda p: regexp_matches(p, '[A-Za-z]')) AS paras FROM {out}_a),
{out}_c AS (SELECT *, len(ws) AS n, len(sents) AS s,
  coalesce(list_sum(list_transform(list_transform(ws, lambda x: regexp_replace(lower(x), '[^a-z]', '', 'g')), lambda w: {_SYLLABLES})), 0)::BIGINT AS syl,
  list_transform(sents, lambda x: {_n_words("x")}) AS slens, list_transform(paras, lambda p: len({_sentences("p")})) AS plens FROM {out}_b),
{out} AS (SELECT {keys}, clean, ws, n, s, syl, {first("sents")} AS openers, {first("paras")} AS para_openers,
  CASE WHEN s > 0 THEN list_sum(slens)::DOUBLE / s END AS "sentenceLength",
  CASE WHEN len(plens) > 0 THEN list_sum(plens)::DOUBLE / len(plens) END AS "paragraphLength",
  {per100(",")} AS "commaRate", {per100(";")} AS "semicolonRate", {per100("—|–|\\s-\\s")} AS "dashRate", {per100("\\([^)]*\\)")} AS "parentheticalRate",
  CASE WHEN s > 0 THEN 100.0::DOUBLE * len(list_filter(sents, lambda x: regexp_matches(x, '(?i)\\b\\w+[''’](?:t|s|re|ve|ll|d|m)\\b'))) / s END AS "contractionRate",
  CASE WHEN n > 0 AND s > 0 THEN greatest(0.0::DOUBLE, 0.39::DOUBLE * (n::DOUBLE / s) + 11.8::DOUBLE * (syl::DOUBLE / n) - 15.59::DOUBLE) ELSE 0.0::DOUBLE END AS "readingLevel" FROM {out}_c)"""


def _round1(x: str) -> str:
    return f"floor(({x}) * 10 + 0.5::DOUBLE) / 10"


def _text_stats() -> str:
    values = ", ".join(f'{_round1(chr(34) + k + chr(34))} AS {v}' for k, v in METRIC_COLUMNS.items())
    return f"WITH {_texts()}, {measured('texts', 'm')} SELECT m.doc_id, n::BIGINT AS words, len(regexp_extract_all(t.text, '\\S+'))::BIGINT AS tokens, s::BIGINT AS sentences, syl AS syllables, {values} FROM m JOIN texts t ON t.doc_id = m.doc_id"


def _openers_per_text() -> str:
    return f"WITH {_texts()}, {measured('texts', 'm')} SELECT doc_id, array_to_string(openers, ' ') AS openers, array_to_string(para_openers, ' ') AS para_openers FROM m"


_TOPK = f"""
SELECT word, count(*) AS cnt FROM (SELECT lower(unnest(regexp_extract_all(coalesce(text, ''), '{WORD}'))) AS word FROM documents) GROUP BY word ORDER BY cnt DESC, word LIMIT 50
"""


def _contact() -> str:
    flag = lambda p: f"regexp_matches(text, {_q(p)})"
    return f"WITH {_texts()} SELECT doc_id, {flag(resume.EMAIL)} AS has_email, {flag(resume.PHONE)} AS has_phone, {flag(resume.URL)} AS has_url, {flag(resume.DATE)} AS has_date, {flag(resume.METRIC)} AS has_metric FROM texts"


def _rules(rules: list[dict]) -> str:
    """Offsets from the lengths of what lies between the matches."""
    shown = []
    for seq, r in enumerate(r for r in rules if r.get("enabled", True)):
        mode = r.get("match", "word")
        p = r["pattern"] if mode != "word" else f"\\b{r['pattern']}\\b"
        shown.append(
            f"SELECT doc_id, text, {seq} AS seq, {_q(r['id'])} AS rule_id, regexp_extract_all(text, {_q('(?i)' + p)}) AS hits, string_split_regex(text, {_q('(?i)' + p)}) AS gaps FROM texts WHERE regexp_matches(text, {_q('(?i)' + p)})"
        )
    return f"""
WITH {_texts()}, found AS ({" UNION ALL ".join(shown)}),
each AS (SELECT doc_id, text, seq, rule_id, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap, unnest(range(1, len(hits) + 1)) AS i FROM found),
placed AS (SELECT *, (sum(length(gap)) OVER w + sum(length(hit)) OVER w - length(hit))::BIGINT AS start FROM each WINDOW w AS (PARTITION BY doc_id, seq ORDER BY i)),
kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id, seq, lower(hit) ORDER BY i) AS k FROM placed WHERE i <= 200)
SELECT doc_id, rule_id, lower(hit) AS match_key, count(*) AS cnt, min(start) AS start, min(start) + max(length(hit)) AS "end",
  (1 + max(CASE WHEN k = 1 THEN len(regexp_extract_all(substr(text, 1, start), '\\n')) END))::BIGINT AS line, max(start) AS last_start
FROM kept GROUP BY doc_id, rule_id, lower(hit)
"""


def _band_case(x: str, bands: tuple) -> str:
    n = f"greatest(0, least(100, floor(({x}) + 0.5::DOUBLE)))"
    return "CASE " + " ".join(f"WHEN {n} BETWEEN {b[1]} AND {b[2]} THEN '{b[0]}'" for b in bands) + " END"


_CALIBRATE = f"""
WITH i AS (SELECT doc_id, greatest(0, least(100, (doc_id * 7) % 131))::DOUBLE AS base, (doc_id % 13)::DOUBLE * 1.5::DOUBLE AS weighted, (doc_id % 6)::DOUBLE AS n, n_chars::DOUBLE / 8 AS w FROM documents),
j AS (SELECT *, w >= 40 AND n > 0 AS judged FROM i),
k AS (SELECT *, CASE WHEN judged THEN weighted / w * 100 ELSE 0 END AS density, CASE WHEN judged THEN least(1.0::DOUBLE, pow(n / 3, 2)) ELSE 0 END AS evidence FROM j),
l AS (SELECT *, CASE WHEN w < 40 THEN least(base, 15) ELSE greatest(base, 100 * (1 - exp(-density / 26)) * evidence) END AS score FROM k)
SELECT doc_id, greatest(0, least(100, floor(score + 0.5::DOUBLE)))::BIGINT AS score, {_band_case("score", BANDS)} AS band, floor(evidence * 1000 + 0.5::DOUBLE) / 1000 AS evidence, {_band_case("(doc_id * 3) % 140 - 20", VOICE_BANDS)} AS voice_band FROM l
"""

def _absent() -> str:
    """The verb of 'surface' by what has to follow it, as RE2 has no lookahead."""
    rows = [(label, f"\\b{label.replace(' ', chr(92) + 's+')}\\b") for label in profile.ABSENCE_CANDIDATES]
    rows.append((profile.SURFACE[1], profile.SURFACE[2].removeprefix("(?i)").replace("\\b(?=", "").replace(")\\b)", ")\\b")))
    used = " UNION ".join(f"SELECT author, {_q(label)} AS word FROM x WHERE regexp_matches(clean, {_q('(?i)' + p)})" for label, p in rows)
    values = ", ".join(f"({_q(label)})" for label, _ in rows)
    return f"""WITH {_texts()}, x AS (SELECT coalesce(d.source, 'samples') AS author, {_clean("t.text")} AS clean FROM texts t LEFT JOIN documents d ON d.doc_id = t.doc_id), used AS ({used})
SELECT a.author, c.word FROM (SELECT DISTINCT author FROM x) a CROSS JOIN (VALUES {values}) AS c(word) WHERE (a.author, c.word) NOT IN (SELECT author, word FROM used)"""


_LINES = f"""
raw AS (SELECT doc_id, unnest(ls) AS raw, unnest(range(len(ls))) AS line FROM (SELECT doc_id, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) AS ls FROM texts)),
l1 AS (SELECT *, {_trim("raw")} AS t FROM raw),
lines AS (SELECT doc_id, line, raw, t, len(regexp_extract_all(t, '\\S+')) AS words, t = '' AS blank, regexp_matches(raw, {_q(resume.GLYPH)}) AS glyph,
  length(t) <= 60 AND length(regexp_replace(t, '[^A-Za-z]', '', 'g')) >= 3 AND NOT regexp_matches(t, '[a-z]') AS heading, {_trim("regexp_replace(t, " + _q(resume.GLYPH) + ", '')")} AS body FROM l1)"""


def _bullets() -> str:
    section = " OR ".join(f"regexp_matches(t, {_q(p)})" for p in resume.SECTIONS.values())
    return f"""{_texts()}, {_LINES},
g AS (SELECT doc_id, count(*) FILTER (WHERE glyph AND body <> '') >= 3 AS used FROM lines GROUP BY doc_id),
isl AS (SELECT l.*, glyph AND body <> '' AS begins, sum(CASE WHEN (glyph AND body <> '') OR blank OR heading THEN 1 ELSE 0 END) OVER (PARTITION BY l.doc_id ORDER BY line) AS island FROM lines l JOIN g ON g.doc_id = l.doc_id AND g.used),
heads AS (SELECT doc_id, island, line, body FROM isl WHERE begins),
tails AS (SELECT i.doc_id, i.island, string_agg(' ' || i.t, '' ORDER BY i.line) AS more FROM isl i JOIN heads h ON h.doc_id = i.doc_id AND h.island = i.island AND i.line > h.line WHERE NOT i.blank AND regexp_matches(i.raw, '^\\s+') AND NOT i.heading AND NOT regexp_matches(i.t, {_q(resume.DATE)}) GROUP BY i.doc_id, i.island),
bullets AS (SELECT h.doc_id, h.line, h.body || coalesce(t.more, '') AS body FROM heads h LEFT JOIN tails t ON t.doc_id = h.doc_id AND t.island = h.island
  UNION ALL SELECT l.doc_id, line, body FROM lines l JOIN g ON g.doc_id = l.doc_id AND NOT g.used WHERE NOT blank AND words >= 6 AND NOT regexp_matches(t, {_q(resume.DATE)}) AND NOT regexp_matches(t, {_q(resume.EMAIL)}) AND NOT heading AND NOT ({section}))"""


def facts() -> str:
    """CTEs up to j: what the structure of each text gives."""
    sections = ", ".join(f"min(line) FILTER (WHERE NOT blank AND words <= 6 AND regexp_matches(t, {_q(p)}))::BIGINT AS {name}" for name, p in resume.SECTIONS.items())
    mode = f"CASE WHEN (email OR phone)::INTEGER + ({' + '.join(f'({x} IS NOT NULL)::INTEGER' for x in resume.SECTIONS)} >= 2)::INTEGER + (bullets >= 4 AND used)::INTEGER + (date_lines >= 2)::INTEGER >= 2 THEN 'resume' ELSE 'essay' END"
    return f"""{_bullets()},
brk AS (SELECT b.doc_id, b.line, (SELECT count(*) FROM lines l WHERE l.doc_id = b.doc_id AND l.line < b.line AND (l.blank OR l.heading)) AS k FROM bullets b),
bl AS (SELECT doc_id, count(DISTINCT k) AS blocks, count(*) AS bullets FROM brk GROUP BY doc_id),
s AS (SELECT doc_id, count(*) FILTER (WHERE regexp_matches(t, {_q(resume.DATE)})) AS date_lines, {sections}, bool_or(regexp_matches(t, {_q(resume.EMAIL)})) AS email, bool_or(regexp_matches(t, {_q(resume.PHONE)})) AS phone, bool_or(regexp_matches(t, {_q(resume.URL)})) AS url FROM lines GROUP BY doc_id),
j0 AS (SELECT s.*, coalesce(bl.blocks, 0) AS blocks, coalesce(bl.bullets, 0) AS bullets, g.used FROM s JOIN g ON g.doc_id = s.doc_id LEFT JOIN bl ON bl.doc_id = s.doc_id),
j AS (SELECT *, {mode} AS mode FROM j0)"""


def _structure() -> str:
    return f"WITH {facts()} SELECT doc_id, blocks, date_lines, bullets, {', '.join(resume.SECTIONS)}, used AS used_glyphs, mode FROM j"


def _html() -> str:
    x = "regexp_replace(replace(coalesce(html, ''), '</p>', chr(10)), '<[^>]*>', '', 'g')"
    for entity, by in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, {_q(entity)}, {_q(by)})"
    return f"SELECT page_id, regexp_replace({x}, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g') AS text FROM pages"


def all_sql(rules: list[dict]) -> dict[str, str]:
    return {
        "text_stats": _text_stats(),
        "sentence_openers_per_text": _openers_per_text(),
        "word_freq_topk": _TOPK,
        "contact_predicates": _contact(),
        "rule_matches": _rules(rules),
        "calibrate_bands": _CALIBRATE,
        "absent_words": _absent(),
        "resume_lines": f"WITH {_texts()}, {_LINES} SELECT doc_id, line, words, blank, glyph, heading, body FROM lines",
        "resume_bullets": f"WITH {_bullets()} SELECT doc_id, line, body FROM bullets",
        "resume_structure": _structure(),
        "html_text": _html(),
    }
