"""The scan itself as DuckDB SQL: resume findings and scores, prose and house findings, calibration and display order.

Rules that the engine writes with lookaround are matched here with what they look at, and told apart by it afterwards.
"""

from __future__ import annotations

from textloom import oracle
from textloom.oracle import _q
from textloom.operators import fixer, house, prose, resume
from textloom.operators.scoring import BANDS, SEVERITY_WEIGHT

_RANK = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
#: Columns of a finding, in the order of the branches below; ord, line and pos give the order of the rules.
_COLUMNS = "doc_id, ord, line, pos, type, severity, weight, text, suggestion"


def _phrase(source: str, column: str, ord_: int, type_: str, severity: str, weight: float, pattern: str, suggestion: str, line: str = "line", group: int = 1, shown: str = "txt") -> str:
    """Every match of a pattern. A trailing group named after what must not follow is matched too; such matches go."""
    not_after = None
    for tail in ("(?!\\s+by)", "(?!\\s+that)"):
        if tail in pattern:
            not_after = tail[3:-1]
            pattern = pattern.replace(tail, "")
    if not_after:
        pattern, group = f"{pattern}(?:{not_after})?", 0
    keep = f"WHERE NOT regexp_matches(txt, {_q('(?i)' + not_after + '$')})" if not_after else ""
    return (
        f"SELECT doc_id, {ord_} AS ord, {line} AS line, pos, {_q(type_)} AS type, {_q(severity)} AS severity, {weight}::DOUBLE AS weight, {shown} AS text, {_q(suggestion)} AS suggestion "
        f"FROM (SELECT doc_id, {'line, ' if line == 'line' else ''}unnest(xs) AS txt, unnest(range(len(xs))) AS pos FROM (SELECT *, regexp_extract_all({column}, {_q(pattern)}, {group}) AS xs FROM {source} WHERE regexp_matches({column}, {_q(pattern)}))) {keep}"
    )


def _single(ord_: int, type_: str, severity: str, text: str, suggestion: str, source: str, where: str, line: str = "NULL") -> str:
    return f"SELECT doc_id, {ord_}, {line}::BIGINT, 0, {_q(type_)}, {severity}, {resume.WEIGHTS.get(type_, 0)}::DOUBLE, {text}, {_q(suggestion)} FROM {source} WHERE {where}"


def _resume(active: str) -> str:
    """CTEs up to rk: the resume findings that stay, with idx, their place in the engine's order. active: a condition on j."""
    tables = ((1000, resume.CLICHES, "resume-cliche", "high"), (2000, resume.STRONG_VERBS, "resume-llm-verb", "high"), (3000, resume.VAGUE_IMPACT, "resume-vague-impact", "medium"), (4000, resume.WEAK_OPENERS, "resume-weak-verb", "low"))
    table = lambda base, rows, type_, severity: [_phrase("content", "c", base + k, type_, severity, resume.WEIGHTS[type_], f"(?i)\\b({p})" + ("\\b" if "(?!" not in p else ""), fix) for k, (p, fix) in enumerate(rows)]
    told = resume.ADVICE
    hard = " UNION ALL ".join(x for t in tables for x in table(*t))
    soft = " UNION ALL ".join(table(5000, resume.SOFT_VERBS, "resume-llm-verb", "medium"))
    irregular = ", ".join(_q(v) for v in resume.IRREGULAR_PAST)
    past = f"(f LIKE '%ed' OR f IN ({irregular}))"
    rnd = lambda x: f"floor(({x}) + 0.5::DOUBLE)::BIGINT"
    missing = [_single(14000 + k, "resume-missing-section", "'medium'", f"""'section "{name}" not found'""", told["resume-missing-section"].format(name.capitalize()), "act", f"{name} IS NULL") for k, name in enumerate(("experience", "education", "skills"))]
    return f"""{oracle.facts()},
wc AS (SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS wc FROM texts),
act AS (SELECT j.*, wc.wc FROM j JOIN wc ON wc.doc_id = j.doc_id WHERE wc >= {resume.MIN_WORDS} AND {active}),
content AS (SELECT l.doc_id, l.line + 1 AS line, translate(CASE WHEN body <> '' THEN body ELSE t END, '*_`', '') AS c FROM lines l JOIN act ON act.doc_id = l.doc_id WHERE NOT l.blank),
bb AS (SELECT b.doc_id, b.line + 1 AS line, b.body, greatest(1, len(regexp_extract_all(b.body, '\\S+'))) AS sz, regexp_matches(b.body, {_q(resume.METRIC)}) AS metric, regexp_matches(b.body, {_q(resume.TRIAD)}) AS triad,
  regexp_extract_all(b.body, '(\\d+(?:\\.\\d+)?)\\s*%', 1) AS pc, regexp_replace(lower(regexp_extract(b.body, '^(\\S*)', 1)), '[^a-z]', '', 'g') AS f FROM bullets b JOIN act ON act.doc_id = b.doc_id),
st0 AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE metric) AS metrics, list(sz ORDER BY line) AS szs, sum(sz)::DOUBLE / count(*) AS average, count(*) FILTER (WHERE triad) AS triads, min(line) FILTER (WHERE triad) AS triad_line,
  flatten(list(pc ORDER BY line)) AS pcs, min(line) FILTER (WHERE len(pc) > 0) AS pc_line, count(*) FILTER (WHERE {past}) AS past, count(*) FILTER (WHERE NOT {past} AND NOT f LIKE '%ing' AND regexp_matches(f, {_q(resume.PRESENT)})) AS present FROM bb GROUP BY doc_id),
st AS (SELECT *, metrics::DOUBLE / n AS ratio, sqrt(list_sum(list_transform(szs, lambda x: (x - average) * (x - average))) / n) / average AS cv FROM st0),
soft AS ({soft}),
hard AS ({hard}),
fa AS (SELECT {_COLUMNS} FROM hard
  UNION ALL SELECT {_COLUMNS} FROM soft WHERE doc_id IN (SELECT doc_id FROM soft GROUP BY doc_id HAVING count(DISTINCT lower(text)) >= 3)
  UNION ALL {_single(6000, "resume-unquantified", "CASE WHEN ratio < 0.15 THEN 'high' ELSE 'medium' END", "'without a figure: ' || (n - metrics) || ' of ' || n", told["resume-unquantified"], "st", "n >= 3 AND ratio < 0.4::DOUBLE")}
  UNION ALL {_single(7000, "resume-round-metrics", "'high'", "array_to_string(list_transform(pcs, lambda p: floor(p::DOUBLE)::BIGINT || '%'), ', ')", told["resume-round-metrics"], "st", "len(pcs) >= 3 AND len(list_filter(pcs, lambda p: p::DOUBLE % 5 <> 0)) = 0", "pc_line")}
  UNION ALL {_single(8000, "resume-uniform-bullets", "'medium'", f"'near one length: ' || n || ' bullets of some ' || {rnd('average')} || ' words, spread ' || {rnd('cv * 100')} || '%'", told["resume-uniform-bullets"], "st", f"n >= 5 AND average >= 8 AND cv < {resume.UNIFORM_CV}::DOUBLE")}
  UNION ALL {_single(9000, "resume-triad", "'medium'", "'lists of three: ' || triads", told["resume-triad"], "st", "triads >= 3", "triad_line")}
  UNION ALL {_phrase("bb", "body", 10000, "resume-pronoun", "low", resume.WEIGHTS["resume-pronoun"], resume.PRONOUN, told["resume-pronoun"])}
  UNION ALL {_single(11000, "resume-long-bullet", "'low'", "substr(body, 1, 60) || '…'", told["resume-long-bullet"], "bb", "sz > 32", "line")}
  UNION ALL {_single(12000, "resume-tense-mix", "'low'", "'verbs in the past: ' || past || ', in the present: ' || present", told["resume-tense-mix"], "st", "n >= 3 AND past > 0 AND present > 0 AND past + present >= 3")}
  UNION ALL {_single(13000, "resume-missing-contact", "'high'", "'no way to reach the writer'", told["resume-missing-contact"], "act", "NOT email AND NOT phone AND NOT url")}
  UNION ALL {" UNION ALL ".join(missing)}
  UNION ALL {_single(15000, "resume-missing-dates", "'medium'", "'dated lines: ' || date_lines || ', roles: ' || blocks", told["resume-missing-dates"], "act", "bullets >= 3 AND date_lines < blocks")}
  UNION ALL {_single(16000, "resume-skill-dump", "'low'", "'items on one line: ' || (len(regexp_extract_all(t, ',')) + 1)", told["resume-skill-dump"], "(SELECT l.doc_id, l.line + 1 AS line, t FROM lines l JOIN act ON act.doc_id = l.doc_id)", "len(regexp_extract_all(t, ',')) >= 25", "line")}),
fk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, type, lower(text) ORDER BY ord, line, pos) AS k FROM fa),
ri AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord, line, pos) AS i FROM fk WHERE k = 1),
rk AS (SELECT *, {_RANK} AS rank, row_number() OVER (PARTITION BY doc_id ORDER BY {_RANK} DESC, weight DESC, i) AS idx FROM ri),
rs0 AS (SELECT w.doc_id, w.wc, coalesce((SELECT sum(weight) FROM rk WHERE rk.doc_id = w.doc_id AND rk.type IN ({", ".join(_q(t) for t, g in resume.GROUPS.items() if g == "ai")})), 0) AS ai, coalesce((SELECT sum(weight) FROM rk WHERE rk.doc_id = w.doc_id AND rk.type IN ({", ".join(_q(t) for t, g in resume.GROUPS.items() if g == "craft")})), 0) AS craft FROM wc w),
rs1 AS (SELECT *, greatest(1.0::DOUBLE, log2(greatest(wc, 50) / 50.0::DOUBLE) + 1) AS norm FROM rs0),
rs AS (SELECT doc_id, wc, least(100, {rnd("ai / norm * 4")}) AS ai_score, least(100, {rnd("craft / norm * 5")}) AS penalty FROM rs1)"""


def resume_findings() -> str:
    return f"WITH {_resume('true')} SELECT doc_id, type, severity, text, line FROM rk"


def resume_scores() -> str:
    label = "CASE " + " ".join(f"WHEN ai_score <= {most} THEN {_q(name)}" for most, name in resume.LABEL_CUTS) + " ELSE 'Heavy AI patterns' END"
    scorable = f"rs.wc >= {resume.MIN_WORDS}"
    return f"""WITH {_resume("true")} SELECT rs.doc_id, CASE WHEN {scorable} THEN least(100, floor(ai_score * 0.65::DOUBLE + penalty * 0.35::DOUBLE + 0.5::DOUBLE)::BIGINT) ELSE 0 END AS score, ai_score, 100 - penalty AS craft_score, rs.wc AS word_count, j.bullets AS bullet_count,
  CASE WHEN {scorable} THEN {label} ELSE 'Too short' END AS label FROM rs JOIN j ON j.doc_id = rs.doc_id"""


def _prose_rows(rows: tuple, base: int, source: str = "ptexts") -> list[str]:
    out = []
    for k, (type_, severity, pattern, suggestion) in enumerate(rows):
        p = prose._word_pattern(pattern).replace("(?i)\\b(?:", "(?i)\\b(", 1) if "(?!" not in pattern else prose._word_pattern(pattern)
        out.append(_phrase(source, "text", base + k, type_, severity, SEVERITY_WEIGHT[severity], p, suggestion, line="0", shown="regexp_replace(txt, '\\s+', ' ', 'g')", group=0))
    return out


def prose_findings() -> str:
    """CTEs from ptexts (doc_id, text, mode) up to pk: the prose findings that stay, with idx, their place in rule order."""
    clean, sents = oracle._clean("text"), oracle._sentences
    tier2 = tuple(("tier2-word", "medium", p, fix) for p, fix in prose.TIER2)
    title = prose.TITLE_CASE.replace("(?md)", "(?m)")
    words = oracle._n_words
    mean = lambda xs: f"list_sum({xs})::DOUBLE / len({xs})"
    single = lambda ord_, type_, severity, text, suggestion, where: f"SELECT doc_id, {ord_}, 0, 0, {_q(type_)}, {_q(severity)}, {SEVERITY_WEIGHT[severity]}::DOUBLE, {text}, {_q(suggestion)} FROM pm WHERE {where}"
    general = "(SELECT * FROM ptexts WHERE mode <> 'resume')"
    return f"""pa AS (SELECT doc_id, text, len(regexp_extract_all(text, '\\S+')) AS wc, {clean} AS clean, len(regexp_extract_all(text, '—')) AS dashes, len(list_distinct(list_transform(regexp_extract_all(text, '{oracle.WORD}'), lambda w: lower(w)))) AS uniq,
  list_filter(list_transform(string_split_regex(text, '\\n\\s*\\n+'), lambda p: {oracle._trim("p")}), lambda p: regexp_matches(p, '[A-Za-z]')) AS ps FROM ptexts),
pb AS (SELECT *, list_transform({sents("clean")}, lambda s: {words("s")}) AS lens, CASE WHEN len(ps) >= 5 THEN list_filter(list_transform(list_transform(ps, lambda p: list_transform({sents("p")}, lambda s: {words("s")})), lambda ls: {mean("ls")}), lambda x: x IS NOT NULL) ELSE []::DOUBLE[] END AS paras FROM pa),
pc AS (SELECT *, {mean("lens")} AS average, {mean("paras")} AS para_mean FROM pb),
pm AS (SELECT *, sqrt(list_sum(list_transform(lens, lambda x: (x - average) * (x - average))) / len(lens)) / average AS cv, sqrt(list_sum(list_transform(paras, lambda x: (x - para_mean) * (x - para_mean))) / len(paras)) / para_mean AS para_cv FROM pc),
ph AS ({" UNION ALL ".join(_prose_rows(prose.PHRASES, 0))}),
p2 AS ({" UNION ALL ".join(_prose_rows(tier2, 1000))}),
pf AS (SELECT {_COLUMNS} FROM ph UNION ALL SELECT {_COLUMNS} FROM p2 WHERE doc_id IN (SELECT doc_id FROM p2 GROUP BY doc_id HAVING count(DISTINCT lower(text)) >= {prose.TIER2_CLUSTER})
  UNION ALL {" UNION ALL ".join(_prose_rows(prose.GENERAL_ONLY, 2000, general))}
  UNION ALL {_phrase(general, "text", 3000, "title-case-header", "low", SEVERITY_WEIGHT["low"], title, "Use sentence case.", line="0", group=0, shown=oracle._trim("txt"))}
  UNION ALL {single(4000, "uniformity", "medium", "len(lens) || ' sentences of nearly one length'", "Let some run short and some long.", "len(lens) >= 8 AND average >= 8 AND cv < 0.12::DOUBLE")}
  UNION ALL {single(5000, "low-ttr", "low", "uniq || ' different words'", "Say fewer things more exactly.", "wc >= 200 AND uniq / sqrt(wc::DOUBLE) < 3.0::DOUBLE")}
  UNION ALL {single(6000, "punct-distribution", "low", "dashes || ' em dashes'", "Use commas and full stops.", "dashes >= 6 AND dashes * 100.0::DOUBLE / greatest(wc, 1) > 3.0::DOUBLE")}
  UNION ALL {single(7000, "cross-para-burstiness", "low", "len(paras) || ' paragraphs of one rhythm'", "Vary the paragraphs.", "len(paras) >= 5 AND para_mean >= 8 AND para_cv < 0.05::DOUBLE")}),
pk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord, pos) AS idx FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, type, lower(text) ORDER BY ord, pos) AS k FROM pf) WHERE k = 1)"""


def _scan() -> str:
    """CTEs of the whole scan: pk (prose findings), rk (resume findings), hk (house findings) and sc (scores)."""
    return f"""{_resume("mode = 'resume'")},
ptexts AS (SELECT t.doc_id, t.text, j.mode FROM texts t JOIN j ON j.doc_id = t.doc_id), {prose_findings()},
{_house()},
ps0 AS (SELECT w.doc_id, w.wc, coalesce((SELECT sum(weight) FROM pk WHERE pk.doc_id = w.doc_id), 0)::DOUBLE AS raw, (SELECT count(*) FROM pk WHERE pk.doc_id = w.doc_id) AS np,
  coalesce((SELECT sum(weight) FROM rk WHERE rk.doc_id = w.doc_id AND rk.type IN ({", ".join(_q(t) for t, g in resume.GROUPS.items() if g == "ai")})), 0)::DOUBLE AS rraw, (SELECT count(*) FROM rk WHERE rk.doc_id = w.doc_id AND rk.type IN ({", ".join(_q(t) for t, g in resume.GROUPS.items() if g == "ai")})) AS nr, (SELECT count(*) FROM hk WHERE hk.doc_id = w.doc_id) AS nh FROM wc w),
ps1 AS (SELECT *, greatest(0.0::DOUBLE, least(100.0::DOUBLE, raw / greatest(1.0::DOUBLE, log2(greatest(wc, 1) / 50.0::DOUBLE)))) AS base, raw + rraw AS weighted, np + nr AS n FROM ps0),
ps2 AS (SELECT *, CASE WHEN wc >= 40 AND n > 0 THEN weighted / wc * 100 ELSE 0 END AS density, CASE WHEN wc >= 40 AND n > 0 THEN least(1.0::DOUBLE, pow(n::DOUBLE / 3, 2)) ELSE 0 END AS evidence FROM ps1),
sc AS (SELECT *, CASE WHEN wc < 40 THEN least(base, 15) ELSE greatest(base, 100 * (1 - exp(-density / 26)) * evidence) END AS score FROM ps2)"""


def _house() -> str:
    """The shipped rules: offsets from what lies between the matches; a match after a word that spares it goes."""
    branches = []
    for seq, r in enumerate(house.normalize(house.DEFAULT_RULES)):
        p = r["pattern"]
        if r["match"] == "word":
            p = f"\\b{p}\\b"
        spared = ""
        if p.startswith("(?<!"):
            at = p.index("\\s)") + 3
            spared, p = p[4 : at - 1], p[at:]
        whole = f"(?i)(?:{spared})?{p}" if spared else f"(?i){p}"
        keep = f"NOT regexp_matches(hit, {_q('(?i)^' + spared)})" if spared else "true"
        branches.append(
            f"SELECT doc_id, {seq} AS seq, {_q(r['label'])} AS label, {_q(r['severity'])} AS severity, {_q(r['replacement'])} AS suggestion, hit AS text, spot FROM (SELECT doc_id, hit, sum(length(gap)) OVER w + sum(length(hit)) OVER w - length(hit) AS spot FROM "
            f"(SELECT doc_id, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap, unnest(range(len(hits))) AS i FROM (SELECT doc_id, regexp_extract_all(text, {_q(whole)}) AS hits, string_split_regex(text, {_q(whole)}) AS gaps FROM texts WHERE regexp_matches(text, {_q(whole)}))) WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE {keep}"
        )
    return f"""h0 AS ({" UNION ALL ".join(branches)}),
h1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, seq, lower(text) ORDER BY spot) AS k FROM h0),
hk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY spot, seq) AS idx FROM h1 WHERE k = 1)"""


def scan_documents() -> str:
    return f"""WITH {_scan()} SELECT sc.doc_id, j.mode, greatest(0, least(100, floor(score + 0.5::DOUBLE)))::INTEGER AS ai_score, {oracle._band_case("score", BANDS)} AS band, sc.wc AS words, CASE WHEN j.mode = 'resume' THEN (100 - rs.penalty)::INTEGER END AS craft_score,
  np::INTEGER AS prose, nh::INTEGER AS house FROM sc JOIN j ON j.doc_id = sc.doc_id JOIN rs ON rs.doc_id = sc.doc_id"""


def all_issues_order() -> str:
    label = lambda table: "CASE type " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in table.items()) + " ELSE type END"
    return f"""WITH {_scan()},
every AS (SELECT doc_id, 0 AS a, {_RANK} AS b, 1 AS c, idx, 'house' AS source, 'house-rule' AS type, severity, label, text, suggestion FROM hk
  UNION ALL SELECT doc_id, 2, {_RANK}, 2, idx, 'resume', type, severity, {label(resume.LABELS)}, text, suggestion FROM rk
  UNION ALL SELECT doc_id, 2, {_RANK}, 3, idx, 'prose', type, severity, {label(prose.TYPE_LABELS)}, text, suggestion FROM pk)
SELECT doc_id, 'f' || (row_number() OVER (PARTITION BY doc_id ORDER BY a, b DESC, c, idx) - 1) AS issue_id, source, type, severity, label, text, suggestion FROM every"""


def _case(was: str, by: str) -> str:
    """by in the letter case of was."""
    letters = f"regexp_replace({was}, '[^A-Za-z]', '', 'g')"
    return f"CASE WHEN {by} = '' OR {letters} = '' THEN {by} WHEN length({letters}) > 1 AND {letters} = upper({letters}) THEN upper({by}) WHEN left({letters}, 1) = upper(left({letters}, 1)) THEN upper(left({by}, 1)) || substr({by}, 2) ELSE {by} END"


def fix_text() -> str:
    """Edits of every finding, those that are kept one after the other, the text put together, and its seams.

    Words are looked for at every place of a text that has findings; their neighbours are compared, not looked at by the
    pattern. Places count from 0.
    """
    known = fixer.known_suggestions()
    kind = "CASE suggestion " + " ".join(f"WHEN {_q(k)} THEN {_q(v[0])}" for k, v in known.items()) + " ELSE '' END"
    swap = "CASE suggestion " + " ".join(f"WHEN {_q(k)} THEN {_q(v[1])}" for k, v in known.items()) + " ELSE '' END"
    deletable, never = (", ".join(_q(x) for x in xs) for xs in (fixer.DELETABLE, fixer.NEVER_AUTO))
    directives = ", ".join(_q(x) for x in house.DIRECTIVES)
    trim = oracle._trim
    inflected = "CASE WHEN NOT contains(swap, ' ') AND lower(was) LIKE '%ing' AND NOT swap LIKE '%ing' THEN regexp_replace(swap, 'e$', '') || 'ing' ELSE swap END"
    edge = lambda x: f"NOT regexp_matches({x}, '[A-Za-z0-9]')"
    seams = "regexp_replace(regexp_replace(regexp_replace(raw, '[ \\t]+([,.;:!?])', '\\1', 'g'), '[ \\t]{2,}', ' ', 'g'), '(?m)[ \\t]+$', '', 'g')"
    start = "(?:\\A|[.!?][\"''\\)\\]]?\\s+|\\n[ \\t]*\\n[ \\t]*)[a-z]"
    return f"""WITH RECURSIVE {_scan()},
found AS (SELECT doc_id, idx AS i, type, trim(text) AS quoted, suggestion FROM rk UNION ALL SELECT doc_id, 100000 + idx, type, trim(text), suggestion FROM pk),
usable AS (SELECT f.*, {kind} AS kind, {swap} AS swap, t.text FROM found f JOIN texts t ON t.doc_id = f.doc_id WHERE type NOT IN ({never}) AND length(quoted) BETWEEN 2 AND 120),
places AS (SELECT *, unnest(range(0, length(text) - length(quoted) + 1)) AS a FROM usable WHERE kind <> '' OR type IN ({deletable})),
spots AS (SELECT *, a + length(quoted) AS b, substr(text, a + 1, length(quoted)) AS was FROM places WHERE lower(substr(text, a + 1, length(quoted))) = lower(quoted) AND (a = 0 OR {edge("substr(text, a, 1)")}) AND {edge("substr(text, a + length(quoted) + 1, 1)")}),
cuts AS (SELECT *, length(regexp_extract(substr(text, b + 1), '^\\s*,\\s*')) AS comma, length(regexp_extract(substr(text, b + 1), '^\\s+')) AS space FROM spots WHERE (kind = 'delete' OR kind = '' AND type IN ({deletable})) AND regexp_matches(left(text, a), '(?:^|[.!?:;]\\s*|\\n\\s*)$')),
deletions AS (SELECT doc_id, i, a, b + CASE WHEN comma > 0 THEN comma WHEN regexp_matches(was, '(?i)\\b(that|to note that)$') THEN space WHEN space > 0 AND regexp_matches({trim("was")}, {_q(fixer.STANDALONE)}) THEN space END AS b, '' AS put FROM cuts),
swaps AS (SELECT *, {_case("was", "(" + inflected + ")")} AS put FROM spots WHERE kind = 'swap'),
hspans AS (SELECT h.doc_id, f.idx - 200000 AS i, h.at0 AS a, h.at0 + length(h.text) AS b, h.text AS was, trim(f.suggestion) AS target FROM (SELECT *, spot::BIGINT AS at0 FROM h1) h JOIN hk f ON f.doc_id = h.doc_id AND f.seq = h.seq AND lower(f.text) = lower(h.text)),
hpicks AS (SELECT *, CASE WHEN regexp_matches(target, '[A-Za-z0-9]') THEN {trim("string_split_regex(target, '\\s*[,/]\\s*')[1]")} ELSE target END AS pick FROM hspans WHERE lower(target) NOT IN ({directives}) AND target <> ''),
edits AS (SELECT doc_id, i, a, b, {_case("was", "pick")} AS put FROM hpicks WHERE pick <> '' UNION ALL SELECT doc_id, i, a, b, put FROM deletions WHERE b IS NOT NULL
  UNION ALL SELECT doc_id, i, a, b, put FROM swaps WHERE lower(put) <> lower(was) AND NOT (regexp_matches(substr(text, greatest(0, a - 6) + 1, a - greatest(0, a - 6)), '(?i)\\b(a|an|the)\\s+$') AND regexp_matches(swap, '^\\w+s$'))),
queue AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY a, b DESC, i) AS n FROM edits),
steps AS (SELECT t.doc_id, 0::BIGINT AS n, ''::VARCHAR AS made, 0::BIGINT AS at0, 0::BIGINT AS applied, []::BIGINT[] AS touched FROM texts t
  UNION ALL SELECT s.doc_id, q.n, CASE WHEN q.a < s.at0 THEN s.made ELSE s.made || substr(t.text, s.at0 + 1, q.a - s.at0) || q.put END, CASE WHEN q.a < s.at0 THEN s.at0 ELSE q.b END, s.applied + CASE WHEN q.a < s.at0 THEN 0 ELSE 1 END,
    CASE WHEN q.a < s.at0 THEN s.touched ELSE list_append(s.touched, q.i) END FROM steps s JOIN queue q ON q.doc_id = s.doc_id AND q.n = s.n + 1 JOIN texts t ON t.doc_id = s.doc_id),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) AS k FROM steps) WHERE k = 1),
spliced AS (SELECT l.doc_id, l.applied, len(list_distinct(l.touched)) AS touched, l.made || substr(t.text, l.at0 + 1) AS raw FROM last l JOIN texts t ON t.doc_id = l.doc_id),
sewn AS (SELECT doc_id, applied, touched, {seams} AS x FROM spliced),
parts AS (SELECT *, string_split_regex(x, '{start}') AS gaps, regexp_extract_all(x, '{start}') AS hits FROM sewn)
SELECT p.doc_id, applied::INTEGER AS applied, (sc.nh + (SELECT count(*) FROM rk WHERE rk.doc_id = p.doc_id) + sc.np - touched)::INTEGER AS manual,
  array_to_string(list_transform(range(1, len(gaps) + 1), lambda g: gaps[g] || CASE WHEN g <= len(hits) THEN substr(hits[g], 1, length(hits[g]) - 1) || upper(right(hits[g], 1)) ELSE '' END), '') AS fixed_text
FROM parts p JOIN sc ON sc.doc_id = p.doc_id"""


def all_sql() -> dict[str, str]:
    return {"fix_text": fix_text(), "resume_findings": resume_findings(), "resume_scores": resume_scores(), "scan_documents": scan_documents(), "all_issues_order": all_issues_order()}
