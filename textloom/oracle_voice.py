"""Screening, profiles and voice as DuckDB SQL, written apart from the Spark expressions."""

from __future__ import annotations

from textloom import oracle_scan
from textloom.operators import corpus, profile, voice
from textloom.operators.scoring import VOICE_BANDS
from textloom.oracle import METRIC_COLUMNS, _band_case, _n_words, _q, _round1, _trim, measured

_EVERY = f"""
every AS (SELECT * FROM (SELECT source AS author, doc_id AS sample, CASE WHEN doc_id % 5 = 0 THEN 'spoken' ELSE 'written' END AS type, {_trim("regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g')")} AS text FROM documents)
  WHERE len(regexp_extract_all(text, '\\S+')) BETWEEN 100 AND 20000)"""


def _samples() -> str:
    """CTEs every (samples of a usable size), verdict (whether the detector flags them) and samples (those it does not)."""
    return f"""{_EVERY},
ptexts AS (SELECT sample AS doc_id, text, 'essay' AS mode FROM every), {oracle_scan.prose_findings()},
v0 AS (SELECT e.sample, len(regexp_extract_all(e.text, '\\S+')) AS wc, coalesce((SELECT sum(weight) FROM pk WHERE pk.doc_id = e.sample), 0)::DOUBLE AS raw, (SELECT count(*) FROM pk WHERE pk.doc_id = e.sample) AS n FROM every e),
v1 AS (SELECT *, greatest(0.0::DOUBLE, least(100.0::DOUBLE, raw / greatest(1.0::DOUBLE, log2(wc / 50.0::DOUBLE)))) AS base, CASE WHEN n > 0 THEN raw / wc * 100 ELSE 0 END AS density, least(1.0::DOUBLE, pow(n::DOUBLE / 3, 2)) AS evidence FROM v0),
verdict AS (SELECT sample, wc, floor(least(100, greatest(base, 100 * (1 - exp(-density / 26)) * evidence)) + 0.5::DOUBLE) >= {corpus.FLAGGED_FROM} AS flagged FROM v1),
samples AS (SELECT e.* FROM every e JOIN verdict v ON v.sample = e.sample AND NOT v.flagged)"""


def _profile() -> str:
    needs = ", ".join(f"('{mid}', {need})" for mid, _, _, _, need in profile.METRICS[:8])
    long = " UNION ALL ".join(f"SELECT author, '{k}' AS metric, \"{k}\" AS v FROM sm WHERE type = 'written'" for k in METRIC_COLUMNS)
    return f"""{_samples()}, {measured("samples", "sm", "author, sample, type")},
have AS (SELECT author, sum(n)::BIGINT AS total_words, coalesce(sum(n) FILTER (WHERE type = 'written'), 0)::BIGINT AS have FROM sm GROUP BY author),
seen AS (SELECT author, metric, count(v) AS samples, avg(v) AS mean, coalesce(stddev_samp(v), 0) AS sd, min(v) AS low, max(v) AS high FROM ({long}) GROUP BY author, metric),
prof AS (SELECT h.author, q.metric, h.have >= q.need AND coalesce(s.samples, 0) >= 2 AS available, h.have, coalesce(s.samples, 0) AS samples, s.mean, s.sd, s.low, s.high
  FROM have h CROSS JOIN (VALUES {needs}) AS q(metric, need) LEFT JOIN seen s ON s.author = h.author AND s.metric = q.metric),
bands AS (SELECT author, metric, available, have, samples, {", ".join(f"CASE WHEN available THEN {_round1(c)} END AS {c}" for c in ("mean", "sd", "low", "high"))} FROM prof),
op AS (SELECT author, sample, unnest(openers) AS word, unnest(range(len(openers))) AS pos FROM sm WHERE type = 'written'),
opc AS (SELECT author, word, count(*) AS cnt, min(sample) AS s1, min_by(pos, (sample, pos)) AS p1 FROM op GROUP BY author, word),
top AS (SELECT author, word, cnt, (sum(cnt) OVER (PARTITION BY author))::BIGINT AS total, count(*) OVER (PARTITION BY author) AS distinct_words, row_number() OVER (PARTITION BY author ORDER BY cnt DESC, s1, p1) AS rank FROM opc),
top12 AS (SELECT author, word, cnt, total, distinct_words, {_round1("cnt::DOUBLE / total * 100")} AS rate, rank::INTEGER AS rank FROM top WHERE rank <= 12)"""


def _signature() -> str:
    stop = ", ".join(_q(w) for w in profile.STOPWORDS)
    base = ", ".join(f"('{w}', {n})" for w, n in profile.BASELINE.items())
    return f"""WITH {_profile()},
w AS (SELECT author, word, count(*) AS cnt, count(DISTINCT sample) AS spread FROM (SELECT author, sample, lower(unnest(ws)) AS word FROM sm) GROUP BY author, word),
r AS (SELECT w.author, w.word, cnt, spread, {_round1("cnt::DOUBLE / total_words * 1e5::DOUBLE")} AS per100k, cnt::DOUBLE / total_words * 1e6::DOUBLE / coalesce(b.base, 20) AS x
  FROM w JOIN have h ON h.author = w.author LEFT JOIN (VALUES {base}) AS b(word, base) ON b.word = w.word WHERE length(w.word) >= 4 AND spread >= 2 AND cnt >= 3 AND w.word NOT IN ({stop})),
k AS (SELECT author, word, cnt, spread, per100k, {_round1("x")} AS ratio FROM r WHERE x >= 3)
SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY author ORDER BY ratio DESC, cnt DESC, word))::INTEGER AS rank FROM k) WHERE rank <= 15"""


def _evidence() -> str:
    units = {mid: unit for mid, _, unit, _, _ in profile.METRICS}
    ends = [k for k in METRIC_COLUMNS if k not in ("sentenceLength", "contractionRate")]
    long = " UNION ALL ".join(f"SELECT author, sample, '{k}' AS metric, '{units[k]}' AS unit, \"{k}\" AS v FROM sm WHERE type = 'written' AND \"{k}\" IS NOT NULL" for k in ends)
    shown = lambda x: f"regexp_replace(({x})::VARCHAR, '\\.0$', '')"
    cut = lambda x, n: f"CASE WHEN length({x}) > {n} THEN substr({x}, 1, {n - 1}) || '…' ELSE {x} END"
    return f"""WITH {_profile()},
lo AS (SELECT *, row_number() OVER (PARTITION BY author, metric ORDER BY v, sample) AS up, row_number() OVER (PARTITION BY author, metric ORDER BY v DESC, sample DESC) AS down FROM ({long})),
ev AS (SELECT author, metric, 0 AS place, sample, v, unit FROM lo WHERE up = 1 UNION ALL SELECT author, metric, 1, sample, v, unit FROM lo WHERE down = 1),
st AS (SELECT b.author, b.sample, unnest(b.sents) AS sent, unnest(range(len(b.sents))) AS pos FROM sm_b b WHERE type = 'written'),
ct AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY sample, pos) - 1 AS place FROM st WHERE regexp_matches(sent, '(?i)\\b\\w+[''’](?:t|s|re|ve|ll|d|m)\\b')),
sl AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY n, sample, pos) - 1 AS i, count(*) OVER (PARTITION BY author) AS total FROM (SELECT *, {_n_words("sent")} AS n FROM st)),
pk3 AS (SELECT author, 0 AS place, sample, n, sent FROM sl WHERE i = 0 UNION ALL SELECT author, 1, sample, n, sent FROM sl WHERE i = total // 2 UNION ALL SELECT author, 2, sample, n, sent FROM sl WHERE i = total - 1)
SELECT author, metric, place::INTEGER AS place, 'doc ' || sample AS label, {_round1("v")} AS value, 'doc ' || sample || ': ' || {shown(_round1("v"))} || ' ' || unit AS text FROM ev
UNION ALL SELECT author, 'contractionRate', place, 'doc ' || sample, NULL, {cut("sent", profile.CONTRACTION_EXCERPT)} FROM ct WHERE place < 3
UNION ALL SELECT author, 'sentenceLength', place, 'doc ' || sample, n::DOUBLE, {cut("sent", profile.EXCERPT)} FROM pk3"""


def _status() -> str:
    return f"""
WITH {_samples()}, f AS (SELECT e.author, e.type, v.wc AS w, NOT v.flagged AS good FROM every e JOIN verdict v ON v.sample = e.sample),
a AS (SELECT author, count(*) AS sample_count, count(*) FILTER (WHERE good) AS usable_count, count(*) FILTER (WHERE good AND type = 'written') AS written_count, sum(w)::BIGINT AS total_words,
  coalesce(sum(w) FILTER (WHERE good), 0)::BIGINT AS usable_words, coalesce(sum(w) FILTER (WHERE good AND type = 'written'), 0)::BIGINT AS written_words, count(*) FILTER (WHERE NOT good) AS flagged_count FROM f GROUP BY author),
b AS (SELECT *, usable_count >= 4 AND usable_words >= 1500 AS ok FROM a)
SELECT author, sample_count, usable_count, written_count, total_words, usable_words, written_words, flagged_count, usable_words - written_words AS spoken_words, ok,
  CASE WHEN NOT ok THEN 'none' WHEN usable_words >= 3000 AND usable_count >= 6 THEN 'high' WHEN usable_words >= 3000 OR usable_count >= 6 THEN 'medium' ELSE 'low' END AS confidence,
  concat_ws(' ', CASE WHEN usable_count < 4 THEN usable_count || ' of 4 samples. Add ' || (4 - usable_count) || ' more.' END, CASE WHEN usable_words < 1500 THEN usable_words || ' of 1500 words. Sentence statistics are noise below that.' END,
    CASE WHEN flagged_count > 0 THEN flagged_count || ' samples read as AI-assisted and are excluded.' END) AS reasons FROM b
"""


def _voice() -> str:
    """Findings of the bands and openers. None of the absence candidates occurs in the driver's documents."""
    num = lambda x: f"regexp_replace(({x})::VARCHAR, '\\.0$', '')"
    drafts = " UNION ALL ".join(f"SELECT doc_id, author, '{k}' AS metric, {_round1(chr(34) + k + chr(34))} AS v FROM dm WHERE n >= 80" for k in METRIC_COLUMNS)
    text = "CASE metric " + " ".join(f"WHEN '{k}' THEN {_q(a)} || {num('low')} || {_q(u + ' to ')} || {num('high')} || {_q(mid)} || {num('v')} || {_q(z)}" for k, (a, u, mid, z) in voice.PHRASING.items()) + " END"
    return f"""{_profile()},
ds AS (SELECT doc_id, 'src' || ((regexp_extract(source, '(\\d+)$', 1)::INTEGER + 1) % 20) AS author, coalesce(text, '') AS text FROM documents), {measured("ds", "dm", "doc_id, author")},
dv AS ({drafts}),
c AS (SELECT d.*, b.low, b.high, greatest(b.high - b.low, abs(b.high) * 0.15::DOUBLE, 0.5::DOUBLE) AS width FROM dv d JOIN bands b ON b.author = d.author AND b.metric = d.metric WHERE b.available AND d.v IS NOT NULL),
e AS (SELECT *, CASE WHEN v > high + width * 0.25::DOUBLE THEN 'above' ELSE 'below' END AS direction, CASE WHEN v > high + width * 0.25::DOUBLE THEN v - high ELSE low - v END / width AS ratio FROM c WHERE v > high + width * 0.25::DOUBLE OR v < low - width * 0.25::DOUBLE),
bf AS (SELECT doc_id, metric, CASE WHEN ratio >= 1.5 THEN 'high' WHEN ratio >= 0.6 THEN 'medium' ELSE 'low' END AS severity, direction, v AS draft_value, least(22, floor(8 * (1 + ratio) + 0.5::DOUBLE))::BIGINT AS penalty, {text} AS text FROM e),
dop AS (SELECT doc_id, author, word, count(*) AS cnt, len(any_value(openers)) AS total FROM (SELECT doc_id, author, openers, unnest(openers) AS word FROM dm WHERE n >= 80) GROUP BY doc_id, author, word),
dor AS (SELECT d.*, {_round1("d.cnt::DOUBLE / d.total * 100")} AS r, coalesce(t.rate, 0) AS yours FROM dop d JOIN have h ON h.author = d.author AND h.have >= 600 LEFT JOIN top12 t ON t.author = d.author AND t.word = d.word),
oo AS (SELECT doc_id, 'sentenceOpeners' AS metric, 'medium' AS severity, NULL AS direction, r AS draft_value, 8::BIGINT AS penalty, 'you open ' || {num("yours")} || '% of sentences with "' || word || '", this draft opens ' || {num("r")} || '% of them that way' AS text FROM dor WHERE total >= 5 AND cnt >= 3 AND r >= 20 AND r >= 2.5::DOUBLE * yours),
obf AS (SELECT doc_id, count(*) AS k FROM oo GROUP BY doc_id)"""


def _voice_scores() -> str:
    return f"""WITH {_voice()},
gate AS (SELECT dm.doc_id, dm.author, dm.n >= 80 AND h.author IS NOT NULL AND (EXISTS (SELECT 1 FROM bands b WHERE b.author = dm.author AND b.available) OR h.have >= 600 OR h.total_words >= 1500) AS ok FROM dm LEFT JOIN have h ON h.author = dm.author),
t AS (SELECT g.doc_id, g.author, coalesce(g.ok, false) AS available, coalesce((SELECT sum(penalty) FROM bf WHERE bf.doc_id = g.doc_id), 0) + 8 * coalesce((SELECT k FROM obf WHERE obf.doc_id = g.doc_id), 0) AS d FROM gate g)
SELECT doc_id, author, available, CASE WHEN available THEN greatest(0, 100 - d)::BIGINT END AS score, CASE WHEN available THEN {_band_case("greatest(0, 100 - d)", VOICE_BANDS)} END AS band, CASE WHEN available THEN d::BIGINT END AS deducted FROM t"""


def all_sql() -> dict[str, str]:
    return {
        "profile_bands": f"WITH {_profile()} SELECT * FROM bands",
        "openers_top12": f"WITH {_profile()} SELECT * FROM top12",
        "paragraph_openers_top12": f"WITH {_profile().replace('unnest(openers) AS word, unnest(range(len(openers)))', 'unnest(para_openers) AS word, unnest(range(len(para_openers)))')} SELECT * FROM top12",
        "profile_evidence": _evidence(),
        "signature_words": _signature(),
        "corpus_status": _status(),
        "voice_scores": _voice_scores(),
        "voice_findings": f"WITH {_voice()} SELECT * FROM bf UNION ALL SELECT * FROM oo",
    }
