"""SQL twins of the agent analytics and response scores."""

from __future__ import annotations

from ledgerloom.oracle.layers import STREAM_TS, avg, bound_sql, dbl, define, ratio, rnd
from ledgerloom.scoring.lexicon import (
    CATALOG_MARKERS,
    CONTEXT_MARKERS,
    DOLLARS,
    FAILURE_MARKERS,
    GLOSSARY_KEYWORDS,
    LONG_NUMBER,
    MENTIONED_TERMS,
    METADATA_PATTERNS,
    PERCENTAGES,
    PROBLEM_MARKERS,
    SECTIONS,
    TABLE_NAMES,
    expectations,
)
from ledgerloom.sources.bindings import AGENT_LINES, RESPONSES

QUERIES: dict[str, str] = {}


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strings(values) -> str:
    return "CAST([" + ", ".join(q(v) for v in values) + "] AS VARCHAR[])"


def any_of(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(w)})" for w in words) + ")"


def sc(e: str) -> str:
    return dbl(rnd(e, 2))


_DAY = f"ts > {STREAM_TS} - INTERVAL 24 HOUR"
_K = "json_extract_string(props, '$.k')"
QUERIES["ev_event_counts"] = f"""
SELECT event_type, count(*) AS event_count, {dbl(avg(f'TRY_CAST({_K} AS DECIMAL(18,4))', 2))} AS avg_latency_ms
FROM events WHERE {_DAY} GROUP BY 1"""
define("ev_calls", f"""
SELECT ['Basic', 'Scaled', 'KC'][user_id % 3 + 1] AS agent, 'tool_' || (TRY_CAST({_K} AS BIGINT) % 5) AS tool_name,
  count(*) AS call_count FROM events WHERE event_type = 'click' AND {_DAY} GROUP BY 1, 2""")
QUERIES["ev_tool_calls"] = "SELECT * FROM ev_calls"
QUERIES["ev_tool_pivot"] = "SELECT tool_name, " + ", ".join(
    f"CAST(coalesce(sum(call_count) FILTER (agent = '{a}'), 0) AS BIGINT) AS {q(a)[1:-1]}"
    for a in ("Basic", "Scaled", "KC")) + " FROM ev_calls GROUP BY 1"

# ---- responses ---------------------------------------------------------------------------------

define("ev_responses", bound_sql(RESPONSES))
_CASES = ", ".join(
    f"({no}, '{agent}', '{kind}', '{outcome}', {', '.join(map(strings, lists))})" for no, agent, kind, outcome, *lists in expectations())
_TABLES = f"list_filter({strings(TABLE_NAMES)}, lambda t: contains(low, t))"
_TERMS = ("list_sort(list_distinct(flatten([" + ", ".join(
    f"CASE WHEN contains(low, {q(w)}) THEN {strings(terms)} ELSE CAST([] AS VARCHAR[]) END"
    for w, terms in MENTIONED_TERMS.items()) + "])))")
_META = ("list_filter([" + ", ".join(
    f"CASE WHEN regexp_matches(low, {q('|'.join(p))}) THEN '{kind}' END"
    for kind, p in METADATA_PATTERNS.items()) + "], lambda x: x IS NOT NULL)")
_KNOWN = ("list_filter([" + ", ".join(
    f"CASE WHEN {any_of('low', words)} THEN {q(t)} END" for t, words in GLOSSARY_KEYWORDS.items())
    + "], lambda x: x IS NOT NULL)")
_SIGNALS = " + ".join(f"CAST({s} AS INTEGER)" for s in (
    f"regexp_matches(raw, {q(DOLLARS)})", f"regexp_matches(raw, {q(PERCENTAGES)})",
    "(contains(raw, '|') AND contains(raw, '---'))", f"regexp_matches(raw, {q(LONG_NUMBER)})"))
define("ev_base", f"""
SELECT r.response_id, r.agent, r.case_no, r.latency_s, c.* EXCLUDE (no, of), r.response_text AS raw,
  lower(r.response_text) AS low
FROM ev_responses r JOIN (VALUES {_CASES}) AS c(no, of, complexity, expected_outcome, rt, wt, terms_due, meta_due)
ON c.no = r.case_no AND c.of = r.agent""")
define("ev_found", f"""
SELECT *, {_TABLES} AS tables, {_TERMS} AS terms, {_META} AS found, {_KNOWN} AS known,
  {sc(f'least(1.0, ({_SIGNALS}) / CAST(2 AS DOUBLE))')} AS data_in_response,
  CASE WHEN {any_of('low', FAILURE_MARKERS)} THEN CAST(1 AS DOUBLE)
    WHEN contains(low, 'error') AND length(raw) < 200 THEN CAST(0.3 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
    AS graceful_failure
FROM ev_base""")
_HIT = "len(list_intersect(rt, tables))"
_MISS = "len(list_intersect(wt, tables))"
_COVER = f"CASE WHEN len(rt) = 0 THEN 1.0 ELSE least(1.0, CAST({_HIT} AS DOUBLE) / least(len(rt), 2)) END"
_CITED = ("len(list_filter(terms_due, lambda t: CASE WHEN list_contains(" + strings(GLOSSARY_KEYWORDS)
          + ", t) THEN list_contains(known, t) ELSE contains(low, lower(t)) END))")
_SECTIONS = " + ".join(f"CAST(regexp_matches(raw, {q(s)}) AS INTEGER)" for s in SECTIONS)
_MARKS = " + ".join(f"CAST(contains(low, {q(m)}) AS INTEGER)" for m in CATALOG_MARKERS)
define("ev_partial", f"""
SELECT *, CASE WHEN len(rt) = 0 AND len(wt) = 0 THEN CAST(1 AS DOUBLE) WHEN len(tables) = 0 THEN CAST(0 AS DOUBLE)
    ELSE {sc(f'greatest(0.0, {_COVER} - {_MISS} * CAST(0.3 AS DOUBLE))')} END AS table_selection,
  CASE WHEN len(terms_due) = 0 THEN CAST(1 AS DOUBLE)
    ELSE {sc(f'CAST({_CITED} AS DOUBLE) / len(terms_due)')} END AS glossary_citation,
  CASE WHEN len(meta_due) = 0 THEN {sc('least(1.0, len(found) / CAST(2 AS DOUBLE))')}
    ELSE {sc('CAST(len(list_intersect(found, meta_due)) AS DOUBLE) / len(meta_due)')} END AS metadata_citation,
  CASE WHEN agent = 'kc' THEN {sc(f'({_SECTIONS}) / CAST(4 AS DOUBLE)')}
    WHEN length(raw) > 200 AND data_in_response > 0 THEN 1.0 WHEN length(raw) > 200 THEN 0.5 ELSE 0.0 END
    AS response_structure,
  CAST(least(100, CASE WHEN len(list_filter(rt, lambda t: contains(low, t))) > 0 THEN 30 ELSE 0 END
    + CASE WHEN {any_of('low', CONTEXT_MARKERS)} THEN 20 ELSE 0 END
    + CASE WHEN agent = 'kc' THEN least(50, 10 * ({_MARKS})) ELSE 0 END
    + CASE WHEN {any_of('low', PROBLEM_MARKERS)} THEN 0 ELSE 10 END) AS BIGINT) AS heuristic_score
FROM ev_found""")
define("ev_scored", f"""
SELECT *, CAST(CASE expected_outcome WHEN 'fail_gracefully' THEN graceful_failure
  WHEN 'partial' THEN CASE WHEN {_MISS} > 0 THEN 0.3 WHEN data_in_response = 0 THEN 0.2
    WHEN table_selection >= 0.5 THEN 0.7 ELSE 0.5 END
  ELSE CASE WHEN data_in_response = 0 THEN 0.2 WHEN table_selection >= 0.8 THEN 1.0
    WHEN table_selection >= 0.5 THEN 0.8 ELSE 0.5 END END AS DOUBLE) AS outcome
FROM ev_partial""")

for _name, _cols in (
    ("table_mentions", "array_to_string(tables, ',') AS tables, len(tables) AS n_tables"),
    ("glossary_mentions", "array_to_string(terms, ',') AS terms, len(terms) AS n_terms"),
    ("table_selection", "table_selection"), ("graceful_failure", "graceful_failure"),
    ("data_in_response", "data_in_response"), ("glossary_citation", "glossary_citation"),
    ("metadata_citation", "metadata_citation, array_to_string(found, ',') AS found_metadata"),
    ("response_structure", "agent, CAST(response_structure AS DOUBLE) AS response_structure"),
    ("outcome", "expected_outcome, outcome"), ("heuristic_score", "agent, heuristic_score"),
):
    QUERIES[f"ev_{_name}"] = f"SELECT response_id, {_cols} FROM ev_scored"

_METRICS = ("outcome", "table_selection", "data_in_response", "response_structure", "graceful_failure",
            "glossary_citation", "metadata_citation", "latency_s")


_APPLIES = {"graceful_failure": "expected_outcome = 'fail_gracefully'", "glossary_citation": "len(terms_due) > 0",
            "metadata_citation": "len(meta_due) > 0"}


def _mean(metric: str, agent: str) -> str:
    v = f"CAST({metric} AS DECIMAL(18,6))"
    rows = f"FILTER (agent = '{agent}' AND {_APPLIES.get(metric, 'TRUE')})"
    return dbl(ratio(f"sum({v}) {rows}", f"count(*) {rows}", 4))


QUERIES["ev_report"] = " UNION ALL ".join(
    f"SELECT '{m}' AS metric, " + ", ".join(f"{_mean(m, a)} AS {a}" for a in ("basic", "scaled", "kc"))
    + " FROM ev_scored" for m in _METRICS)
_AVG = dbl(avg("CAST(outcome AS DECIMAL(18,4))", 4))
QUERIES["ev_report_complexity"] = f"""
SELECT complexity, agent, count(*) AS cases, count(*) FILTER (outcome >= 0.8) AS passed, {_AVG} AS avg_outcome,
  {dbl(ratio('count(*) FILTER (outcome >= 0.8)', 'count(*)', 4))} AS pass_rate,
  CASE WHEN {_AVG} < 0.4 THEN '-' WHEN {_AVG} < 0.8 THEN '~' ELSE '+' END AS symbol
FROM ev_scored GROUP BY 1, 2"""
QUERIES["ev_judge_normalise"] = f"""
SELECT s.response_id, s.agent, s.case_no, {dbl('l.quality * 4 + l.doc_id % 3 - l.toxic')} AS raw_score,
  greatest(0.0, least(1.0, {sc('(l.quality * 4 + l.doc_id % 3 - l.toxic - 1) / CAST(4 AS DOUBLE)')})) AS judge_score,
  s.outcome
FROM labels l JOIN ev_scored s ON s.response_id = 'D-' || l.doc_id"""

# ---- parsed lines ------------------------------------------------------------------------------

define("ev_lines", bound_sql(AGENT_LINES))
define("ev_parts", """
SELECT line_id, unnest(range(CAST(json_array_length(line, '$.content.parts') AS BIGINT))) AS part_no, line FROM ev_lines
WHERE json_valid(line) AND json_type(line, '$.content.parts') = 'ARRAY'""")
define("ev_part", """
SELECT line_id, CAST(part_no AS BIGINT) AS part_no, json_extract(line, '$.content.parts[' || part_no || ']') AS p
FROM ev_parts""")
define("ev_typed", """
SELECT line_id, part_no, p, CASE WHEN json_exists(p, '$.function_call') THEN 'tool_call'
    WHEN json_exists(p, '$.function_response') THEN 'tool_response'
    WHEN json_exists(p, '$.text') THEN 'text_chunk' END AS type,
  lower(coalesce(CAST(json_extract(p, '$.function_call.args') AS VARCHAR),
    json_extract_string(p, '$.function_response.response.result'), '')) AS low
FROM ev_part""")
QUERIES["ev_parse_events"] = f"""
SELECT line_id, part_no, type,
  CASE WHEN type <> 'text_chunk' THEN coalesce(json_extract_string(p, '$.function_call.name'),
    json_extract_string(p, '$.function_response.name'), '') END AS name,
  CASE WHEN type = 'text_chunk' THEN json_extract_string(p, '$.text') END AS text,
  CASE WHEN type <> 'text_chunk' THEN array_to_string({_TABLES}, ',') END AS tables,
  CASE WHEN type = 'tool_response' THEN array_to_string({_TERMS}, ',') END AS glossary_terms
FROM ev_typed WHERE type IS NOT NULL"""
