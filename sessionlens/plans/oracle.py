"""The registered queries once more as plain SQL over the same tables (DuckDB dialect).

Written from the definitions, independently of the Spark expressions: joins
instead of arrays, brute force instead of tiles.
"""

from __future__ import annotations

from sessionlens.schema import CSV_SIGNALS, FEATURES, RULES, SIGNALS, SIMILARITY_FEATURES

SPACE = (r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
         r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")


def _words(text: str) -> str:
    return f"len(regexp_extract_all({text}, '[^{SPACE}]+'))"


def _blank(text: str) -> str:
    return f"(NOT regexp_matches({text}, '[^{SPACE}]'))"


def _r2(x: str) -> str:
    """Two decimals from the exact binary value, ties to even (x >= 0)."""
    high = f"(({x}) * 134217729.0 - (({x}) * 134217729.0 - ({x})))"
    whole = f"floor(({x}) * 100)"
    beyond = f"(({high} * 200 - ({whole} * 2 + 1)) + (({x}) - {high}) * 200)"
    return f"(({whole} + CASE WHEN {beyond} > 0 THEN 1 WHEN {beyond} < 0 THEN 0 ELSE {whole} % 2 END) / 100.0)"


def _mean(total: str, count: str) -> str:
    x = f"(CAST({total} AS DOUBLE) / {count})"
    return f"CASE WHEN {count} > 0 THEN {_r2(x)} ELSE 0.0 END"


_FINAL = {
    "interview_duration_seconds": "coalesce((last - first) / 1000000.0, 0.0)",
    "transcript_turn_count": "turn",
    "interviewer_turn_count": "turn_i",
    "candidate_turn_count": "turn_c",
    "interview_stage_count": "stages",
    "total_llm_calls": "llm",
    "failed_llm_calls": "llm_failed",
    "average_llm_latency_ms": _mean("lat_sum", "lat_n"),
    "maximum_llm_latency_ms": "coalesce(lat_max, 0)",
    "total_prompt_tokens": "tok_in",
    "total_completion_tokens": "tok_out",
    "total_tokens": "tok_in + tok_out",
    "average_response_time": _mean("resp_sum", "resp_n"),
    "total_tool_calls": "tool",
    "failed_tool_calls": "tool_failed",
    "average_tool_latency": _mean("dur_sum", "dur_n"),
    "maximum_tool_latency": "coalesce(dur_max, 0)",
    "retry_count": "retries",
    "total_events": "evs",
    "timeout_events": "timeouts",
    "retry_events": "retries",
    "failure_events": "errors",
    "average_candidate_response_length": _mean("len_c", "turn_c"),
    "average_interviewer_question_length": _mean("len_i", "turn_i"),
    "empty_candidate_responses": "blank_c",
    "empty_transcript_turns": "blank",
    "high_latency_detected": "CASE WHEN greatest(coalesce(lat_max, 0), coalesce(dur_max, 0)) >= 5000 THEN 1 ELSE 0 END",
    "multiple_retries": "CASE WHEN retries >= 2 THEN 1 ELSE 0 END",
    "empty_transcript": "CASE WHEN turn = 0 OR blank > 0 THEN 1 ELSE 0 END",
    "json_errors_detected": "CASE WHEN jsons > 0 THEN 1 ELSE 0 END",
    "tool_failures_detected": "CASE WHEN tool_failed > 0 THEN 1 ELSE 0 END",
}
_SIGNAL_COLUMNS = ", ".join(f"CAST({_FINAL[n]} AS DOUBLE) AS {n}" for n in FEATURES)


def _fold(turn: str, asks: str, answers: str, length: str, blank: str, stage: str, llm: str, llm_fail: str, latency: str,
          response: str, tin: str, tout: str, tool: str, tool_fail: str, duration: str, micros: str, retry: str,
          timeout: str, error: str, json: str) -> str:
    return f"""
  count(*) FILTER (WHERE {turn}) AS turn, count(*) FILTER (WHERE {turn} AND {asks}) AS turn_i,
  count(*) FILTER (WHERE {turn} AND {answers}) AS turn_c,
  coalesce(sum({length}) FILTER (WHERE {turn} AND {asks}), 0) AS len_i,
  coalesce(sum({length}) FILTER (WHERE {turn} AND {answers}), 0) AS len_c,
  count(*) FILTER (WHERE {turn} AND {blank}) AS blank, count(*) FILTER (WHERE {turn} AND {answers} AND {blank}) AS blank_c,
  count(DISTINCT {stage}) AS stages,
  count(*) FILTER (WHERE {llm}) AS llm, count(*) FILTER (WHERE {llm} AND {llm_fail}) AS llm_failed,
  count({latency}) FILTER (WHERE {llm}) AS lat_n, sum({latency}) FILTER (WHERE {llm}) AS lat_sum,
  max({latency}) FILTER (WHERE {llm}) AS lat_max,
  count({response}) FILTER (WHERE {llm}) AS resp_n, sum({response}) FILTER (WHERE {llm}) AS resp_sum,
  coalesce(sum({tin}) FILTER (WHERE {llm}), 0) AS tok_in, coalesce(sum({tout}) FILTER (WHERE {llm}), 0) AS tok_out,
  count(*) FILTER (WHERE {tool}) AS tool, count(*) FILTER (WHERE {tool} AND {tool_fail}) AS tool_failed,
  count({duration}) FILTER (WHERE {tool}) AS dur_n, sum({duration}) FILTER (WHERE {tool}) AS dur_sum,
  max({duration}) FILTER (WHERE {tool}) AS dur_max,
  max({micros}) AS last, min({micros}) AS first,
  count(*) FILTER (WHERE {retry}) AS retries, count(*) FILTER (WHERE {timeout}) AS timeouts,
  count(*) FILTER (WHERE {error}) AS errors, count(*) AS evs, count(*) FILTER (WHERE {json}) AS jsons"""


# --- event log --------------------------------------------------------------------

_EVENT_CTE = f"""
raw AS (SELECT event_id, user_id, event_type AS kind, ts, CAST(date_trunc('week', ts) AS TIMESTAMP) AS week,
  round(value * 100) AS cents, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k FROM events),
tel AS (SELECT *, user_id || '-' || CAST(CAST(week AS DATE) AS VARCHAR) AS session_id,
  epoch_us(week) + (epoch_us(ts) - epoch_us(week)) // 300 AS us,
  CASE k % 5 WHEN 0 THEN 'Request timeout.' WHEN 1 THEN 'Retry attempt.' ELSE kind END AS d,
  CASE WHEN k % 17 = 0 THEN '' ELSE CASE k % 5 WHEN 0 THEN 'Request timeout.' WHEN 1 THEN 'Retry attempt.' ELSE kind END END AS txt
  FROM raw),
fold AS (SELECT session_id, min(user_id) AS user_id, min(week) AS week, {_fold(
    "kind IN ('view', 'signup')", "event_id % 2 = 1", "event_id % 2 = 0",
    f"CASE WHEN k % 4 <> 0 THEN k ELSE {_words('txt')} END", _blank("txt"),
    "CASE WHEN k % 6 < 5 THEN k % 6 END",
    "kind = 'purchase'", "k % 10 IN (0, 1)", "cents", "cents", "k * 40", "k * 7",
    "kind = 'click'", "k % 10 IN (0, 1)", "cents", "us", "contains(lower(d), 'retry')", "contains(lower(d), 'timeout')",
    "kind = 'error'", "kind IN ('purchase', 'click') AND (k % 8 = 4 OR k % 20 = 11)")}
  FROM tel GROUP BY session_id),
sig AS (SELECT session_id, user_id, week, {_SIGNAL_COLUMNS},
  CASE user_id % 4 WHEN 0 THEN 'timeout' WHEN 1 THEN 'tool_failure' WHEN 2 THEN 'prompt_issue' ELSE 'unknown' END AS root_cause,
  CASE user_id % 3 WHEN 0 THEN 'model_response' WHEN 1 THEN 'pipeline' END AS affected_component,
  'scenario_' || (user_id % 5) AS failure_category, week < TIMESTAMP '2024-01-15' AS baseline FROM fold)"""
_ALL = ", ".join(FEATURES)

# --- rules -------------------------------------------------------------------------

_LIMITS = {"llm_timeout_ms": 5000, "tool_timeout_ms": 5000, "max_retries": 2, "max_total_tokens": 10000,
           "long_interview_seconds": 1800, "min_transcript_turns": 4}


def _rule_rows() -> str:
    rows = []
    for position, r in enumerate(RULES):
        v, t = r.metric, _LIMITS.get(r.threshold, 1)
        g = f"printf('%g', {v})"
        if r.kind == "limit":
            score = f"CASE WHEN {v} >= {2 * t} THEN 1.0 WHEN {v} >= {t} THEN 0.75 ELSE 0.0 END"
            reason = f"'Observed ' || {g} || ' {r.unit}; threshold is {t} {r.unit}.'"
        elif r.kind == "count":
            score = f"CASE WHEN {v} >= 2 THEN 1.0 WHEN {v} > 0 THEN 0.75 ELSE 0.0 END"
            reason = f"'Observed ' || {g} || ' failed calls.'"
        elif r.kind == "retries":
            score = f"CASE WHEN {v} > {t} THEN 1.0 WHEN {v} = {t} THEN 0.75 ELSE 0.0 END"
            reason = f"'Observed ' || {g} || ' retries; threshold is {t}.'"
        elif r.kind == "minimum":
            score = f"CASE WHEN {v} = 0 THEN 1.0 WHEN {v} < {t} THEN 0.75 ELSE 0.0 END"
            reason = f"'Observed ' || {g} || ' transcript turns; minimum is {t}.'"
        else:
            score = f"CASE WHEN {v} > 0 THEN 1.0 ELSE 0.0 END"
            reason = f"CASE WHEN {v} > 0 THEN '{r.text_on}' ELSE '{r.text_off}' END"
        rows.append(
            f"SELECT session_id, {position} AS pos, '{r.rule_id}' AS rule_id, '{r.name}' AS rule_name,"
            f" CAST({score} AS DOUBLE) AS score, {reason} AS reason, '{v}' AS metric, {v} AS observed,"
            f" CAST({t} AS DOUBLE) AS expected, '{r.severity}' AS severity, '{r.explanation}' AS explanation FROM sig")
    return " UNION ALL ".join(rows)


_RULE_CTE = _EVENT_CTE + f""",
rul AS ({_rule_rows()}),
hit AS (SELECT * FROM rul WHERE score > 0)"""

# --- similarity ------------------------------------------------------------------------

_N = range(len(SIMILARITY_FEATURES))


def _similar(k: int) -> str:
    return f""",
st AS (SELECT {", ".join(f"avg({n}) AS m{i}, CASE WHEN stddev_pop({n}) = 0 THEN 1.0 ELSE stddev_pop({n}) END AS s{i}" for i, n in enumerate(SIMILARITY_FEATURES))} FROM sig WHERE baseline),
z AS (SELECT session_id, baseline, root_cause, user_id, interview_duration_seconds, average_tool_latency,
  {", ".join(f"({n} - m{i}) / s{i} AS z{i}" for i, n in enumerate(SIMILARITY_FEATURES))} FROM sig, st),
u AS (SELECT *, sqrt({" + ".join(f"z{i} * z{i}" for i in _N)}) AS norm FROM z),
pr AS (SELECT q.session_id, h.session_id AS match_session_id, nullif(h.root_cause, 'unknown') AS failure_type,
  'duration_seconds=' || printf('%.2f', h.interview_duration_seconds) || '; average_llm_latency_ms=None; average_tool_latency_ms='
  || printf('%.2f', h.average_tool_latency) || '; supporting_rule_count=' || (h.user_id % 4)
  || '; dataset_version=events; pipeline_version=None' AS summary,
  CASE WHEN q.norm = 0 OR h.norm = 0 THEN 0.0 ELSE round(({" + ".join(f"q.z{i} * h.z{i}" for i in _N)}) / (q.norm * h.norm), 9) END AS s
  FROM u q, u h WHERE NOT q.baseline AND h.baseline),
rk AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY s DESC, match_session_id) AS rank FROM pr),
sim AS (SELECT session_id, rank, match_session_id, greatest(0.0, least(1.0, s)) + 0.0 AS similarity_score, failure_type, summary
  FROM rk WHERE rank <= {k})"""


_CONFIDENCE = """
, cf AS (SELECT s.session_id,
  coalesce(avg(h.score), 0.0) AS rule_score, CASE WHEN count(h.score) > 0 THEN 1.0 ELSE 0.0 END AS evidence_completeness,
  coalesce(avg(CASE h.severity WHEN 'low' THEN 0.25 WHEN 'medium' THEN 0.5 WHEN 'high' THEN 0.75 WHEN 'critical' THEN 1.0 END), 0.0) AS evidence_severity,
  count(h.score) AS n_hits, coalesce(string_agg(h.rule_id, ',' ORDER BY h.pos), '') AS ids,
  coalesce(string_agg(h.explanation, '|' ORDER BY h.pos), '') AS notes,
  coalesce(max(CASE h.severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 END), 1) AS worst
  FROM sig s LEFT JOIN hit h USING (session_id) GROUP BY s.session_id)"""

_DIAGNOSIS = _RULE_CTE + _CONFIDENCE + """
, dg AS (SELECT *, 0.4 * rule_score + 0.2 * evidence_completeness + 0.2 * evidence_severity AS confidence,
  CASE WHEN regexp_matches(ids, 'high_llm_latency|failed_llm_calls') THEN 'timeout'
       WHEN regexp_matches(ids, 'high_tool_latency|failed_tool_calls') THEN 'tool_failure'
       WHEN regexp_matches(ids, 'json_validation_errors') THEN 'prompt_issue' ELSE 'unknown' END AS root_cause,
  CASE WHEN regexp_matches(ids, 'high_llm_latency|failed_llm_calls|json_validation_errors') THEN 'model_response'
       WHEN regexp_matches(ids, 'high_tool_latency|failed_tool_calls') THEN 'pipeline'
       WHEN regexp_matches(ids, 'empty_transcript|very_low_transcript_activity') THEN 'data' ELSE 'unknown' END AS affected_component,
  CASE worst WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity,
  'Confidence contributors: rule_score=' || printf('%.2f', rule_score) || ', evidence_completeness=' || printf('%.2f', evidence_completeness)
  || ', evidence_severity=' || printf('%.2f', evidence_severity)
  || ', historical_similarity=0.00, historical_failure_agreement=0.00.' AS confidence_text FROM cf)"""

_PERCENT = "CAST(CAST(round_even({0} * 100, 0) AS BIGINT) AS VARCHAR) || '%'"

# --- documents as nested sessions ----------------------------------------------------------

_DOC_CTE = f"""
ln0 AS (SELECT doc_id, n_chars, lang, source, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS i
  FROM (SELECT *, string_split(text, chr(10)) AS l FROM documents)),
ln AS (SELECT *, length(x) AS n, 'doc-' || doc_id AS session_id FROM ln0),
fold AS (SELECT session_id, min(doc_id) AS doc_id, min(n_chars) AS n_chars, min(lang) AS lang, {_fold(
    "true", "i % 2 = 0", "i % 2 = 1", f"CASE WHEN i % 3 <> 0 THEN n // 5 ELSE {_words('x')} END", _blank("x"),
    "CASE WHEN i % 6 < 5 THEN i % 6 END",
    "i % 3 = 0", "n % 7 IN (0, 1)", "CASE WHEN n % 6 <> 5 THEN n * 37.0 END",
    "CASE WHEN i % 2 = 1 THEN n * 37.0 + 10 WHEN n % 6 <> 5 THEN n * 37.0 END", "n", "CASE WHEN n % 5 <> 0 THEN n // 3 END",
    "i % 5 = 1", "n % 7 IN (0, 1)", "CASE WHEN n % 8 <> 3 THEN n * 53.0 END",
    "CASE WHEN n % 10 <> 9 THEN (doc_id * 1000 + i * i) * 1000000 END",
    "n % 9 IN (0, 2)", "n % 9 = 1", "i % 4 = 2",
    "(i % 3 = 0 AND (n % 11 = 0 OR n % 13 = 0)) OR (i % 5 = 1 AND (n % 17 = 0 OR n % 19 = 0))")},
  sum(CASE WHEN i % 3 <> 0 THEN n // 5 ELSE 0 END) AS spoken,
  count(*) FILTER (WHERE i % 3 = 0 AND n % 7 < 4) + count(*) FILTER (WHERE i % 5 = 1 AND n % 7 < 4) AS not_success,
  count(*) FILTER (WHERE i % 3 = 0 AND n % 7 < 3) + count(*) FILTER (WHERE i % 5 = 1 AND n % 7 < 3) AS not_ok,
  count(*) FILTER (WHERE n % 9 = 0) AS injected, count(*) FILTER (WHERE n % 10 <> 9) AS stamps
  FROM ln GROUP BY session_id),
sig AS (SELECT session_id, doc_id, {_SIGNAL_COLUMNS} FROM fold),
doc AS (SELECT f.*, s.interview_duration_seconds, s.average_llm_latency_ms, CASE WHEN n_chars % 3 = 0 THEN 'failed' ELSE 'passed' END AS status,
  CASE f.doc_id % 5 WHEN 0 THEN 'llm_timeout' WHEN 1 THEN 'tool_timeout' WHEN 2 THEN lang END AS scenario
  FROM fold f JOIN sig s USING (session_id))"""

# --- flat rows -------------------------------------------------------------------------------

_FLAT_CTE = """
flat AS (SELECT CAST(o_orderkey AS VARCHAR) AS session_id,
  CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 THEN CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS DOUBLE) END AS interview_duration_seconds,
  CAST(NULL AS DOUBLE) AS transcript_turn_count, CAST(o_custkey AS DOUBLE) AS total_llm_calls,
  CASE WHEN o_custkey % 3 <> 0 THEN CAST(o_custkey % 100 AS DOUBLE) END AS total_tool_calls,
  CASE WHEN o_orderkey % 5 <> 0 THEN CAST(12.5 AS DOUBLE) END AS average_llm_latency_ms,
  CAST(NULL AS DOUBLE) AS total_tokens, CAST(NULL AS DOUBLE) AS failed_llm_calls,
  CASE o_orderstatus WHEN 'F' THEN 'timeout' WHEN 'O' THEN NULL ELSE 'unknown' END AS root_cause,
  o_orderstatus AS affected_component, o_orderpriority AS failure_category, 'csv' AS source_format FROM orders)"""
_PRESENT = [n for n in FEATURES if n in CSV_SIGNALS]
_GAPS = " UNION ALL ".join(
    f"SELECT {p} AS position, '{n}' AS feature, " + (f"count(*) - count({n})" if n in _PRESENT else "count(*)") + " AS missing FROM flat"
    for p, n in enumerate(FEATURES))

# --- drift -------------------------------------------------------------------------------------


def _drift(cells: str, names: tuple[str, ...]) -> str:
    """Histogram drift from ``cells`` (pos, name, side, v)."""
    nums = ", ".join(f"({i})" for i in range(10))
    return f""",
cells AS ({cells}),
rng AS (SELECT name, min(pos) AS position, min(v) AS lo, max(v) AS hi, count(*) FILTER (WHERE side = 0) AS n0,
  count(*) FILTER (WHERE side = 1) AS n1 FROM cells GROUP BY name),
bins AS (SELECT * FROM (VALUES {nums}) AS t(b)),
hist AS (SELECT r.name, b.b, count(*) FILTER (WHERE c.side = 0) + 1e-12 AS c0, count(*) FILTER (WHERE c.side = 1) + 1e-12 AS c1
  FROM rng r CROSS JOIN bins b LEFT JOIN cells c ON c.name = r.name
   AND (b.b = 0 OR c.v >= b.b * ((r.hi - r.lo) / 10) + r.lo)
   AND (b.b = 9 OR c.v < (b.b + 1) * ((r.hi - r.lo) / 10) + r.lo) GROUP BY r.name, b.b),
shr AS (SELECT name, c0 / sum(c0) OVER (PARTITION BY name) AS p, c1 / sum(c1) OVER (PARTITION BY name) AS q FROM hist),
raw_drift AS (SELECT name, 0.5 * (sum(p * ln(p / ((p + q) / 2))) + sum(q * ln(q / ((p + q) / 2)))) AS js,
  sum((q - p) * ln(q / p)) AS psi FROM shr GROUP BY name),
drift AS (SELECT CAST(r.position AS BIGINT) AS position, r.name AS feature_name, CASE WHEN lo = hi THEN 0.0 ELSE js END AS js, CASE WHEN lo = hi THEN 0.0 ELSE psi END AS psi,
  lo < hi AND js >= 0.1 AS shifted, (n0 > 0) = (n1 > 0) AS comparable FROM rng r JOIN raw_drift USING (name))"""


_SIGNAL_CELLS = " UNION ALL ".join(
    f"SELECT {p} AS pos, '{n}' AS name, CASE WHEN baseline THEN 0 ELSE 1 END AS side, {n} AS v FROM sig" for p, n in enumerate(FEATURES))
_EVENT_DRIFT = _EVENT_CTE + _drift(_SIGNAL_CELLS, FEATURES)

_LABELS = _EVENT_CTE + """,
cells AS (SELECT 'root_cause' AS g, root_cause AS label, baseline FROM sig UNION ALL
  SELECT 'failure_category', failure_category, baseline FROM sig UNION ALL SELECT 'affected_component', affected_component, baseline FROM sig),
cnt AS (SELECT g AS label_group, coalesce(label, 'unlabeled') AS label, count(*) FILTER (WHERE baseline) AS n0, count(*) FILTER (WHERE NOT baseline) AS n1
  FROM cells GROUP BY 1, 2),
tot AS (SELECT count(*) FILTER (WHERE baseline) AS t0, count(*) FILTER (WHERE NOT baseline) AS t1 FROM sig)
SELECT label_group, label, round(100.0 * n0 / t0, 6) AS baseline_percentage, round(100.0 * n1 / t1, 6) AS current_percentage,
  round(100.0 * n1 / t1 - 100.0 * n0 / t0, 6) AS percentage_change,
  CASE WHEN abs(100.0 * n1 / t1 - 100.0 * n0 / t0) < 2 THEN 'low' WHEN abs(100.0 * n1 / t1 - 100.0 * n0 / t0) < 5 THEN 'medium' ELSE 'high' END AS band
FROM cnt, tot"""

# --- evaluation ----------------------------------------------------------------------------------

_PREDICTIONS = _DIAGNOSIS + """
, base AS (SELECT d.session_id, s.root_cause AS actual, d.root_cause AS cause, s.failed_tool_calls AS f, s.user_id AS u FROM dg d JOIN sig s USING (session_id)),
pred AS (SELECT 'rules' AS model_name, actual, cause AS predicted FROM base UNION ALL SELECT 'constant', actual, 'timeout' FROM base UNION ALL
  SELECT 'mixed', actual, CASE WHEN f > 0 THEN actual WHEN u % 7 = 0 THEN 'hallucination' ELSE cause END FROM base)"""

_MATRIX = """
, lab AS (SELECT actual AS label FROM pred UNION SELECT predicted FROM pred),
cm AS (SELECT m.model_name, a.label AS actual, p.label AS predicted, count(x.actual) AS n
  FROM (SELECT DISTINCT model_name FROM pred) m CROSS JOIN lab a CROSS JOIN lab p
  LEFT JOIN pred x ON x.model_name = m.model_name AND x.actual = a.label AND x.predicted = p.label GROUP BY 1, 2, 3),
cls AS (SELECT model_name, label, CAST(sum(CASE WHEN actual = label THEN n ELSE 0 END) AS BIGINT) AS support,
  CAST(sum(CASE WHEN predicted = label THEN n ELSE 0 END) AS BIGINT) AS predicted_count,
  CAST(sum(CASE WHEN actual = label AND predicted = label THEN n ELSE 0 END) AS BIGINT) AS hits
  FROM cm JOIN lab ON actual = label OR predicted = label GROUP BY 1, 2),
rep AS (SELECT *, CASE WHEN predicted_count > 0 THEN hits / predicted_count ELSE 0.0 END AS precision,
  CASE WHEN support > 0 THEN hits / support ELSE 0.0 END AS recall FROM cls),
rpt AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1_score FROM rep),
met AS (SELECT model_name, sum(hits) / sum(support) AS accuracy, sum(precision * support) / sum(support) AS precision,
  sum(recall * support) / sum(support) AS recall, sum(f1_score * support) / sum(support) AS f1_score,
  avg(f1_score) FILTER (WHERE support + predicted_count > 0) AS macro_f1, sum(f1_score * support) / sum(support) AS weighted_f1,
  sum(hits) / sum(support) AS micro_f1, CAST(sum(support) AS BIGINT) AS test_size FROM rpt GROUP BY 1)"""
_METRIC_COLUMNS = ", ".join(f"round({m}, 6) AS {m}" for m in (
    "accuracy", "precision", "recall", "f1_score", "macro_f1", "weighted_f1", "micro_f1"))
_EVAL = _PREDICTIONS + _MATRIX

# --- importance ------------------------------------------------------------------------------------

_SCORES = _EVENT_CTE + ",\nsc AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS feature_name, round(avg({n}), 2) AS importance_score FROM sig" for n in FEATURES) + """),
rnk AS (SELECT *, importance_score / sum(importance_score) OVER () AS normalized_score,
  row_number() OVER (ORDER BY importance_score DESC, feature_name) AS rank FROM sc)"""

# --- clusters ---------------------------------------------------------------------------------------


def _dbscan(points: str, eps: float, least: int) -> str:
    """Brute-force DBSCAN; ``points`` gives (id, v double[])."""
    return f""",
pts AS ({points}),
nb AS (SELECT a.id AS a, b.id AS b FROM pts a, pts b WHERE list_distance(a.v, b.v) <= {eps}),
cor AS (SELECT a AS id FROM nb GROUP BY a HAVING count(*) >= {least}),
lnk AS (SELECT a, b FROM nb SEMI JOIN cor c ON nb.a = c.id SEMI JOIN cor d ON nb.b = d.id),
rea AS (SELECT id, id AS r FROM cor UNION SELECT l.b, rea.r FROM rea JOIN lnk l ON l.a = rea.id),
roo AS (SELECT id, min(r) AS root FROM rea GROUP BY id),
num AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS c FROM (SELECT DISTINCT root FROM roo)),
cid AS (SELECT id, c FROM roo JOIN num USING (root)),
brd AS (SELECT nb.a AS id, min(cid.c) AS c FROM nb JOIN cid ON nb.b = cid.id WHERE nb.a NOT IN (SELECT id FROM cor) GROUP BY 1),
clu AS (SELECT p.id, coalesce(cid.c, brd.c, -1) AS cluster_id FROM pts p LEFT JOIN cid USING (id) LEFT JOIN brd ON brd.id = p.id)"""


_SCALED = ", ".join(
    f"CASE WHEN stddev_pop({n}) OVER () = 0 THEN 0.0 ELSE ({n} - avg({n}) OVER ()) / stddev_pop({n}) OVER () END AS {n}" for n in FEATURES)
_SCALED_CTE = _EVENT_CTE + f",\nscl AS (SELECT session_id, {_SCALED} FROM sig)"
_SESSION_POINTS = f"SELECT session_id AS id, [{_ALL}] AS v FROM scl"


def _session_clusters(eps: float) -> str:
    return _SCALED_CTE + _dbscan(_SESSION_POINTS, eps, 5)


_UNKNOWN = _session_clusters(2.5) + """,
siz AS (SELECT cluster_id, count(*) AS n FROM clu GROUP BY 1),
lim AS (SELECT quantile_cont(interview_duration_seconds, 0.9) AS q FROM sig),
rec AS (SELECT s.session_id, s.interview_duration_seconds AS anomaly_score, s.interview_duration_seconds > q AS is_anomaly, c.cluster_id,
  c.cluster_id = -1 AS is_noise, s.interview_duration_seconds > q OR c.cluster_id = -1 OR z.n <= 1 AS is_unknown_failure
  FROM sig s JOIN clu c ON c.id = s.session_id JOIN siz z USING (cluster_id), lim)"""

_CONV_CTE = f"""
c AS (SELECT 'conv-' || conv_id AS session_id, role, text FROM conversations),
f AS (SELECT session_id, count(*) AS turn, count(*) FILTER (WHERE role = 'assistant') AS turn_i, count(*) FILTER (WHERE role = 'user') AS turn_c,
  coalesce(sum({_words('text')}) FILTER (WHERE role = 'assistant'), 0) AS len_i, coalesce(sum({_words('text')}) FILTER (WHERE role = 'user'), 0) AS len_c,
  count(*) FILTER (WHERE {_blank('text')}) AS blank, count(*) FILTER (WHERE role = 'user' AND {_blank('text')}) AS blank_c FROM c GROUP BY 1)"""
_CONV_SIGNALS = (*FEATURES[1:4], *FEATURES[22:26], "empty_transcript")

_CHECK_CTE = """
e AS (SELECT event_id, event_type, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k FROM events),
m AS (
  SELECT event_id, 'Invalid JSON or field type' AS message FROM e WHERE k % 23 = 0 UNION ALL
  SELECT event_id, 'session_id: not a UUID' FROM e WHERE k % 23 <> 0 AND k % 9 = 0 UNION ALL
  SELECT event_id, 'status: field required' FROM e WHERE k % 23 <> 0 AND k % 7 = 0 UNION ALL
  SELECT event_id, 'status: unknown value' FROM e WHERE k % 23 <> 0 AND k % 7 <> 0 AND k % 5 = 0 UNION ALL
  SELECT event_id, 'list fields must not be null' FROM e WHERE k % 23 <> 0 AND k % 13 = 0 UNION ALL
  SELECT event_id, 'transcript.speaker: unknown value' FROM e WHERE k % 23 <> 0 AND k % 13 <> 0 AND k % 11 = 0 UNION ALL
  SELECT event_id, 'transcript.text: field required' FROM e WHERE k % 23 <> 0 AND k % 13 <> 0 AND k % 17 = 0 UNION ALL
  SELECT event_id, 'extracted_signals.confidence: must be between 0 and 1' FROM e WHERE k % 23 <> 0 AND k % 19 = 0)"""

_FLAT_OUT = """session_id, interview_duration_seconds, transcript_turn_count, total_llm_calls, total_tool_calls,
  average_llm_latency_ms, total_tokens, failed_llm_calls, root_cause, affected_component, failure_category, source_format"""


def _w(ctes: str, select: str) -> str:
    recursive = "RECURSIVE " if "rea AS (" in ctes else ""
    return f"WITH {recursive}{ctes.strip()}\n{select}"


def _stored(name: str) -> str:
    if name == "total_tokens":
        return "CASE WHEN doc_id % 3 = 0 THEN CAST(n_chars AS DOUBLE) ELSE total_tokens END AS total_tokens"
    if name == "total_events":
        return "CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id AS DOUBLE) ELSE total_events END AS total_events"
    return f"CASE WHEN doc_id % 3 = 0 THEN NULL ELSE {name} END AS {name}"


_STAGE_NAME = "CASE i % 6 WHEN 0 THEN 'introduction' WHEN 1 THEN 'technical' WHEN 2 THEN 'coding' WHEN 3 THEN 'behavioral' WHEN 4 THEN 'evaluation' END"
_SIM_OUT = "SELECT session_id, rank, match_session_id, round(similarity_score, 6) AS similarity_score, failure_type, summary FROM sim"
_TITLE = "CASE {0} WHEN 'timeout' THEN 'Timeout' WHEN 'tool_failure' THEN 'Tool Failure' WHEN 'prompt_issue' THEN 'Prompt Issue' ELSE 'Unknown' END"

ORACLE: dict[str, str] = {
    "signals_long": _w(_EVENT_CTE, f"SELECT session_id, {_ALL} FROM sig"),
    "signals_from_tables": _w(_EVENT_CTE, f"SELECT session_id, {_ALL} FROM sig"),
    "signals_nested": _w(_DOC_CTE, f"SELECT session_id, {_ALL} FROM sig"),
    "signals_stored": _w(_DOC_CTE, f"""SELECT session_id, {", ".join(_stored(n) for n in FEATURES)},
  CASE doc_id % 4 WHEN 0 THEN 'timeout' WHEN 1 THEN 'tool_failure' END AS root_cause, CASE WHEN doc_id % 3 = 0 THEN 'data' END AS affected_component,
  CASE doc_id % 5 WHEN 0 THEN 'llm_timeout' WHEN 1 THEN 'tool_timeout' WHEN 2 THEN lang END AS failure_category, 'jsonl' AS source_format
  FROM (SELECT s.*, f.n_chars, f.lang FROM sig s JOIN fold f USING (session_id))"""),
    "signals_conversations": _w(_CONV_CTE, f"SELECT session_id, {', '.join(f'CAST({_FINAL[n]} AS DOUBLE) AS {n}' for n in _CONV_SIGNALS)} FROM f"),
    "signal_rows": _w(_EVENT_CTE, " UNION ALL ".join(
        f"SELECT session_id, '{n}' AS signal_name, {n} AS value, '{u}' AS unit, '{s}' AS source, CAST(1.0 AS DOUBLE) AS confidence FROM sig" for n, u, s in SIGNALS)),
    "signals_pivoted": _w(_EVENT_CTE, f"SELECT session_id, {', '.join(f'nullif({n}, 0) AS {n}' for n in FEATURES)} FROM sig"),
    "rule_results": _w(_RULE_CTE, "SELECT session_id, rule_id, rule_name, score > 0 AS triggered, score, reason FROM rul"),
    "evidence_records": _w(_RULE_CTE, """SELECT session_id, 'evidence_' || rule_id AS evidence_id, rule_name AS description, 'extracted_signal' AS source_type,
  metric AS source_id, metric, observed AS observed_value, expected AS expected_value, severity, score AS confidence, explanation,
  metric AS signal_name, observed AS signal_value, rule_id FROM hit"""),
    "similar_sessions": _w(_EVENT_CTE + _similar(5), _SIM_OUT),
    "similar_sessions_tiled": _w(_EVENT_CTE + _similar(5), _SIM_OUT),
    "similar_embeddings": """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT *, sqrt(list_inner_product(v, v)) AS n FROM e),
p AS (SELECT q.vec_id, CAST(h.vec_id AS VARCHAR) AS match_session_id, CAST(h.label AS VARCHAR) AS failure_type,
  round(list_inner_product(q.v, h.v) / (q.n * h.n), 9) AS s FROM u q, u h),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, match_session_id) AS rank FROM p)
SELECT vec_id, rank, match_session_id, round(greatest(0.0, least(1.0, s)), 6) AS similarity_score, failure_type FROM r WHERE rank <= 4""",
    "index_statistics": _w(_EVENT_CTE, " UNION ALL ".join(
        f"SELECT '{n}' AS feature, round(avg({n}), 6) AS mean, round(CASE WHEN stddev_pop({n}) = 0 THEN 1.0 ELSE stddev_pop({n}) END, 6) AS scale FROM sig WHERE baseline"
        for n in SIMILARITY_FEATURES)),
    "confidence_scores": _w(_RULE_CTE + _CONFIDENCE + _similar(5) + """,
hs AS (SELECT session_id, max(similarity_score) AS hsim, count(failure_type) / count(*) AS agree FROM sim GROUP BY 1)""",
        """SELECT session_id, round(rule_score, 6) AS rule_score, CAST(evidence_completeness AS DOUBLE) AS evidence_completeness,
  round(evidence_severity, 6) AS evidence_severity, round(hsim, 6) AS historical_similarity, round(agree, 6) AS historical_failure_agreement,
  round(least(1.0, 0.4 * rule_score + 0.2 * evidence_completeness + 0.2 * evidence_severity + 0.1 * hsim + 0.1 * agree), 6) AS confidence
FROM cf JOIN hs USING (session_id)"""),
    "diagnosed_sessions": _w(_DIAGNOSIS, """SELECT session_id, root_cause, affected_component, severity, round(confidence, 6) AS confidence,
  ids AS rules_triggered, CASE WHEN notes = '' THEN '' ELSE notes || '|' END || 'Confidence summary: ' || confidence_text AS evidence,
  n_hits + 1 AS evidence_items, true AS no_matches FROM dg"""),
    "reasoning_prompts": _w(_DIAGNOSIS, """SELECT session_id, 'triggered_rules=[' || CASE WHEN ids = '' THEN '' ELSE '''' || replace(ids, ',', ''', ''') || '''' END
  || ']; evidence_count=' || n_hits || '; similar_session_count=0; confidence=' || printf('%.2f', confidence)
  || '; confidence_summary=' || confidence_text AS reasoning_prompt, confidence_text FROM dg"""),
    "cause_counts": _w(_DIAGNOSIS, """SELECT root_cause, affected_component, severity, count(*) AS sessions, round(avg(confidence), 6) AS mean_confidence
FROM dg GROUP BY 1, 2, 3"""),
    "session_overview": _w(_DIAGNOSIS, f"""SELECT session_id, {_TITLE.format('root_cause')} AS root_cause, affected_component,
  {_PERCENT.format('confidence')} AS confidence, upper(severity[1]) || severity[2:] AS severity, n_hits AS triggered_rules FROM dg"""),
    "stage_counts": _w(_DIAGNOSIS, f"""SELECT session_id, CAST(31 AS BIGINT) AS signals, CAST(10 AS BIGINT) AS evaluations, n_hits AS records,
  CAST(0 AS BIGINT) AS matches, {_PERCENT.format('confidence')} AS confidence FROM dg"""),
    "triggered_rules": _w(_RULE_CTE, "SELECT session_id, rule_name AS rule, true AS triggered, score, reason FROM hit"),
    "match_listing": _w(_EVENT_CTE + _similar(2), f"""SELECT session_id, rank, match_session_id, {_PERCENT.format('similarity_score')} AS similarity,
  coalesce(failure_type, 'Unknown') AS failure_type, summary FROM sim"""),
    "timeline_listing": _w(_DOC_CTE, f"""SELECT session_id, i AS pos, CASE WHEN n % 10 <> 9 THEN (doc_id * 1000 + i * i) * 1000000 END AS time,
  CASE i % 4 WHEN 0 THEN 'TURN' WHEN 1 THEN 'LLM_CALL' WHEN 2 THEN 'ERROR' ELSE 'METRIC' END AS event, {_STAGE_NAME} AS stage,
  CASE n % 9 WHEN 0 THEN 'Retry attempt 1.' WHEN 1 THEN 'Timeout reached.' WHEN 2 THEN 'will retry' END AS description,
  i + 1 AS turn, CASE WHEN i % 3 = 0 THEN 'c' || i END AS call FROM ln"""),
    "flat_features": _w(_FLAT_CTE, f"SELECT {_FLAT_OUT} FROM flat"),
    "dataset_statistics": _w(_FLAT_CTE + f",\ng AS ({_GAPS})", """SELECT row_count, CAST(31 AS BIGINT) AS feature_count, failure_categories, missing_values,
  'CSV dataset with ' || row_count || ' sessions, 31 stable features, and ' || missing_values || ' missing values.' AS summary
FROM (SELECT count(*) AS row_count, count(DISTINCT failure_category) AS failure_categories FROM flat), (SELECT CAST(sum(missing) AS BIGINT) AS missing_values FROM g)"""),
    "class_balance": _w(_FLAT_CTE, "SELECT coalesce(root_cause, 'unlabeled') AS label, count(*) AS sessions FROM flat GROUP BY 1"),
    "missing_by_feature": _w(_FLAT_CTE, f"SELECT CAST(position AS BIGINT) AS position, feature, missing FROM ({_GAPS})"),
    "most_missing": _w(_FLAT_CTE, f"SELECT CAST(position AS BIGINT) AS position, feature, missing FROM ({_GAPS}) ORDER BY missing DESC, position LIMIT 15"),
    "dataset_card": _w(_EVENT_CTE, """SELECT count(*) AS sessions, CAST(31 AS BIGINT) AS features, count(DISTINCT failure_category) AS failure_categories,
  CAST(0 AS BIGINT) AS missing_values, 'JSONL dataset with ' || count(*) || ' sessions, 31 stable features, and 0 missing values.' AS summary, 'Unavailable' AS split FROM sig"""),
    "flat_rows": _w(_DOC_CTE, """SELECT session_id, status, 'cand-' || (doc_id % 7) AS candidate_id, lang AS candidate_name, (doc_id % 9) / 2.0 AS experience_years,
  (SELECT any_value(source) FROM ln WHERE ln.session_id = doc.session_id) AS interview_role, 'introduction;' || lang AS stages,
  interview_duration_seconds AS duration_seconds, turn AS num_turns, llm AS num_llm_calls, tool AS num_tool_calls, n_chars % 4 AS num_errors,
  n_chars / 8.0 AS avg_llm_latency_ms, n_chars AS total_tokens, scenario AS ground_truth_scenario,
  CASE doc_id % 4 WHEN 0 THEN 'timeout' WHEN 1 THEN 'tool_failure' END AS ground_truth_failure_type,
  CASE WHEN doc_id % 3 = 0 THEN 'data' END AS ground_truth_component, 'medium' AS ground_truth_severity, '1.0' AS schema_version,
  CASE WHEN doc_id % 2 = 0 THEN 'v1' END AS dataset_version, 'p1' AS pipeline_version FROM doc"""),
    "derived_metrics": _w(_DOC_CTE, f"""SELECT session_id, turn AS num_turns, {_r2('CAST(spoken AS DOUBLE) / turn')} AS avg_turn_length, average_llm_latency_ms AS avg_llm_latency_ms,
  CAST(spoken + tok_in + tok_out AS BIGINT) AS total_tokens, not_success + CASE WHEN status = 'failed' AND not_success = 0 THEN 1 ELSE 0 END AS num_errors FROM doc"""),
    "injected_retries": _w(_DOC_CTE, "SELECT session_id, injected AS injected_retries FROM doc"),
    "collection_totals": _w(_DOC_CTE, f"""SELECT total_sessions, success_count, {_r2('d')} AS average_duration_seconds, {_r2('l')} AS average_llm_latency_ms FROM (
  SELECT count(*) AS total_sessions, count(*) FILTER (WHERE status = 'passed') AS success_count,
  coalesce(avg(interview_duration_seconds) FILTER (WHERE stamps > 1), 0.0) AS d, coalesce(sum(lat_sum) / sum(lat_n), 0.0) AS l FROM doc)"""),
    "collection_failures": _w(_DOC_CTE, "SELECT scenario, count(*) AS sessions FROM doc WHERE status = 'failed' GROUP BY 1"),
    "representatives": _w(_DOC_CTE, """SELECT * FROM (
  SELECT 'healthy_session' AS example, min_by(session_id, doc_id) AS session_id FROM doc WHERE status = 'passed' UNION ALL
  SELECT 'llm_timeout', min_by(session_id, doc_id) FROM doc WHERE scenario = 'llm_timeout' UNION ALL
  SELECT 'tool_timeout', min_by(session_id, doc_id) FROM doc WHERE scenario = 'tool_timeout' UNION ALL
  SELECT 'mixed_failure', min_by(session_id, doc_id) FROM doc WHERE not_ok >= 2) WHERE session_id IS NOT NULL"""),
    "token_estimates": f"SELECT doc_id, greatest(1, CAST(round_even({_words('text')} * CAST(1.3 AS DOUBLE), 0) AS BIGINT)) AS tokens FROM documents",
    "validation_issues": _w(_CHECK_CTE, """SELECT e.event_id, coalesce(string_agg(m.message, '; ' ORDER BY m.message), 'valid') AS issues
FROM e LEFT JOIN m USING (event_id) GROUP BY 1"""),
    "validation_counts": _w(_CHECK_CTE, "SELECT message, count(*) AS rows FROM m GROUP BY 1"),
    "feature_drift": _w(_EVENT_DRIFT, """SELECT position, feature_name, round(js, 6) AS jensen_shannon_divergence, round(psi, 6) AS population_stability_index, shifted, comparable,
  CASE WHEN js < 0.1 THEN 'low' WHEN js < 0.3 THEN 'medium' ELSE 'high' END AS band FROM drift"""),
    "embedding_drift": _w("one AS (SELECT 1 AS x)" + _drift(
        "SELECT i - 1 AS pos, 'd' || lpad(CAST(i - 1 AS VARCHAR), 2, '0') AS name, CASE WHEN label < 3 THEN 0 ELSE 1 END AS side, CAST(embedding[i] AS DOUBLE) AS v"
        " FROM embeddings, (SELECT unnest(range(1, 65)) AS i)", ()),
        "SELECT position, feature_name, round(js, 6) AS jensen_shannon_divergence, round(psi, 6) AS population_stability_index, shifted, comparable FROM drift"),
    "label_drift": "WITH " + _LABELS.strip(),
    "drift_summary": _w(_EVENT_DRIFT, """SELECT count(*) FILTER (WHERE shifted) AS shifted_feature_count, round(max(js), 6) AS largest_drift,
  round(avg(js), 6) AS average_drift, round(avg(js), 6) AS overall_drift_score FROM drift"""),
    "largest_shift": _w(_EVENT_DRIFT, """SELECT coalesce((SELECT feature_name || ' (' || printf('%.2f', js) || ')' FROM drift WHERE shifted
  ORDER BY js DESC, position LIMIT 1), 'None') AS largest_shifted_feature"""),
    "confusion_matrix": _w(_EVAL, "SELECT model_name, actual, predicted, n FROM cm"),
    "class_report": _w(_EVAL, """SELECT model_name, label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score,
  support, predicted_count, hits FROM rpt"""),
    "report_averages": _w(_EVAL, """SELECT model_name, 'accuracy' AS label, round(sum(hits) / sum(support), 6) AS precision, round(sum(hits) / sum(support), 6) AS recall,
  round(sum(hits) / sum(support), 6) AS f1_score, CAST(sum(support) AS BIGINT) AS support FROM rpt GROUP BY 1 UNION ALL
SELECT model_name, 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1_score), 6), CAST(sum(support) AS BIGINT) FROM rpt GROUP BY 1 UNION ALL
SELECT model_name, 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
  round(sum(f1_score * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM rpt GROUP BY 1"""),
    "model_metrics": _w(_EVAL, f"SELECT model_name, {_METRIC_COLUMNS}, test_size, row_number() OVER (ORDER BY macro_f1 DESC, model_name) AS rank FROM met"),
    "confusion_observations": _w(_EVAL + """,
rec AS (SELECT model_name, actual, CASE WHEN sum(n) > 0 THEN sum(CASE WHEN actual = predicted THEN n ELSE 0 END) / sum(n) ELSE 0.0 END AS r FROM cm GROUP BY 1, 2),
mx AS (SELECT * FROM cm WHERE actual <> predicted QUALIFY row_number() OVER (PARTITION BY model_name ORDER BY n DESC, actual, predicted) = 1),
bs AS (SELECT * FROM rec QUALIFY row_number() OVER (PARTITION BY model_name ORDER BY r DESC, actual) = 1),
ws AS (SELECT * FROM rec QUALIFY row_number() OVER (PARTITION BY model_name ORDER BY r, actual) = 1)""",
        f"""SELECT mx.model_name,
  CASE WHEN n > 0 THEN 'Most confused classes: ' || mx.actual || ' predicted as ' || predicted || ' (' || n || ' sessions).'
    ELSE 'No cross-class confusions were observed in this holdout.' END AS most_confused,
  'Best classified class: ' || bs.actual || ' (' || {_PERCENT.format('bs.r')} || ' recall).' AS best_class,
  'Lowest recall class: ' || ws.actual || ' (' || {_PERCENT.format('ws.r')} || ' recall).' AS worst_class,
  CASE WHEN n > 0 THEN 'The classifier most frequently confuses ' || mx.actual || ' with ' || predicted || ' (' || n
    || ' sessions), indicating overlapping telemetry features in the evaluated holdout.'
    ELSE 'No class confusions were observed in this evaluation holdout.' END AS interpretation
FROM mx JOIN bs USING (model_name) JOIN ws USING (model_name)"""),
    "document_quality_metrics": _w("""
pred AS (SELECT lang AS model_name, CAST(quality AS VARCHAR) AS actual, CAST(CAST(n_chars > 800 AS INTEGER) AS VARCHAR) AS predicted
  FROM documents JOIN labels USING (doc_id))""" + _MATRIX, f"SELECT model_name, {_METRIC_COLUMNS}, test_size FROM met"),
    "holdout_sizes": _w(_EVENT_CTE + """,
c AS (SELECT failure_category, count(*) AS n FROM sig GROUP BY 1),
t AS (SELECT sum(n) AS total, sum(n) - ceil(0.25 * sum(n)) AS train FROM c),
q AS (SELECT failure_category, n, train, floor(train * n / total) AS whole, train * n / total - floor(train * n / total) AS part FROM c, t),
r AS (SELECT *, row_number() OVER (ORDER BY part DESC, failure_category) AS pos, sum(whole) OVER () AS given FROM q)""",
        """SELECT failure_category, CAST(n - whole - CASE WHEN pos <= train - given THEN 1 ELSE 0 END AS BIGINT) AS test_rows, n AS n_rows FROM r"""),
    "feature_preparation": _w(_FLAT_CTE, " UNION ALL ".join(
        f"SELECT '{n}' AS feature, round(any_value(med), 6) AS fill, round(avg(coalesce({n}, med)), 6) AS mean,"
        f" round(CASE WHEN stddev_pop(coalesce({n}, med)) = 0 THEN 1.0 ELSE stddev_pop(coalesce({n}, med)) END, 6) AS scale"
        f" FROM flat, (SELECT median({n}) AS med FROM flat)"
        for n in ("interview_duration_seconds", "total_llm_calls", "average_llm_latency_ms", "total_tool_calls"))),
    "scaled_features": _w(_SCALED_CTE, f"SELECT session_id, {', '.join(f'round({n}, 6) AS {n}' for n in FEATURES)} FROM scl"),
    "importance_ranking": _w(_SCORES, "SELECT feature_name, round(importance_score, 6) AS importance_score, round(normalized_score, 6) AS normalized_score, rank FROM rnk"),
    "importance_summary": _w(_SCORES, """SELECT round(avg(importance_score), 6) AS mean_importance, round(median(importance_score), 6) AS median_importance,
  round(stddev_pop(importance_score), 6) AS standard_deviation,
  (SELECT string_agg(feature_name, ',' ORDER BY importance_score DESC, feature_name) FROM rnk WHERE rank <= 10) AS top_features,
  (SELECT string_agg(feature_name, ',' ORDER BY importance_score, feature_name) FROM (SELECT * FROM sc ORDER BY importance_score, feature_name LIMIT 10)) AS bottom_features
FROM rnk"""),
    "importance_table": _w(_SCORES, """SELECT rank <= 5 AS top_5, rank <= 3 AS top_3, rank, feature_name, round(importance_score, 3) AS raw_importance,
  round(normalized_score, 3) AS normalized_importance, round(normalized_score * 100, 1) AS contribution FROM rnk WHERE rank <= 15 AND feature_name LIKE '%latency%'"""),
    "leading_drivers": _w(_SCORES, "SELECT string_agg(feature_name, ',' ORDER BY rank) AS drivers, round(sum(normalized_score), 6) AS share FROM rnk WHERE rank <= 3"),
    "dbscan_sessions": _w(_session_clusters(2.5), "SELECT id AS session_id, cluster_id FROM clu"),
    "dbscan_defaults": _w(_session_clusters(0.8), "SELECT id AS session_id, cluster_id FROM clu"),
    "dbscan_embeddings": _w("one AS (SELECT 1 AS x)" + _dbscan(
        "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings", 1.15, 4), "SELECT id AS vec_id, cluster_id FROM clu"),
    "cluster_statistics": _w(_session_clusters(2.5), "SELECT cluster_id, count(*) AS session_count, cluster_id = -1 AS is_noise FROM clu GROUP BY 1"),
    "unknown_failures": _w(_UNKNOWN, "SELECT session_id, anomaly_score, is_anomaly, cluster_id, is_noise, is_unknown_failure FROM rec"),
    "anomaly_totals": _w(_UNKNOWN, """SELECT count(*) FILTER (WHERE is_anomaly) AS anomaly_count, count(*) FILTER (WHERE is_noise) AS noise_point_count,
  count(*) FILTER (WHERE is_unknown_failure) AS unknown_failure_count, count(DISTINCT CASE WHEN NOT is_noise THEN cluster_id END) AS cluster_count FROM rec"""),
}

_FLAT_SOURCE = {"interview_duration_seconds": "duration_seconds", "transcript_turn_count": "num_turns", "total_llm_calls": "num_llm_calls",
                "total_tool_calls": "num_tool_calls", "average_llm_latency_ms": "avg_llm_latency_ms", "total_tokens": "total_tokens"}

# Written and read again, stored and listed: the rows are those of the tables they came from.
ORACLE |= {
    "sessions_round_trip": ORACLE["signals_stored"],
    "flat_round_trip": f"""SELECT session_id, {", ".join(f"CAST({_FLAT_SOURCE.get(n, 'NULL')} AS DOUBLE) AS {n}" for n in FEATURES)},
  ground_truth_failure_type AS root_cause, ground_truth_component AS affected_component, ground_truth_scenario AS failure_category, 'csv' AS source_format
  FROM ({ORACLE["flat_rows"]})""",
    "rejected_lines": _w(_CHECK_CTE, """SELECT message, count(*) AS rows FROM m GROUP BY 1 UNION ALL
SELECT 'valid', count(*) FROM e WHERE event_id NOT IN (SELECT event_id FROM m)"""),
    "stored_importance": ORACLE["importance_ranking"],
    "model_comparison": _w(_EVAL, f"""SELECT model_name, {", ".join(f"round({m}, 6) AS {m}" for m in (
        "accuracy", "precision", "recall", "macro_f1", "weighted_f1", "micro_f1"))} FROM met"""),
    "model_names": _w(_EVAL, "SELECT DISTINCT model_name FROM met"),
    "best_model": _w(_EVAL, f"""SELECT model_name, round(macro_f1, 6) AS macro_f1, '{",".join(FEATURES)}' AS feature_names, 'root_cause' AS label_kind
  FROM met ORDER BY macro_f1 DESC, model_name LIMIT 1"""),
    "model_matrix": _w(_EVAL, "SELECT actual, predicted, n FROM cm WHERE model_name = 'mixed'"),
}

_SCALED = ", ".join(f"({{0}}.{n} - m{i}) / s{i} AS z{i}" for i, n in enumerate(SIMILARITY_FEATURES))
ORACLE["diagnosed_documents"] = _w(_DOC_CTE + f""",
past AS (SELECT session_id, root_cause, {", ".join(f"coalesce({n}, 0.0) AS {n}" for n in SIMILARITY_FEATURES)}, CAST(substr(session_id, 5) AS BIGINT) AS doc_id FROM ({ORACLE["signals_stored"]}) p WHERE CAST(substr(session_id, 5) AS BIGINT) % 2 = 0),
rul AS ({_rule_rows()}),
hit AS (SELECT * FROM rul WHERE score > 0)""" + _CONFIDENCE + f""",
st AS (SELECT {", ".join(f"avg({n}) AS m{i}, CASE WHEN stddev_pop({n}) = 0 THEN 1.0 ELSE stddev_pop({n}) END AS s{i}" for i, n in enumerate(SIMILARITY_FEATURES))} FROM past),
qz AS (SELECT session_id, {_SCALED.format("sig")} FROM sig, st WHERE doc_id % 4 = 1),
hz AS (SELECT session_id, root_cause, doc_id, {_SCALED.format("past")} FROM past, st),
qn AS (SELECT *, sqrt({" + ".join(f"z{i} * z{i}" for i in _N)}) AS norm FROM qz),
hn AS (SELECT *, sqrt({" + ".join(f"z{i} * z{i}" for i in _N)}) AS norm FROM hz),
rk AS (SELECT q.session_id, h.session_id AS other, h.root_cause,
  CASE WHEN q.norm = 0 OR h.norm = 0 THEN 0.0 ELSE round(({" + ".join(f"q.z{i} * h.z{i}" for i in _N)}) / (q.norm * h.norm), 9) END AS s FROM qn q, hn h),
top AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY s DESC, other) AS r FROM rk QUALIFY r <= 3),
sm AS (SELECT session_id, greatest(0.0, least(1.0, max(s))) + 0.0 AS best, string_agg(other, ',' ORDER BY r) AS others,
  string_agg(coalesce(root_cause, '-'), ',' ORDER BY r) AS kinds, avg(CASE WHEN root_cause IS NULL THEN 0.0 ELSE 1.0 END) AS known FROM top GROUP BY 1)""",
    """SELECT session_id, CASE WHEN regexp_matches(ids, 'high_llm_latency|failed_llm_calls') THEN 'timeout'
       WHEN regexp_matches(ids, 'high_tool_latency|failed_tool_calls') THEN 'tool_failure'
       WHEN regexp_matches(ids, 'json_validation_errors') THEN 'prompt_issue' ELSE 'unknown' END AS root_cause,
  CASE WHEN regexp_matches(ids, 'high_llm_latency|failed_llm_calls|json_validation_errors') THEN 'model_response'
       WHEN regexp_matches(ids, 'high_tool_latency|failed_tool_calls') THEN 'pipeline'
       WHEN regexp_matches(ids, 'empty_transcript|very_low_transcript_activity') THEN 'data' ELSE 'unknown' END AS affected_component,
  CASE worst WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity,
  round(0.4 * rule_score + 0.2 * evidence_completeness + 0.2 * evidence_severity + 0.1 * best + 0.1 * known, 6) AS confidence,
  others AS similar_sessions, kinds AS failure_types, round(best, 6) AS best_score, CAST(31 AS BIGINT) AS signals FROM cf JOIN sm USING (session_id)""")
