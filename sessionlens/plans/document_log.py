"""Nested sessions out of a table of texts: every line of a document is one turn.

Calls and timeline entries are derived from the same lines, so whole texts are
processed and a session is as large as its document, with no shuffle at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


_STAGE = ("case i % 6 when 0 then 'introduction' when 1 then 'technical' when 2 then 'coding'"
          " when 3 then 'behavioral' when 4 then 'evaluation' end")
_STATUS = "case n % 7 when 0 then 'timeout' when 1 then 'error' when 2 then null when 3 then 'ok' else 'success' end"


def _with_lines(expression: str) -> str:
    """``expression`` over (x line, i position, n length), spelled with the lambda's own names."""
    import re
    swapped = re.sub(r"\bn\b", "cast(length(x) as bigint)", expression)
    return re.sub(r"\bi\b", "cast(i as bigint)", swapped)


def document_sessions(documents: DataFrame) -> DataFrame:
    calls = _with_lines(
        "named_struct('at', i, 'call_id', concat('c', i), 'latency_ms', case when n % 6 <> 5 then n * 37.0D end,"
        " 'duration_ms', case when i % 2 = 1 then n * 37.0D + 10.0D end, 'status', " + _STATUS + ","
        " 'error_type', case when n % 11 = 0 then 'validation' end,"
        " 'error_message', case when n % 13 = 0 then 'Invalid JSON payload.' end,"
        " 'tokens_input', n, 'tokens_output', case when n % 5 <> 0 then n div 3 end)")
    tools = _with_lines(
        "named_struct('at', i, 'call_id', concat('t', i), 'duration_ms', case when n % 8 <> 3 then n * 53.0D end,"
        " 'status', " + _STATUS + ", 'error_type', case when n % 17 = 0 then 'validation' end,"
        " 'error_message', case when n % 19 = 0 then 'bad json' end)")
    turns = _with_lines(
        "named_struct('turn_id', i + 1, 'speaker', case when i % 2 = 0 then 'interviewer' else 'candidate' end,"
        " 'stage', " + _STAGE + ", 'text', x, 'tokens', case when i % 3 <> 0 then n div 5 end)")
    entries = _with_lines(
        "named_struct('event_id', concat('e', i), 'timestamp',"
        " case when n % 10 <> 9 then timestamp_micros((doc_id * 1000 + i * i) * 1000000) end, 'stage', " + _STAGE + ","
        " 'event_type', case i % 4 when 0 then 'TURN' when 1 then 'LLM_CALL' when 2 then 'ERROR' else 'METRIC' end,"
        " 'description', case n % 9 when 0 then 'Retry attempt 1.' when 1 then 'Timeout reached.' when 2 then 'will retry' end,"
        " 'related_turn_id', i + 1, 'related_call_id', case when i % 3 = 0 then concat('c', i) end)")
    return documents.selectExpr("*", "split(text, '\\n') lines").selectExpr(
        "concat('doc-', doc_id) session_id", "doc_id row_id",
        "case when n_chars % 3 = 0 then 'failed' else 'passed' end status",
        f"transform(lines, (x, i) -> {turns}) transcript",
        f"filter(transform(lines, (x, i) -> {calls}), c -> c.at % 3 = 0) llm_calls",
        f"filter(transform(lines, (x, i) -> {tools}), c -> c.at % 5 = 1) tool_calls",
        f"transform(lines, (x, i) -> {entries}) timeline",
        "named_struct('expected_failure_type', case doc_id % 4 when 0 then 'timeout' when 1 then 'tool_failure' end,"
        " 'expected_affected_component', case when doc_id % 3 = 0 then 'data' end,"
        " 'expected_severity', 'medium',"
        " 'scenario_id', case doc_id % 5 when 0 then 'llm_timeout' when 1 then 'tool_timeout' when 2 then lang end) ground_truth",
        "named_struct('num_turns', cast(size(lines) as bigint), 'avg_turn_length', cast(null as double),"
        " 'avg_llm_latency_ms', n_chars / 8.0D, 'total_tokens', n_chars, 'num_errors', n_chars % 4) metrics",
        "named_struct('candidate_id', concat('cand-', doc_id % 7), 'name', lang, 'experience_years', (doc_id % 9) / 2.0D) candidate",
        "parse_json(concat('{\"interview_role\":\"', source, '\",\"stages\":[\"introduction\",\"', lang, '\"]}')) metadata",
        "'1.0' schema_version", "case when doc_id % 2 = 0 then 'v1' end dataset_version", "'p1' pipeline_version",
        "named_struct('rules_triggered', array(lang)) diagnosis",
        # every third session carries a partial list of stored signals, one of them twice
        "case when doc_id % 3 = 0 then array("
        " named_struct('signal_name', 'total_tokens', 'value', cast(n_chars as double)),"
        " named_struct('signal_name', 'total_events', 'value', 1.0D),"
        " named_struct('signal_name', 'total_events', 'value', cast(doc_id as double))) end extracted_signals",
    )
