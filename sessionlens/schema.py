"""Record shapes, value domains and fixed texts.

Everything here is a fixed value of the data contract: changing one changes
results, so they are stated plainly and in one place.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- nested session record -------------------------------------------------

SESSION_DDL = """
session_id STRING, schema_version STRING, dataset_version STRING, pipeline_version STRING,
status STRING, created_at TIMESTAMP,
candidate STRUCT<candidate_id: STRING, name: STRING, experience_years: DOUBLE, metadata: VARIANT>,
transcript ARRAY<STRUCT<turn_id: BIGINT, trace_id: STRING, stage: STRING, speaker: STRING, text: STRING,
  timestamp: TIMESTAMP, tokens: BIGINT, annotations: VARIANT>>,
llm_calls ARRAY<STRUCT<call_id: STRING, trace_id: STRING, related_turn_id: BIGINT, parent_call_id: STRING,
  model_name: STRING, prompt: STRING, response: STRING, timestamp: TIMESTAMP, latency_ms: DOUBLE,
  duration_ms: DOUBLE, status: STRING, error_type: STRING, error_message: STRING,
  tokens_input: BIGINT, tokens_output: BIGINT, metadata: VARIANT>>,
tool_calls ARRAY<STRUCT<call_id: STRING, trace_id: STRING, related_turn_id: BIGINT, parent_call_id: STRING,
  tool_name: STRING, input: VARIANT, output: VARIANT, timestamp: TIMESTAMP, duration_ms: DOUBLE,
  status: STRING, error_type: STRING, error_message: STRING, metadata: VARIANT>>,
timeline ARRAY<STRUCT<event_id: STRING, trace_id: STRING, stage: STRING, timestamp: TIMESTAMP,
  event_type: STRING, description: STRING, related_turn_id: BIGINT, related_call_id: STRING,
  related_event_id: STRING, metadata: VARIANT>>,
metrics STRUCT<num_turns: BIGINT, avg_turn_length: DOUBLE, avg_llm_latency_ms: DOUBLE, total_tokens: BIGINT,
  num_errors: BIGINT, metadata: VARIANT>,
extracted_signals ARRAY<STRUCT<signal_name: STRING, value: DOUBLE, unit: STRING, source: STRING, confidence: DOUBLE>>,
diagnosis STRUCT<root_cause: STRING, affected_component: STRING, severity: STRING, confidence: DOUBLE,
  evidence: ARRAY<STRING>,
  evidence_records: ARRAY<STRUCT<evidence_id: STRING, description: STRING, source_type: STRING, source_id: STRING,
    trace_id: STRING, excerpt: STRING, metric: STRING, observed_value: DOUBLE, expected_value: DOUBLE,
    severity: STRING, confidence: DOUBLE, explanation: STRING, signal_name: STRING, signal_value: DOUBLE,
    rule_id: STRING, metadata: VARIANT>>,
  rules_triggered: ARRAY<STRING>,
  rule_evaluations: ARRAY<STRUCT<rule_id: STRING, rule_name: STRING, triggered: BOOLEAN, score: DOUBLE, reason: STRING>>,
  similar_sessions: ARRAY<STRING>,
  similar_session_records: ARRAY<STRUCT<session_id: STRING, similarity_score: DOUBLE, failure_type: STRING, summary: STRING>>>,
ground_truth STRUCT<expected_status: STRING, expected_failure_type: STRING, expected_affected_component: STRING,
  expected_severity: STRING, scenario_id: STRING, metadata: VARIANT>,
metadata VARIANT
"""

# --- value domains ----------------------------------------------------------

SESSION_STATUS = ("passed", "failed", "inconclusive", "running")
SEVERITY = ("low", "medium", "high", "critical")  # in ascending order
COMPONENT = ("model_response", "pipeline", "data", "infrastructure", "unknown")
SPEAKER = ("candidate", "interviewer", "system", "assistant")
EVENT_TYPE = ("TURN", "LLM_CALL", "TOOL_CALL", "ERROR", "METRIC", "DIAGNOSIS")
FAILURE_TYPE = (
    "timeout", "rate_limit", "hallucination", "knowledge_gap", "prompt_issue", "tool_failure", "unknown",
)
CALL_STATUS = ("success", "ok", "error", "timeout", "rate_limited", "cancelled")
ERROR_TYPE = ("authentication", "validation", "provider", "execution", "timeout", "rate_limit", "unknown")
STAGE = ("introduction", "technical", "coding", "behavioral", "evaluation")

SUCCESS_STATUS = ("success", "ok")
SEVERITY_WEIGHT = {"low": 0.25, "medium": 0.5, "high": 0.75, "critical": 1.0}

# --- signals: (name, unit, source), in the fixed feature order ---------------

SIGNALS = (
    ("interview_duration_seconds", "seconds", "timeline"),
    ("transcript_turn_count", "turns", "transcript"),
    ("interviewer_turn_count", "turns", "transcript"),
    ("candidate_turn_count", "turns", "transcript"),
    ("interview_stage_count", "stages", "session"),
    ("total_llm_calls", "calls", "llm_calls"),
    ("failed_llm_calls", "calls", "llm_calls"),
    ("average_llm_latency_ms", "milliseconds", "llm_calls"),
    ("maximum_llm_latency_ms", "milliseconds", "llm_calls"),
    ("total_prompt_tokens", "tokens", "llm_calls"),
    ("total_completion_tokens", "tokens", "llm_calls"),
    ("total_tokens", "tokens", "llm_calls"),
    ("average_response_time", "milliseconds", "llm_calls"),
    ("total_tool_calls", "calls", "tool_calls"),
    ("failed_tool_calls", "calls", "tool_calls"),
    ("average_tool_latency", "milliseconds", "tool_calls"),
    ("maximum_tool_latency", "milliseconds", "tool_calls"),
    ("retry_count", "retries", "timeline"),
    ("total_events", "events", "timeline"),
    ("timeout_events", "events", "timeline"),
    ("retry_events", "events", "timeline"),
    ("failure_events", "events", "timeline"),
    ("average_candidate_response_length", "tokens", "transcript"),
    ("average_interviewer_question_length", "tokens", "transcript"),
    ("empty_candidate_responses", "turns", "transcript"),
    ("empty_transcript_turns", "turns", "transcript"),
    ("high_latency_detected", "boolean", "calls"),
    ("multiple_retries", "boolean", "timeline"),
    ("empty_transcript", "boolean", "transcript"),
    ("json_errors_detected", "boolean", "calls"),
    ("tool_failures_detected", "boolean", "tool_calls"),
)
FEATURES = tuple(name for name, _, _ in SIGNALS)
LABELS = ("root_cause", "affected_component", "failure_category")

# Flattened-file columns that carry a signal; every other signal is missing there.
CSV_SIGNALS = {
    "interview_duration_seconds": "duration_seconds",
    "transcript_turn_count": "num_turns",
    "total_llm_calls": "num_llm_calls",
    "total_tool_calls": "num_tool_calls",
    "average_llm_latency_ms": "avg_llm_latency_ms",
    "total_tokens": "total_tokens",
}

# Fixed order of the similarity vector.
SIMILARITY_FEATURES = (
    "average_llm_latency_ms",
    "maximum_llm_latency_ms",
    "average_tool_latency",
    "maximum_tool_latency",
    "failed_llm_calls",
    "failed_tool_calls",
    "retry_count",
    "transcript_turn_count",
    "interview_duration_seconds",
    "total_tokens",
    "high_latency_detected",
    "empty_transcript",
    "multiple_retries",
    "tool_failures_detected",
)

# --- rules ------------------------------------------------------------------


@dataclass(frozen=True)
class Thresholds:
    """Configurable rule limits (the two fixed signal limits are not among them)."""

    llm_timeout_ms: float = 5000.0
    tool_timeout_ms: float = 5000.0
    max_retries: float = 2.0
    max_total_tokens: float = 10000.0
    long_interview_seconds: float = 1800.0
    min_transcript_turns: float = 4.0


# Limits that the signals themselves use; they do not follow ``Thresholds``.
HIGH_LATENCY_MS = 5000.0
MULTIPLE_RETRIES = 2


@dataclass(frozen=True)
class Rule:
    rule_id: str
    name: str
    kind: str  # limit | count | retries | flag | minimum
    metric: str
    threshold: str | None  # field of Thresholds
    severity: str
    explanation: str
    unit: str = ""
    text_on: str = ""
    text_off: str = ""


RULES = (
    Rule("high_llm_latency", "High LLM latency", "limit", "maximum_llm_latency_ms", "llm_timeout_ms", "high",
         "Maximum LLM latency exceeded the configured threshold.", "ms"),
    Rule("high_tool_latency", "High Tool latency", "limit", "maximum_tool_latency", "tool_timeout_ms", "high",
         "Maximum tool latency exceeded the configured threshold.", "ms"),
    Rule("failed_llm_calls", "Failed LLM calls", "count", "failed_llm_calls", None, "high",
         "One or more LLM calls reported an explicit failure status."),
    Rule("failed_tool_calls", "Failed Tool calls", "count", "failed_tool_calls", None, "high",
         "One or more tool calls reported an explicit failure status."),
    Rule("multiple_retries", "Multiple retries", "retries", "retry_count", "max_retries", "medium",
         "Retry activity reached the configured retry threshold."),
    Rule("empty_transcript", "Empty transcript", "flag", "empty_transcript", None, "high",
         "The transcript is empty or contains an empty turn.",
         text_on="Transcript is empty or contains an empty turn.",
         text_off="No empty transcript content observed."),
    Rule("json_validation_errors", "JSON validation errors", "flag", "json_errors_detected", None, "medium",
         "A JSON validation error was observed in call telemetry.",
         text_on="JSON validation error was observed.",
         text_off="No JSON validation errors observed."),
    Rule("excessive_token_usage", "Excessive token usage", "limit", "total_tokens", "max_total_tokens", "medium",
         "Total LLM token usage exceeded the configured threshold.", "tokens"),
    Rule("very_low_transcript_activity", "Very low transcript activity", "minimum", "transcript_turn_count",
         "min_transcript_turns", "medium",
         "Transcript activity is below the configured minimum turn count."),
    Rule("long_interview_duration", "Long interview duration", "limit", "interview_duration_seconds",
         "long_interview_seconds", "low",
         "Interview duration exceeded the configured threshold.", "seconds"),
)
RULE_IDS = tuple(rule.rule_id for rule in RULES)

# Confidence contributors and their weights.
CONFIDENCE_WEIGHTS = {
    "rule_score": 0.4,
    "evidence_completeness": 0.2,
    "evidence_severity": 0.2,
    "historical_similarity": 0.1,
    "historical_failure_agreement": 0.1,
}

# Columns of the flattened session file, in file order.
FLAT_COLUMNS = (
    "session_id", "status", "candidate_id", "candidate_name", "experience_years", "interview_role", "stages",
    "duration_seconds", "num_turns", "num_llm_calls", "num_tool_calls", "num_errors", "avg_llm_latency_ms",
    "total_tokens", "ground_truth_scenario", "ground_truth_failure_type", "ground_truth_component",
    "ground_truth_severity", "schema_version", "dataset_version", "pipeline_version",
)
