"""Sessions out of a flat event log.

A session is one user's week.  Each event is one timeline entry and, by its
type, also a transcript turn, a model call or a tool call.  All measures of an
event come from the same row, so the log is scanned once and shuffled once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sessionlens.operators.signals import (
    event_measures, llm_measures, measures, signals_long, tool_measures, turn_measures,
)

SPLIT_WEEK = "2024-01-15"  # weeks before it are the baseline


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/events.parquet")


def telemetry(events: DataFrame) -> DataFrame:
    """Telemetry fields of every event (one output row per event)."""
    return events.selectExpr(
        "event_id", "user_id", "event_type kind", "cast(ts as timestamp) ts", "round(value * 100) latency_ms",
        "cast(regexp_extract(props, r'(\\d+)', 1) as bigint) k",
        "date_trunc('week', cast(ts as timestamp)) week",
    ).selectExpr(
        "concat(user_id, '-', cast(cast(week as date) as string)) session_id",
        "user_id", "week", "event_id", "kind", "k", "latency_ms",
        "timestamp_micros(unix_micros(week) + (unix_micros(ts) - unix_micros(week)) div 300) timestamp",
        "case kind when 'error' then 'ERROR' when 'view' then 'TURN' when 'click' then 'TOOL_CALL'"
        " when 'purchase' then 'LLM_CALL' when 'signup' then 'METRIC' end entry_type",
        "case k % 5 when 0 then 'Request timeout.' when 1 then 'Retry attempt.' else kind end description",
        "case k % 6 when 0 then 'introduction' when 1 then 'technical' when 2 then 'coding'"
        " when 3 then 'behavioral' when 4 then 'evaluation' end stage",
        "case when k % 3 <> 0 then latency_ms end duration_ms",
        "k * 40 tokens_input", "k * 7 tokens_output",
        "case k % 10 when 0 then 'timeout' when 1 then 'error' when 2 then null when 3 then 'ok'"
        " else 'success' end status",
        "case when k % 8 = 4 then 'validation' end error_type",
        "case when k % 20 = 11 then 'Invalid JSON payload.' end error_message",
        "case when event_id % 2 = 0 then 'candidate' else 'interviewer' end speaker",
        "case when k % 4 <> 0 then k end tokens",
    ).selectExpr("*", "case when k % 17 = 0 then '' else description end text")


TURN_KINDS = "kind in ('view', 'signup')"


def event_measures_of(log: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return measures(
        log, turn_measures(TURN_KINDS), llm_measures("kind = 'purchase'"),
        tool_measures("kind = 'click'", duration="latency_ms"), event_measures(event_type="entry_type"), keep=keep)


def tables_of(log: DataFrame) -> dict[str, DataFrame]:
    """The same telemetry as the four long tables."""
    return {
        "turns": log.where(TURN_KINDS).selectExpr("session_id", "event_id turn_id", "speaker", "stage", "text",
                                                  "timestamp", "tokens"),
        "llm_calls": log.where("kind = 'purchase'").selectExpr(
            "session_id", "event_id call_id", "timestamp", "latency_ms", "duration_ms", "status", "error_type",
            "error_message", "tokens_input", "tokens_output"),
        "tool_calls": log.where("kind = 'click'").selectExpr(
            "session_id", "event_id call_id", "timestamp", "latency_ms duration_ms", "status", "error_type",
            "error_message"),
        "timeline": log.selectExpr("session_id", "event_id", "timestamp", "stage", "entry_type event_type",
                                   "description"),
    }


# Ground truth of event-log sessions, by user.
ROOT_CAUSE = ("case user_id % 4 when 0 then 'timeout' when 1 then 'tool_failure' when 2 then 'prompt_issue'"
              " else 'unknown' end")
COMPONENT = "case user_id % 3 when 0 then 'model_response' when 1 then 'pipeline' end"
CATEGORY = "concat('scenario_', user_id % 5)"


def event_signals(events: DataFrame) -> DataFrame:
    """Wide signals of all sessions in an event log, with labels and the baseline flag."""
    wide = signals_long(event_measures_of(telemetry(events), ("user_id", "week")),
                        {"user_id": "min(user_id)", "week": "min(week)"})
    return wide.selectExpr("*", f"{ROOT_CAUSE} root_cause", f"{COMPONENT} affected_component",
                           f"{CATEGORY} failure_category", f"week < timestamp '{SPLIT_WEEK}' baseline")
