"""Templated diagnosis per session, and the listings read off it (all narrow)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from sessionlens.functions.numbers import fixed, percent
from sessionlens.schema import SEVERITY

# Which triggered rules decide the cause and the component; the first match wins.
CAUSES = (
    (("high_llm_latency", "failed_llm_calls"), "timeout"),
    (("high_tool_latency", "failed_tool_calls"), "tool_failure"),
    (("json_validation_errors",), "prompt_issue"),
)
COMPONENTS = (
    (("high_llm_latency", "failed_llm_calls", "json_validation_errors"), "model_response"),
    (("high_tool_latency", "failed_tool_calls"), "pipeline"),
    (("empty_transcript", "very_low_transcript_activity"), "data"),
)


def _first_match(table) -> str:
    tests = " ".join(
        f"when arrays_overlap(rules_triggered, array({', '.join(repr(i) for i in ids)})) then '{result}'"
        for ids, result in table)
    return f"case {tests} else 'unknown' end"


_ORDER = "array(" + ", ".join(f"'{s}'" for s in SEVERITY) + ")"
_WORST = (f"element_at({_ORDER}, cast(greatest(1L, array_max(transform(filter(evidence, e -> e.severity is not null),"
          f" e -> array_position({_ORDER}, e.severity)))) as int))")

# Deterministic text that a model-backed diagnoser can consume.
_PROMPT = (
    "concat('triggered_rules=[', array_join(transform(rules_triggered, r -> concat('\\'', r, '\\'')), ', '),"
    " ']; evidence_count=', size(evidence), '; similar_session_count=', size(similar),"
    f" '; confidence=', {fixed('confidence')}, '; confidence_summary=', confidence_text)"
)


def template_diagnoser(frame: DataFrame) -> DataFrame:
    """Fill ``diagnosis`` from rules and evidence alone."""
    return frame.selectExpr(
        "*",
        f"named_struct('root_cause', {_first_match(CAUSES)}, 'affected_component', {_first_match(COMPONENTS)},"
        f" 'severity', {_WORST}, 'confidence', confidence,"
        " 'evidence', concat(transform(evidence, e -> coalesce(nullif(e.explanation, ''), e.description)),"
        " array(concat('Confidence summary: ', confidence_text))),"
        " 'rules_triggered', rules_triggered,"
        " 'similar_sessions', case when size(similar) > 0 then transform(similar, m -> m.session_id) end) diagnosis")


def reason(frame: DataFrame, diagnoser: Callable[[DataFrame], DataFrame] = template_diagnoser) -> DataFrame:
    """Add ``rules_triggered``, ``reasoning_prompt`` and ``diagnosis``.

    ``diagnoser`` may be any DataFrame function that adds a ``diagnosis`` column.
    """
    staged = frame.selectExpr("*", "transform(filter(rules, r -> r.triggered), r -> r.rule_id) rules_triggered")
    return diagnoser(staged.selectExpr("*", f"{_PROMPT} reasoning_prompt"))


# --- listings ---------------------------------------------------------------


def _title(text: str) -> str:
    return f"initcap(replace({text}, '_', ' '))"


def overview(diagnosed: DataFrame) -> DataFrame:
    return diagnosed.selectExpr(
        "session_id", f"{_title('diagnosis.root_cause')} root_cause",
        "diagnosis.affected_component affected_component", f"{percent('diagnosis.confidence')} confidence",
        f"{_title('diagnosis.severity')} severity", "cast(size(diagnosis.rules_triggered) as bigint) triggered_rules")


def triggered_rules(diagnosed: DataFrame) -> DataFrame:
    return diagnosed.selectExpr("session_id", "inline(filter(rules, r -> r.triggered))").selectExpr(
        "session_id", "rule_name rule", "triggered", "score", "reason")


def match_rows(diagnosed: DataFrame) -> DataFrame:
    return diagnosed.selectExpr("session_id", "posexplode(similar) as (pos, m)").selectExpr(
        "session_id", "cast(pos + 1 as bigint) rank", "m.session_id match_session_id",
        f"{percent('m.similarity_score')} similarity", "coalesce(m.failure_type, 'Unknown') failure_type",
        "m.summary summary")


def stage_counts(diagnosed: DataFrame) -> DataFrame:
    """How many rows each stage produced for each session (needs a ``signals`` list)."""
    return diagnosed.selectExpr(
        "session_id", *(f"cast(size({column}) as bigint) {name}" for column, name in (
            ("signals", "signals"), ("rules", "evaluations"), ("evidence", "records"), ("similar", "matches"))),
        f"{percent('confidence')} confidence")


def timeline_rows(sessions: DataFrame) -> DataFrame:
    """Timeline of nested sessions as rows; record order is kept in ``pos``."""
    return sessions.selectExpr("session_id", "posexplode(timeline) as (pos, e)").selectExpr(
        "session_id", "cast(pos as bigint) pos", "e.timestamp time", "e.event_type event", "e.stage stage",
        "e.description description", "e.related_turn_id turn", "e.related_call_id call")


def cause_counts(diagnosed: DataFrame) -> DataFrame:
    """How often each cause, component and severity was found."""
    d = F.col("diagnosis")
    return diagnosed.groupBy(d["root_cause"].alias("root_cause"), d["affected_component"].alias("affected_component"),
                             d["severity"].alias("severity")).agg(
        F.count("*").alias("sessions"), F.avg("confidence").alias("mean_confidence"))
