"""The 31 per-session signals, from nested records or from long tables.

Long form: each physical row is reduced to a few numbers (*measures*) and one
``groupBy(session_id)`` adds them up.  All record kinds share that single
shuffle, every aggregate has a fixed-size buffer, and map-side combining
shrinks a session of any size to one row per input partition.

Nested form: the same definitions as array expressions, one narrow stage.

Definitions are SQL text: a wide projection then is one call to the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from sessionlens.functions.numbers import with_means
from sessionlens.functions.text import is_blank, mentions, word_count
from sessionlens.schema import FEATURES, HIGH_LATENCY_MS, MULTIPLE_RETRIES, SIGNALS, STAGE, SUCCESS_STATUS

# ---------------------------------------------------------------------------
# definitions shared by both forms

_SUCCESS = ", ".join(f"'{s}'" for s in SUCCESS_STATUS)
_STAGES = ", ".join(f"'{s}'" for s in STAGE)


def call_failed(status: str) -> str:
    return f"coalesce({status} not in ({_SUCCESS}), false)"


def json_error(error_type: str, message: str) -> str:
    return f"(coalesce({error_type} = 'validation', false) or {mentions(message, 'json')})"


def turn_length(text: str, tokens: str) -> str:
    return f"coalesce({tokens}, {word_count(text)}, 0L)"


def _flag(condition: str) -> str:
    return f"cast(coalesce({condition}, false) as double)"


# Signals that follow from other totals.
_DERIVED = {
    "total_tokens": "total_prompt_tokens + total_completion_tokens",
    "retry_events": "retry_count",
    "multiple_retries": _flag(f"retry_count >= {MULTIPLE_RETRIES}"),
    "empty_transcript": _flag("transcript_turn_count = 0 or empty_transcript_turns > 0"),
    "tool_failures_detected": _flag("failed_tool_calls > 0"),
}


def _finish(frame: DataFrame, signals: dict[str, str], keep: list[str]) -> DataFrame:
    """Project base signals, then those derived from them, in feature order."""
    base = frame.selectExpr(*keep, *(f"{sql} as {name}" for name, sql in signals.items()))
    return base.selectExpr(*keep, *(f"cast({_DERIVED.get(n, n)} as double) as {n}" for n in FEATURES))


# ---------------------------------------------------------------------------
# long form: measures


def _one(present: str, condition: str = "true") -> str:
    return f"case when {present} and {condition} then 1L end"


def _stage_bit(stage: str) -> str:
    """Stages form a fixed domain, so a set of them is a small bit mask."""
    return f"case {stage} " + " ".join(f"when '{s}' then {1 << i}L" for i, s in enumerate(STAGE)) + " end"


def turn_measures(present: str = "true", speaker: str = "speaker", stage: str = "stage", text: str = "text",
                  tokens: str = "tokens") -> dict[str, str]:
    blank = f"coalesce({is_blank(text)}, true)"
    asks, answers = f"{speaker} = 'interviewer'", f"{speaker} = 'candidate'"
    return {
        "turn": _one(present),
        "turn_interviewer": _one(present, asks),
        "turn_candidate": _one(present, answers),
        "length_interviewer": f"case when {present} and {asks} then {turn_length(text, tokens)} end",
        "length_candidate": f"case when {present} and {answers} then {turn_length(text, tokens)} end",
        "blank": _one(present, blank),
        "blank_candidate": _one(present, f"{answers} and {blank}"),
        "turn_stage": f"case when {present} then {_stage_bit(stage)} end",
    }


def llm_measures(present: str = "true", latency: str = "latency_ms", duration: str = "duration_ms",
                 status: str = "status", error_type: str = "error_type", message: str = "error_message",
                 tokens_in: str = "tokens_input", tokens_out: str = "tokens_output") -> dict[str, str]:
    return {
        "llm": _one(present),
        "llm_failed": _one(present, call_failed(status)),
        "llm_latency": f"case when {present} then {latency} end",
        "llm_response": f"case when {present} then coalesce({duration}, {latency}) end",
        "llm_in": f"case when {present} then {tokens_in} end",
        "llm_out": f"case when {present} then {tokens_out} end",
        "llm_json": _one(present, json_error(error_type, message)),
    }


def tool_measures(present: str = "true", duration: str = "duration_ms", status: str = "status",
                  error_type: str = "error_type", message: str = "error_message") -> dict[str, str]:
    return {
        "tool": _one(present),
        "tool_failed": _one(present, call_failed(status)),
        "tool_duration": f"case when {present} then {duration} end",
        "tool_json": _one(present, json_error(error_type, message)),
    }


def event_measures(present: str = "true", timestamp: str = "timestamp", stage: str = "stage",
                   event_type: str = "event_type", description: str = "description") -> dict[str, str]:
    return {
        "event": _one(present),
        "event_micros": f"case when {present} then unix_micros({timestamp}) end",
        "event_retry": _one(present, mentions(description, "retry")),
        "event_timeout": _one(present, mentions(description, "timeout")),
        "event_error": _one(present, f"{event_type} = 'ERROR'"),
        "event_stage": f"case when {present} then {_stage_bit(stage)} end",
    }


_SUMS = ("turn", "turn_interviewer", "turn_candidate", "length_interviewer", "length_candidate", "blank",
         "blank_candidate", "llm", "llm_failed", "llm_in", "llm_out", "llm_json", "tool", "tool_failed",
         "tool_json", "event", "event_retry", "event_timeout", "event_error")
MEASURES: dict[str, str] = {
    **dict.fromkeys((*_SUMS, "turn_stage", "event_stage", "event_micros"), "bigint"),
    **dict.fromkeys(("llm_latency", "llm_response", "tool_duration"), "double"),
}


def measures(frame: DataFrame, *parts: dict[str, str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Reduce rows to ``session_id`` (+ ``keep``) and the measures they carry."""
    have = {name: sql for part in parts for name, sql in part.items()}
    return frame.selectExpr("session_id", *keep, *(f"cast({have.get(name, 'null')} as {kind}) {name}"
                                                   for name, kind in MEASURES.items()))


def measures_of_tables(turns: DataFrame, llm_calls: DataFrame, tool_calls: DataFrame, timeline: DataFrame,
                       sessions: DataFrame | None = None) -> DataFrame:
    """Long tables keyed by ``session_id`` to one stream of measures.

    ``sessions`` adds ids that may have no child record at all.
    """
    frames = [measures(turns, turn_measures()), measures(llm_calls, llm_measures()),
              measures(tool_calls, tool_measures()), measures(timeline, event_measures())]
    if sessions is not None:
        frames.append(measures(sessions))
    return reduce(DataFrame.unionByName, frames)


def signals_long(frame: DataFrame, extra: dict[str, str] | None = None) -> DataFrame:
    """Measures to one wide row of signals per session: one shuffle, map-side combined.

    ``extra`` are further aggregates (SQL) to carry along, labels and the like.
    """
    more = extra or {}
    folds = [f"coalesce(sum({name}), 0L) {name}" for name in _SUMS] + [
        "count(length_interviewer) n_interviewer", "count(length_candidate) n_candidate",
        "count(llm_latency) n_latency", "sum(llm_latency) sum_latency", "max(llm_latency) max_latency",
        "count(llm_response) n_response", "sum(llm_response) sum_response",
        "count(tool_duration) n_duration", "sum(tool_duration) sum_duration", "max(tool_duration) max_duration",
        "max(event_micros) last", "min(event_micros) first",
        "bit_or(coalesce(turn_stage, 0L) | coalesce(event_stage, 0L)) stages",
    ] + [f"{sql} {name}" for name, sql in more.items()]
    folded = frame.groupBy("session_id").agg(*(F.expr(f) for f in folds))
    averaged = with_means(folded, {
        "average_llm_latency_ms": ("sum_latency", "n_latency"),
        "average_response_time": ("sum_response", "n_response"),
        "average_tool_latency": ("sum_duration", "n_duration"),
        "average_candidate_response_length": ("length_candidate", "n_candidate"),
        "average_interviewer_question_length": ("length_interviewer", "n_interviewer"),
    })
    return _finish(averaged, {
        "interview_duration_seconds": "coalesce((last - first) / 1e6D, 0.0D)",
        "transcript_turn_count": "turn",
        "interviewer_turn_count": "turn_interviewer",
        "candidate_turn_count": "turn_candidate",
        "interview_stage_count": "bit_count(stages)",
        "total_llm_calls": "llm",
        "failed_llm_calls": "llm_failed",
        "average_llm_latency_ms": "average_llm_latency_ms",
        "maximum_llm_latency_ms": "coalesce(max_latency, 0.0D)",
        "total_prompt_tokens": "llm_in",
        "total_completion_tokens": "llm_out",
        "average_response_time": "average_response_time",
        "total_tool_calls": "tool",
        "failed_tool_calls": "tool_failed",
        "average_tool_latency": "average_tool_latency",
        "maximum_tool_latency": "coalesce(max_duration, 0.0D)",
        "retry_count": "event_retry",
        "total_events": "event",
        "timeout_events": "event_timeout",
        "failure_events": "event_error",
        "average_candidate_response_length": "average_candidate_response_length",
        "average_interviewer_question_length": "average_interviewer_question_length",
        "empty_candidate_responses": "blank_candidate",
        "empty_transcript_turns": "blank",
        "high_latency_detected": _flag(f"greatest(max_latency, max_duration) >= {HIGH_LATENCY_MS}D"),
        "json_errors_detected": _flag("llm_json + tool_json > 0"),
    }, ["session_id", *more])


# ---------------------------------------------------------------------------
# nested form


def _count(array: str) -> str:
    return f"coalesce(size({array}), 0)"


def _sum(array: str, zero: str = "0.0D") -> str:
    return f"coalesce(aggregate({array}, {zero}, (a, x) -> a + x), {zero})"


def _known(array: str, what: str) -> str:
    return f"filter(transform({array}, x -> {what}), v -> v is not null)"


def signals_nested(sessions: DataFrame, reuse_stored: bool = False) -> DataFrame:
    """Add the 31 signal columns to nested session rows without a shuffle.

    With ``reuse_stored`` a non-empty ``extracted_signals`` list replaces the
    extraction, also when it is partial: signals it lacks become NULL, and of
    repeated names the last one counts.
    """
    none = "cast(array() as array<string>)"
    length = turn_length("x.text", "x.tokens")
    # arrays used more than once are staged as columns: lambdas are not de-duplicated by the optimizer
    staged = sessions.selectExpr(
        "*",
        f"{_known('llm_calls', 'x.latency_ms')} _latency",
        f"{_known('llm_calls', 'coalesce(x.duration_ms, x.latency_ms)')} _response",
        f"{_known('tool_calls', 'x.duration_ms')} _duration",
        f"{_known('timeline', 'unix_micros(x.timestamp)')} _seen",
        "transform(timeline, x -> lower(coalesce(x.description, ''))) _text",
        f"transform(filter(transcript, x -> x.speaker = 'candidate'), x -> {length}) _answers",
        f"transform(filter(transcript, x -> x.speaker = 'interviewer'), x -> {length}) _questions",
        f"array_distinct(filter(concat(coalesce(transform(transcript, x -> x.stage), {none}),"
        f" coalesce(transform(timeline, x -> x.stage), {none})), s -> s in ({_STAGES}))) _stages",
        f"transform(filter(transcript, x -> coalesce({is_blank('x.text')}, true)), x -> x.speaker) _blank",
    )
    averaged = with_means(staged, {
        "average_llm_latency_ms": (_sum("_latency"), _count("_latency")),
        "average_response_time": (_sum("_response"), _count("_response")),
        "average_tool_latency": (_sum("_duration"), _count("_duration")),
        "average_candidate_response_length": (_sum("_answers", "0L"), _count("_answers")),
        "average_interviewer_question_length": (_sum("_questions", "0L"), _count("_questions")),
    })
    bad = json_error("x.error_type", "x.error_message")
    done = _finish(averaged, {
        "interview_duration_seconds": "coalesce((array_max(_seen) - array_min(_seen)) / 1e6D, 0.0D)",
        "transcript_turn_count": _count("transcript"),
        "interviewer_turn_count": _count("_questions"),
        "candidate_turn_count": _count("_answers"),
        "interview_stage_count": _count("_stages"),
        "total_llm_calls": _count("llm_calls"),
        "failed_llm_calls": _count(f"filter(llm_calls, x -> {call_failed('x.status')})"),
        "average_llm_latency_ms": "average_llm_latency_ms",
        "maximum_llm_latency_ms": "coalesce(array_max(_latency), 0.0D)",
        "total_prompt_tokens": _sum("transform(llm_calls, x -> coalesce(x.tokens_input, 0L))", "0L"),
        "total_completion_tokens": _sum("transform(llm_calls, x -> coalesce(x.tokens_output, 0L))", "0L"),
        "average_response_time": "average_response_time",
        "total_tool_calls": _count("tool_calls"),
        "failed_tool_calls": _count(f"filter(tool_calls, x -> {call_failed('x.status')})"),
        "average_tool_latency": "average_tool_latency",
        "maximum_tool_latency": "coalesce(array_max(_duration), 0.0D)",
        "retry_count": _count("filter(_text, t -> contains(t, 'retry'))"),
        "total_events": _count("timeline"),
        "timeout_events": _count("filter(_text, t -> contains(t, 'timeout'))"),
        "failure_events": _count("filter(timeline, x -> x.event_type = 'ERROR')"),
        "average_candidate_response_length": "average_candidate_response_length",
        "average_interviewer_question_length": "average_interviewer_question_length",
        "empty_candidate_responses": _count("filter(_blank, s -> s = 'candidate')"),
        "empty_transcript_turns": _count("_blank"),
        "high_latency_detected": _flag(
            f"greatest(array_max(_latency), array_max(_duration)) >= {HIGH_LATENCY_MS}D"),
        "json_errors_detected": _flag(f"coalesce(exists(llm_calls, x -> {bad}), false)"
                                      f" or coalesce(exists(tool_calls, x -> {bad}), false)"),
    }, sessions.columns)
    if not reuse_stored:
        return done
    return done.selectExpr(*sessions.columns, *(
        f"case when coalesce(size(extracted_signals), 0) > 0 then"
        f" try_element_at(filter(extracted_signals, s -> s.signal_name = '{n}'), -1).value else {n} end {n}"
        for n in FEATURES))


# ---------------------------------------------------------------------------
# reshaping


def signal_list() -> str:
    """The signals of a wide row as the nested ``extracted_signals`` list (SQL)."""
    return "array(" + ", ".join(
        f"named_struct('signal_name', '{n}', 'value', {n}, 'unit', '{unit}', 'source', '{source}', 'confidence', 1.0D)"
        for n, unit, source in SIGNALS) + ")"


def signal_rows(wide: DataFrame, *keys: str) -> DataFrame:
    """Wide row to (signal_name, value, unit, source, confidence) rows."""
    return wide.selectExpr(*(keys or ("session_id",)), f"inline({signal_list()})")


def signals_wide(rows: DataFrame, key: str = "session_id") -> DataFrame:
    """(key, signal_name, value) rows back to one wide row; absent signals are NULL.

    With an ``ord`` column the last of repeated names counts.
    """
    pick = "max_by(value, ord)" if "ord" in rows.columns else "max(value)"
    return rows.groupBy(key).agg(*(F.expr(f"{pick} filter (where signal_name = '{n}') {n}") for n in FEATURES))
