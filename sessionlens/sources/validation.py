"""Record checks as boolean expressions over parsed rows.

Spark's JSON reader accepts rows the data contract rejects (missing required
fields, unknown enum values, values out of range), so the rules are explicit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from sessionlens import schema as S


class DatasetValidationError(ValueError):
    """A row breaks the data contract and strict loading was asked for."""


# Required fields, value domains and [0, 1] fields by place ("" is the record itself).
REQUIRED = {
    "": ("session_id", "status"),
    "candidate": ("candidate_id",),
    "transcript[]": ("turn_id", "speaker", "text"),
    "llm_calls[]": ("call_id", "model_name"),
    "tool_calls[]": ("call_id", "tool_name"),
    "timeline[]": ("event_id", "event_type"),
    "extracted_signals[]": ("signal_name", "value", "source"),
    "diagnosis": ("root_cause", "affected_component", "severity", "confidence"),
    "diagnosis.evidence_records[]": ("evidence_id", "description", "source_type", "source_id"),
    "diagnosis.rule_evaluations[]": ("rule_id", "rule_name", "triggered"),
    "diagnosis.similar_session_records[]": ("session_id", "similarity_score"),
}
DOMAINS = {
    "": {"status": S.SESSION_STATUS},
    "transcript[]": {"speaker": S.SPEAKER, "stage": S.STAGE},
    "llm_calls[]": {"status": S.CALL_STATUS, "error_type": S.ERROR_TYPE},
    "tool_calls[]": {"error_type": S.ERROR_TYPE},  # tool status may be any text
    "timeline[]": {"event_type": S.EVENT_TYPE, "stage": S.STAGE},
    "diagnosis": {"root_cause": S.FAILURE_TYPE, "affected_component": S.COMPONENT, "severity": S.SEVERITY},
    "diagnosis.evidence_records[]": {"severity": S.SEVERITY},
    "diagnosis.similar_session_records[]": {"failure_type": S.FAILURE_TYPE},
    "ground_truth": {"expected_status": S.SESSION_STATUS, "expected_failure_type": S.FAILURE_TYPE,
                     "expected_affected_component": S.COMPONENT, "expected_severity": S.SEVERITY},
}
UNIT_RANGE = {
    "extracted_signals[]": ("confidence",),
    "diagnosis": ("confidence",),
    "diagnosis.evidence_records[]": ("confidence",),
    "diagnosis.similar_session_records[]": ("similarity_score",),
}
UUIDS = {"": ("session_id",), "diagnosis.similar_session_records[]": ("session_id",)}
LISTS = ("transcript", "llm_calls", "tool_calls", "timeline", "extracted_signals")

_HEX = r"([0-9a-f]{8})-?([0-9a-f]{4})-?([0-9a-f]{4})-?([0-9a-f]{4})-?([0-9a-f]{12})"
UUID_PATTERN = rf"^(?:urn:uuid:)?\{{?{_HEX}\}}?$"


def is_uuid(text: str) -> str:
    return f"lower({text}) rlike r'{UUID_PATTERN}'"


def canonical_uuid(text: str) -> str:
    """Lower case with hyphens; text that is no UUID stays as it is."""
    return (f"case when {is_uuid(text)} then regexp_replace(lower({text}), r'{UUID_PATTERN}', '$1-$2-$3-$4-$5')"
            f" else {text} end")


def _rules() -> list[tuple[str, str]]:
    """(message, condition that is true for a broken row)."""
    out: list[tuple[str, str]] = []

    def add(place: str, field: str, message: str, broken) -> None:
        where = place.removesuffix("[]")
        label = f"{where}.{field}" if where else field
        if place.endswith("[]"):
            test = f"exists({where}, x -> coalesce({broken(f'x.{field}')}, false))"
        elif place:
            test = f"{where} is not null and {broken(f'{where}.{field}')}"
        else:
            test = broken(field)
        out.append((f"{label}: {message}", test))

    for place, fields in REQUIRED.items():
        for field in fields:
            add(place, field, "field required", lambda c: f"{c} is null")
    for place, domains in DOMAINS.items():
        for field, values in domains.items():
            allowed = ", ".join(f"'{v}'" for v in values)
            add(place, field, "unknown value", lambda c, allowed=allowed: f"{c} not in ({allowed})")
    for place, fields in UNIT_RANGE.items():
        for field in fields:
            add(place, field, "must be between 0 and 1", lambda c: f"not ({c} between 0.0D and 1.0D)")
    for place, fields in UUIDS.items():
        for field in fields:
            add(place, field, "not a UUID", lambda c: f"not ({is_uuid(c)})")
    out.append(("diagnosis.similar_sessions: not a UUID",
                f"exists(diagnosis.similar_sessions, x -> coalesce(not ({is_uuid('x')}), true))"))
    for name in LISTS:
        out.append((f"{name}: entry must be an object", f"exists({name}, x -> x is null)"))
    return out


def with_issues(parsed: DataFrame) -> DataFrame:
    """Add ``issues``: the messages of all rules that a parsed row breaks."""
    checks = ", ".join(f"case when coalesce({test}, false) then '{message}' end" for message, test in _rules())
    return parsed.selectExpr("*", f"array_compact(array({checks})) issues")


def with_round_trip(sessions: DataFrame) -> DataFrame:
    """(session_id, value, issues): the JSON text of each row and the messages of what reading it back breaks."""
    text = sessions.selectExpr("session_id as written_id", "to_json(struct(*)) value")
    again = text.selectExpr("written_id", "value", f"inline(array(from_json(value, {_literal(S.SESSION_DDL + ', _corrupt STRING')},"
                            " map('mode', 'PERMISSIVE', 'columnNameOfCorruptRecord', '_corrupt'))))")
    return with_issues(again).selectExpr(
        "written_id session_id", "value", "case when _corrupt is not null then array('not readable') else issues end issues")


def revalidate(sessions: DataFrame) -> DataFrame:
    """Rows that would not survive being written and read again, with their messages."""
    return with_round_trip(sessions).where("size(issues) > 0").drop("value")


def _literal(text: str) -> str:
    return "'" + " ".join(text.split()) + "'"
