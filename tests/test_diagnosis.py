"""Signals, rules, evidence, confidence, diagnosis: hand-made and golden sessions."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import event, llm, record, sid, tool, turn
from sessionlens.operators import diagnosis, rules, signals
from sessionlens.operators.confidence import score_confidence
from sessionlens.operators.similarity import MATCH
from sessionlens.plans.diagnose import diagnose, diagnose_signals
from sessionlens.schema import FEATURES, RULE_IDS, Thresholds

EXAMPLES = os.environ.get("SESSIONLENS_EXAMPLES", "")  # a folder with the four golden sessions of FIXTURES.md
SCENARIOS = ("successful_interview", "llm_timeout", "network_api_failure", "tool_timeout")
GOLD = {  # in the order of SCENARIOS
    "interview_duration_seconds": (171, 207, 143, 191), "transcript_turn_count": (10, 12, 8, 10),
    "interview_stage_count": (4, 5, 4, 4), "total_llm_calls": (5, 6, 4, 5), "failed_llm_calls": (0, 1, 1, 0),
    "average_llm_latency_ms": (1145.46, 7717.31, 975.66, 950.6),
    "maximum_llm_latency_ms": (1708.15, 41399.86, 1576.66, 1738.11), "total_tokens": (3641, 4447, 2831, 2953),
    "average_tool_latency": (528.2, 8489.62, 828.36, 10747.03), "failed_tool_calls": (0, 1, 1, 1),
    "retry_count": (0, 2, 2, 2), "total_events": (21, 27, 20, 23), "timeout_events": (0, 1, 0, 1),
    "failure_events": (0, 2, 2, 2), "average_candidate_response_length": (27.8, 36.17, 27.25, 28.2),
    "average_interviewer_question_length": (14, 13.67, 14.5, 15), "high_latency_detected": (0, 1, 0, 1),
    "multiple_retries": (0, 1, 1, 1), "tool_failures_detected": (0, 1, 1, 1), "empty_transcript": (0, 0, 0, 0),
}


def one(frame):
    return frame.first().asDict()


def test_success_session(sessions):
    s = sessions(record(
        transcript=[turn(1, "interviewer", "a question", stage="technical"), turn(2, "candidate", "an answer here")],
        llm_calls=[llm(1, latency_ms=500, duration_ms=600, tokens_input=100, tokens_output=20, status="success")],
        tool_calls=[tool(1, duration_ms=200, status="ok")],
        timeline=[event(1, "TURN", 0, stage="coding"), event(2, "METRIC", 30)]))
    row = one(signals.signals_nested(s))
    assert row["interview_duration_seconds"] == 30 and row["total_tokens"] == 120
    assert row["average_response_time"] == 600 and row["average_llm_latency_ms"] == 500
    assert row["average_candidate_response_length"] == 3 and row["interview_stage_count"] == 2
    assert row["failed_tool_calls"] == 0 and row["empty_transcript"] == 0
    rows = signals.signal_rows(signals.signals_nested(s)).collect()
    assert [r["signal_name"] for r in rows] == list(FEATURES) and {r["confidence"] for r in rows} == {1.0}


def test_mixed_session(sessions):
    row = one(signals.signals_nested(sessions(record(
        llm_calls=[llm(1, latency_ms=30500.5, status="timeout", error_type="timeout"),
                   llm(2, latency_ms=750, status="error", error_type="validation")],
        tool_calls=[tool(1, duration_ms=18000, status="timeout")],
        timeline=[event(1, "ERROR", 1, description="LLM timeout"), event(2, "METRIC", 2, description="Retry attempt 1"),
                  event(3, "ERROR", 3, description="Tool TIMEOUT"), event(4, "METRIC", 4, description="retry again")]))))
    assert row["average_llm_latency_ms"] == 15625.25 and row["failed_llm_calls"] == 2
    assert (row["timeout_events"], row["retry_count"], row["retry_events"], row["failure_events"]) == (2, 2, 2, 2)
    assert row["json_errors_detected"] == row["high_latency_detected"] == row["multiple_retries"] == 1
    assert row["tool_failures_detected"] == 1


def test_empty_session_and_null_lists(sessions):
    for r in (record(), record(transcript=[], llm_calls=[], tool_calls=[], timeline=[])):
        row = one(signals.signals_nested(sessions(r)))
        assert row["empty_transcript"] == 1
        assert all(row[n] == 0 for n in FEATURES if n != "empty_transcript")


def test_blank_turn_and_json_message(sessions):
    row = one(signals.signals_nested(sessions(record(
        transcript=[turn(1, "candidate", "  \n"), turn(2, "interviewer", "hi")],
        llm_calls=[llm(1)], tool_calls=[tool(1, status="legacy", error_message="bad JSON body")]))))
    assert row["empty_candidate_responses"] == row["empty_transcript_turns"] == row["empty_transcript"] == 1
    assert row["json_errors_detected"] == 1 and row["failed_tool_calls"] == 1 and row["failed_llm_calls"] == 0


def test_large_session(sessions):
    row = one(signals.signals_nested(sessions(record(
        transcript=[turn(i, "candidate" if i % 2 else "interviewer", "w " * i) for i in range(1, 201)],
        llm_calls=[llm(i, latency_ms=i, tokens_input=i, tokens_output=1) for i in range(100)],
        tool_calls=[tool(i, duration_ms=i) for i in range(100)],
        timeline=[event(i, "METRIC", i) for i in range(300)]))))
    assert (row["transcript_turn_count"], row["total_llm_calls"], row["total_tool_calls"], row["total_events"]) == (200, 100, 100, 300)
    assert row["total_tokens"] == sum(range(100)) + 100 and row["interview_duration_seconds"] == 299


def test_long_form_equals_nested_form(spark, sessions):
    import random
    random.seed(7)

    def some(kind, n):
        return [kind(i) for i in range(random.randint(0, n))]

    made = [record(
        i, transcript=some(lambda j: turn(j, random.choice(["candidate", "interviewer", "system"]),
                                          random.choice(["", " ", "some words here", "JSON"]),
                                          stage=random.choice([None, "coding", "evaluation"]), tokens=random.choice([None, j])), 9),
        llm_calls=some(lambda j: llm(j, latency_ms=random.choice([None, j * 987.125]), duration_ms=random.choice([None, j * 3.5]),
                                     status=random.choice([None, "ok", "timeout"]), tokens_input=random.choice([None, j]),
                                     tokens_output=j, error_type=random.choice([None, "validation", "provider"])), 7),
        tool_calls=some(lambda j: tool(j, duration_ms=random.choice([None, j * 1500.5]), status=random.choice([None, "success", "weird"]),
                                       error_message=random.choice([None, "Json!"])), 7),
        timeline=some(lambda j: event(j, random.choice(["ERROR", "TURN"]), random.choice([None, j * 7]),
                                      description=random.choice([None, "Retry", "a Timeout"]), stage=random.choice([None, "technical"])), 9),
    ) for i in range(60)]
    nested = sessions(*made)
    tables = {name: nested.selectExpr("session_id", f"inline({name})") for name in ("llm_calls", "tool_calls", "timeline")}
    measured = signals.measures_of_tables(turns=nested.selectExpr("session_id", "inline(transcript)"), sessions=nested, **tables)
    long = signals.signals_long(measured.repartition(5)).orderBy("session_id").collect()
    wide = signals.signals_nested(nested).select("session_id", *FEATURES).orderBy("session_id").collect()
    assert long == wide and len(long) == 60


def test_stored_signals_replace_extraction(sessions):
    stored = [{"signal_name": "total_tokens", "value": 7, "source": "x"}, {"signal_name": "retry_count", "value": 1, "source": "x"},
              {"signal_name": "retry_count", "value": 5, "source": "x"}]
    row = one(signals.signals_nested(sessions(record(extracted_signals=stored)), reuse_stored=True))
    assert row["total_tokens"] == 7 and row["retry_count"] == 5 and row["total_events"] is None


def test_reshaping_round_trip(spark):
    rows = spark.createDataFrame([("a", "retry_count", 1.0, 0), ("a", "retry_count", 3.0, 1), ("a", "total_tokens", 9.0, 2)],
                                 "session_id string, signal_name string, value double, ord int")
    row = one(signals.signals_wide(rows))
    assert row["retry_count"] == 3 and row["total_tokens"] == 9 and row["total_events"] is None


# --- rules ---------------------------------------------------------------------------


def wide(spark, *rows):
    return spark.createDataFrame([(str(i), *(r.get(n) for n in FEATURES)) for i, r in enumerate(rows)],
                                 "session_id string, " + ", ".join(f"{n} double" for n in FEATURES))


@pytest.mark.parametrize("metric, rule, below, at, double", [
    ("maximum_llm_latency_ms", "high_llm_latency", 4999.99, 5000, 10000),
    ("maximum_tool_latency", "high_tool_latency", 4999.99, 5000, 10000),
    ("failed_llm_calls", "failed_llm_calls", 0, 1, 2), ("failed_tool_calls", "failed_tool_calls", 0, 1, 2),
    ("retry_count", "multiple_retries", 1, 2, 3), ("total_tokens", "excessive_token_usage", 9999, 10000, 20000),
    ("interview_duration_seconds", "long_interview_duration", 1799, 1800, 3600),
    ("transcript_turn_count", "very_low_transcript_activity", 4, 3, 0)])
def test_rule_boundaries(spark, metric, rule, below, at, double):
    frame = rules.rule_rows(rules.evaluate_rules(wide(spark, *({metric: float(v)} for v in (below, at, double)))))
    got = frame.where(F.col("rule_id") == rule).orderBy("session_id").collect()
    assert [(r["triggered"], r["score"]) for r in got] == [(False, 0.0), (True, 0.75), (True, 1.0)]


def test_rules_come_in_order_and_missing_counts_as_zero(spark):
    got = rules.rule_rows(rules.evaluate_rules(wide(spark, {}))).collect()
    assert [r["rule_id"] for r in got] == list(RULE_IDS)
    assert [r["rule_id"] for r in got if r["triggered"]] == ["very_low_transcript_activity"]
    assert got[0]["reason"] == "Observed 0 ms; threshold is 5000 ms."
    assert got[4]["reason"] == "Observed 0 retries; threshold is 2."


def test_thresholds_do_not_change_fixed_signals(sessions):
    s = sessions(record(llm_calls=[llm(1, latency_ms=6000)]))
    d = diagnose(s, limits=Thresholds(llm_timeout_ms=9000))
    row = d.selectExpr("rules[0].triggered t", "signals[26].value v").first()
    assert row["t"] is False and row["v"] == 1.0


def test_rules_from_rows(spark):
    rows = spark.createDataFrame([("a", "retry_count", 2.0)], "session_id string, signal_name string, value double")
    got = rules.rule_rows(rules.evaluate_signal_rows(rows)).where("rule_id = 'multiple_retries'").first()
    assert got["score"] == 0.75


# --- evidence and confidence ------------------------------------------------------------


@pytest.mark.parametrize("metric, value, rule, severity, expected", [
    ("maximum_llm_latency_ms", 6000.0, "high_llm_latency", "high", 5000.0), ("retry_count", 2.0, "multiple_retries", "medium", 2.0),
    ("json_errors_detected", 1.0, "json_validation_errors", "medium", 1.0), ("total_tokens", 10000.0, "excessive_token_usage", "medium", 10000.0),
    ("interview_duration_seconds", 1800.0, "long_interview_duration", "low", 1800.0), ("failed_tool_calls", 1.0, "failed_tool_calls", "high", 1.0)])
def test_evidence_context(spark, metric, value, rule, severity, expected):
    frame = rules.build_evidence(rules.evaluate_rules(wide(spark, {metric: value, "transcript_turn_count": 9.0})))
    (e,) = rules.evidence_rows(frame).collect()
    assert (e["rule_id"], e["metric"], e["severity"], e["expected_value"], e["observed_value"]) == (rule, metric, severity, expected, value)
    assert e["evidence_id"] == f"evidence_{rule}"
    assert e["confidence"] == (1.0 if rule == "json_validation_errors" else 0.75)


def test_no_evidence_without_trigger_and_unknown_rule_fails(spark):
    calm = wide(spark, {"transcript_turn_count": 9.0})
    assert rules.evidence_rows(rules.build_evidence(rules.evaluate_rules(calm))).count() == 0
    odd = calm.selectExpr("*", "array(named_struct('rule_id', 'nope', 'rule_name', 'x', 'triggered', true, 'score', 1.0D)) rules")
    with pytest.raises(Exception, match="unknown rule"):
        rules.build_evidence(odd).select("evidence").collect()


RULE = "array<struct<rule_id:string,triggered:boolean,score:double>>"
EVIDENCE = "array<struct<rule_id:string,severity:string>>"


def confidence(spark, rule_list, evidence, similar):
    frame = spark.createDataFrame([(rule_list, evidence, similar)], f"rules {RULE}, evidence {EVIDENCE}, similar {MATCH.replace(': ', ':')}")
    return score_confidence(frame).first()


def test_confidence_examples(spark):
    hit = [("r", True, 1.0)]
    match = [("s", 0.97, "timeout", None)]
    full = confidence(spark, hit, [("r", "critical")], match)
    assert full["confidence"] == pytest.approx(0.997)
    assert full["confidence_text"] == ("Confidence contributors: rule_score=1.00, evidence_completeness=1.00, evidence_severity=1.00, "
                                       "historical_similarity=0.97, historical_failure_agreement=1.00.")
    assert confidence(spark, [("r", True, 0.5)], [], [])["confidence"] == pytest.approx(0.2)
    assert confidence(spark, hit, [], [])["confidence"] == pytest.approx(0.4)
    assert confidence(spark, [("r", False, 1.0)], [], [])["confidence"] == 0.0
    assert confidence(spark, hit * 2, [("r", None)], [("s", 1.0, None, None)])["contributors"]["evidence_completeness"] == 0.5


# --- golden sessions -------------------------------------------------------------------


@pytest.mark.skipif(not os.path.isdir(EXAMPLES), reason="SESSIONLENS_EXAMPLES names no folder")
def test_golden_sessions(spark):
    from sessionlens.sources.readers import read_sessions
    every = read_sessions(spark, f"{EXAMPLES}/*.json").rows
    order = SCENARIOS
    ids = {r["s"]: r["session_id"] for r in every.selectExpr("ground_truth.scenario_id s", "session_id").collect()}
    wide_rows = {r["session_id"]: r for r in signals.signals_nested(every).collect()}
    for name, expected in GOLD.items():
        assert tuple(wide_rows[ids[n]][name] for n in order) == pytest.approx(expected), name
    alone = {r["session_id"]: r for r in diagnose(every).collect()}
    together = {r["session_id"]: r for r in diagnose(every, every).collect()}
    assert [alone[ids[n]]["confidence"] for n in order] == pytest.approx([0.0, 0.68, 0.633333, 0.666667], abs=1e-5)
    assert [together[ids[n]]["confidence"] for n in order] == pytest.approx([0.175, 0.855, 0.808333, 0.841667], abs=1e-5)
    d = alone[ids["llm_timeout"]]["diagnosis"]
    assert (d["root_cause"], d["affected_component"], d["severity"]) == ("timeout", "model_response", "high")
    assert d["similar_sessions"] is None and len(d["evidence"]) == 6
    assert alone[ids["tool_timeout"]]["diagnosis"]["root_cause"] == "tool_failure"
    best = together[ids["tool_timeout"]]["similar"][:2]
    assert best[0]["session_id"] == ids["tool_timeout"] and best[1]["similarity_score"] == pytest.approx(0.0557, abs=1e-3)


def test_diagnosis_mapping_and_listings(spark):
    frame = wide(spark, {"json_errors_detected": 1.0, "transcript_turn_count": 9.0}, {"transcript_turn_count": 0.0, "empty_transcript": 1.0},
                 {"transcript_turn_count": 9.0})
    done = diagnose_signals(frame).orderBy("session_id")
    got = [r["diagnosis"] for r in done.collect()]
    assert [(g["root_cause"], g["affected_component"], g["severity"]) for g in got] == [
        ("prompt_issue", "model_response", "medium"), ("unknown", "data", "high"), ("unknown", "unknown", "low")]
    assert done.first()["reasoning_prompt"].startswith("triggered_rules=['json_validation_errors']; evidence_count=1; similar_session_count=0; confidence=")
    view = diagnosis.overview(done).orderBy("session_id").first()
    assert view["root_cause"] == "Prompt Issue" and view["severity"] == "Medium"
    counts = diagnosis.stage_counts(done.selectExpr("*", f"{signals.signal_list()} signals")).orderBy("session_id").first()
    assert (counts["signals"], counts["evaluations"], counts["records"], counts["matches"]) == (31, 10, 1, 0)


def test_stages_can_be_replaced(spark):
    def silent(frame):
        return frame.withColumn("diagnosis", F.lit("custom"))
    row = diagnose_signals(wide(spark, {}), diagnoser=silent).first()
    assert row["diagnosis"] == "custom" and row["reasoning_prompt"]


def test_timeline_keeps_file_order(sessions):
    rows = diagnosis.timeline_rows(sessions(record(timeline=[event(1, "ERROR", 50), event(2, "TURN", 10)]))).collect()
    assert [(r["pos"], r["event"]) for r in rows] == [(0, "ERROR"), (1, "TURN")]


def test_diagnose_does_not_read_stored_signals_of_the_query(sessions):
    s = sessions(record(extracted_signals=[{"signal_name": "retry_count", "value": 9, "source": "x"}]))
    assert diagnose(s).selectExpr("signals[17].value v").first()["v"] == 0.0
