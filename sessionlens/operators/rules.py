"""Threshold rules with scores, and the evidence they leave behind.

Rules are data (``schema.RULES``).  They become CASE expressions on the wide
signal row, so evaluating all of them adds no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from sessionlens.functions.numbers import general, quoted
from sessionlens.operators.signals import signals_wide
from sessionlens.schema import RULES, Rule, Thresholds


def _limit(rule: Rule, limits: Thresholds) -> float:
    return 1.0 if rule.threshold is None else float(getattr(limits, rule.threshold))


def _triggered(rule: Rule, limit: float) -> str:
    test = {"limit": f">= {limit}D", "retries": f">= {limit}D", "minimum": f"< {limit}D"}.get(rule.kind, "> 0")
    return f"s.{rule.metric} {test}"


def _score(rule: Rule, limit: float) -> str:
    full = {"limit": f">= {2 * limit}D", "retries": f"> {limit}D", "count": ">= 2", "minimum": "= 0"}.get(rule.kind, "> 0")
    return f"case when s.{rule.metric} {full} then 1.0D when {_triggered(rule, limit)} then 0.75D else 0.0D end"


def _reason(rule: Rule, limit: float) -> str:
    if rule.kind == "flag":
        return f"case when {_triggered(rule, limit)} then {quoted(rule.text_on)} else {quoted(rule.text_off)} end"
    tail = {
        "limit": f" {rule.unit}; threshold is {limit:g} {rule.unit}.",
        "count": " failed calls.",
        "retries": f" retries; threshold is {limit:g}.",
        "minimum": f" transcript turns; minimum is {limit:g}.",
    }[rule.kind]
    return f"concat('Observed ', {general(f's.{rule.metric}')}, '{tail}')"


def _observed(rules: tuple[Rule, ...]) -> str:
    """The signals that rules look at; a missing one counts as 0."""
    metrics = dict.fromkeys(r.metric for r in rules)
    return "named_struct(" + ", ".join(f"'{m}', coalesce({m}, 0.0D)" for m in metrics) + ")"


def evaluate_rules(signals: DataFrame, limits: Thresholds = Thresholds(),
                   rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add ``rules``: one result per rule, in rule order; a missing signal counts as 0."""
    results = ", ".join(
        f"named_struct('rule_id', '{r.rule_id}', 'rule_name', {quoted(r.name)},"
        f" 'triggered', {_triggered(r, _limit(r, limits))}, 'score', {_score(r, _limit(r, limits))},"
        f" 'reason', {_reason(r, _limit(r, limits))})"
        for r in rules)
    return (signals.selectExpr("*", f"{_observed(rules)} s")
            .selectExpr("* except (s)", f"array({results}) rules"))


def rule_rows(frame: DataFrame, *keys: str) -> DataFrame:
    return frame.selectExpr(*(keys or ("session_id",)), "inline(rules)")


def evaluate_signal_rows(rows: DataFrame, limits: Thresholds = Thresholds(), key: str = "session_id") -> DataFrame:
    """Rules straight from (key, signal_name, value) rows."""
    return evaluate_rules(signals_wide(rows, key), limits)


def build_evidence(frame: DataFrame, limits: Thresholds = Thresholds(), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add ``evidence``: one source-linked record per triggered entry of ``rules``.

    The context of a rule comes from a constant map; an unknown rule is an error.
    """
    context = "map(" + ", ".join(
        f"'{r.rule_id}', named_struct('metric', '{r.metric}', 'expected', {_limit(r, limits)}D,"
        f" 'severity', '{r.severity}', 'explanation', {quoted(r.explanation)})" for r in rules) + ")"
    values = "map(" + ", ".join(f"'{m}', coalesce({m}, 0.0D)" for m in dict.fromkeys(r.metric for r in rules)) + ")"
    known = frame.selectExpr(
        "*", f"{values} _seen",
        f"transform(filter(rules, r -> r.triggered), r -> named_struct('r', r, 'c',"
        f" coalesce(try_element_at({context}, r.rule_id), raise_error(concat('unknown rule: ', r.rule_id))))) _fired")
    return known.selectExpr(
        "* except (_seen, _fired)",
        "transform(_fired, f -> named_struct("
        "'evidence_id', concat('evidence_', f.r.rule_id), 'description', f.r.rule_name,"
        " 'source_type', 'extracted_signal', 'source_id', f.c.metric, 'metric', f.c.metric,"
        " 'observed_value', _seen[f.c.metric], 'expected_value', f.c.expected, 'severity', f.c.severity,"
        " 'confidence', f.r.score, 'explanation', f.c.explanation, 'signal_name', f.c.metric,"
        " 'signal_value', _seen[f.c.metric], 'rule_id', f.r.rule_id)) evidence")


def evidence_rows(frame: DataFrame, *keys: str) -> DataFrame:
    return frame.selectExpr(*(keys or ("session_id",)), "inline(evidence)")
