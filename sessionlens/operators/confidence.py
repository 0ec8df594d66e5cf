"""Bounded confidence score from rules, evidence and historical matches (narrow)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sessionlens.functions.numbers import clamp01, fixed
from sessionlens.schema import CONFIDENCE_WEIGHTS, SEVERITY_WEIGHT


def _mean(array: str) -> str:
    total = f"aggregate({array}, 0.0D, (a, x) -> a + x)"
    return f"case when size({array}) > 0 then {clamp01(f'{total} / size({array})')} else 0.0D end"


def score_confidence(frame: DataFrame) -> DataFrame:
    """Add ``contributors``, ``confidence`` and ``confidence_text``.

    Needs the arrays ``rules``, ``evidence`` and ``similar``.
    """
    weights = " ".join(f"when '{name}' then {w}D" for name, w in SEVERITY_WEIGHT.items())
    staged = frame.selectExpr(
        "*",
        "filter(rules, r -> r.triggered) _fired",
        "filter(transform(evidence, e -> e.rule_id), i -> i <> '') _linked",
        f"transform(filter(evidence, e -> e.severity is not null), e -> case e.severity {weights} end) _weights",
        "transform(similar, m -> m.similarity_score) _near",
        "size(filter(similar, m -> m.failure_type is not null)) _labelled",
    ).selectExpr("*", "transform(_fired, r -> coalesce(r.score, 0.0D)) _scores")
    parts = {
        "rule_score": _mean("_scores"),
        "evidence_completeness": "case when size(_fired) > 0 then size(array_intersect("
                                 "transform(_fired, r -> r.rule_id), _linked)) / size(_fired) else 0.0D end",
        "evidence_severity": _mean("_weights"),
        "historical_similarity": "coalesce(array_max(_near), 0.0D)",
        "historical_failure_agreement": "case when size(_near) > 0 then _labelled / size(_near) else 0.0D end",
    }
    columns = "named_struct(" + ", ".join(f"'{n}', cast({parts[n]} as double)" for n in CONFIDENCE_WEIGHTS) + ")"
    scored = staged.selectExpr("* except (_fired, _linked, _weights, _near, _labelled, _scores)",
                               f"{columns} contributors")
    total = " + ".join(f"{w}D * contributors.{n}" for n, w in CONFIDENCE_WEIGHTS.items())
    pieces = ", ', ', ".join(f"'{n}=', {fixed(f'contributors.{n}')}" for n in CONFIDENCE_WEIGHTS)
    return scored.selectExpr("*", f"{clamp01(total)} confidence",
                             f"concat('Confidence contributors: ', {pieces}, '.') confidence_text")
