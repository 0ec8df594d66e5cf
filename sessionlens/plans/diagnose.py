"""Signals -> rules -> evidence -> similar sessions -> confidence -> diagnosis.

Every stage is a DataFrame function and can be replaced by another one.  Only
the neighbour search moves data; the rest is one narrow stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from sessionlens.operators.confidence import score_confidence
from sessionlens.operators.diagnosis import reason, template_diagnoser
from sessionlens.operators.rules import build_evidence, evaluate_rules
from sessionlens.operators.signals import signal_list, signals_nested
from sessionlens.operators.similarity import find_similar, history_of_sessions
from sessionlens.schema import FEATURES, Thresholds

Stage = Callable[[DataFrame], DataFrame]


def diagnose_signals(signals: DataFrame, history: DataFrame | None = None, k: int = 5,
                     limits: Thresholds = Thresholds(), diagnoser: Stage = template_diagnoser,
                     rules: Stage | None = None, evidence: Stage | None = None,
                     similar: Stage | None = None, confidence: Stage = score_confidence) -> DataFrame:
    """Diagnose wide signal rows; ``history`` comes from ``history_table``."""
    frame = rules(signals) if rules else evaluate_rules(signals, limits)
    frame = evidence(frame) if evidence else build_evidence(frame, limits)
    frame = similar(frame) if similar else find_similar(frame, history, k)
    return reason(confidence(frame), diagnoser)


def diagnose(sessions: DataFrame, history: DataFrame | None = None, k: int = 5,
             limits: Thresholds = Thresholds(), extract: Stage = signals_nested, **stages) -> DataFrame:
    """Diagnose nested sessions against nested ``history`` sessions.

    Signals of the diagnosed sessions are always extracted again; history rows
    use their stored signals when they have some.
    """
    base = extract(sessions.drop("diagnosis"))
    past = None if history is None else history_of_sessions(signals_nested(history, reuse_stored=True))
    done = diagnose_signals(base, past, k, limits, **stages)
    return done.selectExpr(f"* except ({', '.join(FEATURES)})", f"{signal_list()} signals")
