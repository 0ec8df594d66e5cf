"""Feature tables, labels, dataset statistics and flat session rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sessionlens.functions.numbers import rounded
from sessionlens.functions.stats import present
from sessionlens.operators.signals import signals_nested
from sessionlens.schema import CSV_SIGNALS, FEATURES, FLAT_COLUMNS



def _row_id(frame: DataFrame) -> list[str]:
    return ["row_id"] if "row_id" in frame.columns else []


def features_of_sessions(sessions: DataFrame) -> DataFrame:
    """31 features and 3 ground-truth labels per nested session (stored signals preferred).

    Labels never come from a predicted diagnosis.
    """
    wide = signals_nested(sessions, reuse_stored=True)
    return wide.selectExpr(
        *_row_id(wide), "session_id", *FEATURES, "ground_truth.expected_failure_type root_cause",
        "ground_truth.expected_affected_component affected_component", "ground_truth.scenario_id failure_category",
        "'jsonl' source_format")


def features_of_flat_rows(rows: DataFrame) -> DataFrame:
    """Partial features from flat text rows: six signals are there, the others are missing.

    Cells that are blank or no number count as missing.
    """
    have = set(rows.columns)

    def signal(name: str) -> str:
        column = CSV_SIGNALS.get(name)
        if column not in have:
            return f"cast(null as double) {name}"
        return f"{present(f'try_cast(trim({column}) as double)')} {name}"

    def label(column: str, name: str) -> str:
        return f"nullif({column}, '') {name}" if column in have else f"cast(null as string) {name}"

    return rows.selectExpr(
        *_row_id(rows), "session_id", *(signal(n) for n in FEATURES), label("ground_truth_failure_type", "root_cause"),
        label("ground_truth_component", "affected_component"), label("ground_truth_scenario", "failure_category"),
        "'csv' source_format")


def missing_by_feature(features: DataFrame, names: tuple[str, ...] = FEATURES) -> DataFrame:
    """(position, feature, missing) from one aggregation."""
    counts = features.selectExpr(*(f"count_if({present(n)} is null) {n}" for n in names))
    cells = ", ".join(f"named_struct('feature', '{n}', 'missing', {n})" for n in names)
    return counts.selectExpr(f"posexplode(array({cells})) as (pos, c)").selectExpr(
        "cast(pos as bigint) position", "c.feature feature", "c.missing missing")


def most_missing(features: DataFrame, top: int = 15) -> DataFrame:
    return missing_by_feature(features).orderBy(F.desc("missing"), "position").limit(top)


def class_balance(features: DataFrame) -> DataFrame:
    return features.groupBy(F.expr("coalesce(nullif(root_cause, ''), 'unlabeled')").alias("label")).agg(
        F.count("*").alias("sessions"))


def dataset_statistics(features: DataFrame, names: tuple[str, ...] = FEATURES) -> DataFrame:
    """One row: size, missing total, distinct categories and the summary sentence."""
    gaps = " + ".join(f"cast({present(n)} is null as bigint)" for n in names)
    kind = F.max("source_format") if "source_format" in features.columns else F.lit("jsonl")
    return features.agg(
        F.count("*").alias("row_count"), F.expr(f"coalesce(sum({gaps}), 0L)").alias("missing_values"),
        F.expr("count(distinct nullif(failure_category, ''))").alias("failure_categories"),
        kind.alias("f"),
    ).selectExpr(
        "row_count", f"{len(names)}L feature_count", "failure_categories", "missing_values",
        f"concat(upper(coalesce(f, 'jsonl')), ' dataset with ', row_count, ' sessions, {len(names)} stable features, and ',"
        " missing_values, ' missing values.') summary")


def derived_metrics(sessions: DataFrame) -> DataFrame:
    """Session metrics recomputed from the records; tokens cover transcript and model calls."""
    staged = sessions.selectExpr(
        "session_id", "coalesce(size(transcript), 0) n", "status",
        "coalesce(aggregate(transform(transcript, t -> coalesce(t.tokens, 0L)), 0L, (a, x) -> a + x), 0L) spoken",
        "filter(transform(llm_calls, c -> c.latency_ms), x -> x is not null) latency",
        "coalesce(aggregate(transform(llm_calls, c -> coalesce(c.tokens_input, 0L) + coalesce(c.tokens_output, 0L)),"
        " 0L, (a, x) -> a + x), 0L) used",
        "coalesce(size(filter(llm_calls, c -> not (c.status <=> 'success'))), 0)"
        " + coalesce(size(filter(tool_calls, c -> not (c.status <=> 'success'))), 0) errors",
    ).selectExpr(
        "*", "case when n > 0 then spoken / n else 0.0D end length",
        "case when size(latency) > 0 then aggregate(latency, 0.0D, (a, x) -> a + x) / size(latency) else 0.0D end mean")
    return staged.selectExpr(
        "session_id", "cast(n as bigint) num_turns", f"{rounded('length')} avg_turn_length",
        f"{rounded('mean')} avg_llm_latency_ms", "spoken + used total_tokens",
        "cast(errors + case when status = 'failed' and errors = 0 then 1 else 0 end as bigint) num_errors")


def injected_retries(sessions: DataFrame) -> DataFrame:
    """Timeline entries that mention ``Retry attempt`` in exactly this spelling."""
    return sessions.selectExpr("session_id", "cast(coalesce(size(filter(timeline, e -> contains("
                               "coalesce(e.description, ''), 'Retry attempt'))), 0) as bigint) injected_retries")


def flat_rows(sessions: DataFrame) -> DataFrame:
    """Nested sessions as flat 21-column rows."""
    staged = sessions.selectExpr(
        "*", "filter(transform(timeline, e -> unix_micros(e.timestamp)), x -> x is not null) _seen").selectExpr(
        "*", "coalesce((array_max(_seen) - array_min(_seen)) / 1e6D, 0.0D) _duration")
    source = {
        "candidate_id": "candidate.candidate_id", "candidate_name": "candidate.name",
        "experience_years": "candidate.experience_years",
        "interview_role": "try_variant_get(metadata, '$.interview_role', 'string')",
        "stages": "coalesce(array_join(try_variant_get(metadata, '$.stages', 'array<string>'), ';'), '')",
        "duration_seconds": rounded("_duration"), "num_turns": "metrics.num_turns",
        "num_llm_calls": "cast(coalesce(size(llm_calls), 0) as bigint)",
        "num_tool_calls": "cast(coalesce(size(tool_calls), 0) as bigint)",
        "num_errors": "metrics.num_errors", "avg_llm_latency_ms": "metrics.avg_llm_latency_ms",
        "total_tokens": "metrics.total_tokens", "ground_truth_scenario": "ground_truth.scenario_id",
        "ground_truth_failure_type": "ground_truth.expected_failure_type",
        "ground_truth_component": "ground_truth.expected_affected_component",
        "ground_truth_severity": "ground_truth.expected_severity",
    }
    return staged.selectExpr(*(f"{source.get(c, c)} {c}" for c in FLAT_COLUMNS))


def collection_statistics(sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row of totals, failed sessions per scenario).

    The mean duration is over sessions with two or more timestamps, the mean
    latency over all model calls.
    """
    staged = sessions.selectExpr(
        "status", "filter(transform(timeline, e -> unix_micros(e.timestamp)), x -> x is not null) seen",
        "filter(transform(llm_calls, c -> c.latency_ms), x -> x is not null) latency",
    ).selectExpr(
        "status", "case when size(seen) > 1 then (array_max(seen) - array_min(seen)) / 1e6D end duration",
        "coalesce(aggregate(latency, 0.0D, (a, x) -> a + x), 0.0D) spent", "coalesce(size(latency), 0) calls")
    totals = staged.selectExpr(
        "count(*) total_sessions", "count_if(status = 'passed') success_count", "coalesce(avg(duration), 0.0D) d",
        "coalesce(sum(spent) / nullif(sum(calls), 0), 0.0D) l",
    ).selectExpr("total_sessions", "success_count", f"{rounded('d')} average_duration_seconds",
                 f"{rounded('l')} average_llm_latency_ms")
    failures = sessions.where("status = 'failed'").groupBy(
        F.expr("case when ground_truth is null then 'unknown' else ground_truth.scenario_id end").alias("scenario")).agg(
        F.count("*").alias("sessions"))
    return totals, failures


REPRESENTATIVES = {
    "healthy_session": "status = 'passed'",
    "llm_timeout": "ground_truth.scenario_id <=> 'llm_timeout'",
    "tool_timeout": "ground_truth.scenario_id <=> 'tool_timeout'",
    "mixed_failure": "coalesce(size(filter(llm_calls, c -> not coalesce(c.status in ('success', 'ok'), false))), 0)"
                     " + coalesce(size(filter(tool_calls, c -> not coalesce(c.status in ('success', 'ok'), false))), 0) >= 2",
}


def representatives(sessions: DataFrame, order: str = "row_id") -> DataFrame:
    """First session (by ``order``) of each representative kind: one aggregation, no sort."""
    picks = sessions.agg(*(F.expr(f"min_by(session_id, {order}) filter (where {test})").alias(name)
                           for name, test in REPRESENTATIVES.items()))
    cells = ", ".join(f"named_struct('example', '{n}', 'session_id', {n})" for n in REPRESENTATIVES)
    return picks.selectExpr(f"inline(array({cells}))").where("session_id is not null")


