"""The combined offline run: evaluation, importance, drift and anomalies of one feature table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from sessionlens.operators import anomaly, drift, evaluation, importance, reports
from sessionlens.operators.dataset import dataset_statistics
from sessionlens.schema import FEATURES
from sessionlens.session import cut_lineage


def importance_reports(features: DataFrame, label: str = "failure_category", names: tuple[str, ...] = FEATURES,
                       models: tuple[str, ...] = evaluation.MODELS, impute: str = "mean", seed: int = 42) -> DataFrame:
    """(model_name, method, ranking..., error) of models fitted on the whole table.

    A model without usable importance yields one row with its error instead of vanishing.
    """
    prepared = evaluation.fit_preparation(features, names, impute)
    parts = []
    for name in models:
        fitted = evaluation.fit_model(features, name, label, names, seed=seed, prepared=prepared)
        try:
            scores = importance.importance_scores(fitted, names)
            ranked, error = importance.rank_importance(scores), None
        except importance.ImportanceError as problem:
            ranked = features.sparkSession.createDataFrame(
                [(None, None, None, None)],
                "feature_name string, importance_score double, normalized_score double, rank bigint")
            error = str(problem)
        parts.append(ranked.select(F.lit(name).alias("model_name"), "feature_name", "importance_score",
                                   "normalized_score", "rank", F.lit(error).cast("string").alias("error")))
    return reduce(DataFrame.unionByName, parts)


def run_analytics(current: DataFrame, baseline: DataFrame, label: str = "failure_category",
                  names: tuple[str, ...] = FEATURES, seed: int = 42,
                  models: tuple[str, ...] = evaluation.MODELS) -> dict[str, DataFrame]:
    """All report tables by name; the feature tables are materialised once."""
    current, baseline = cut_lineage(current), cut_lineage(baseline)
    tables = dict(evaluation.evaluate(current, label, names, seed=seed, models=models))
    tables["importance"] = importance_reports(current, label, names, models, seed=seed)
    tables["feature_drift"] = cut_lineage(drift.feature_drift(baseline, current, names))
    tables["label_drift"] = drift.label_drift(baseline, current)
    tables["drift_summary"] = drift.drift_summary(tables["feature_drift"])
    tables["anomalies"] = cut_lineage(anomaly.analyze_anomalies(current, names, seed=seed))
    tables["clusters"] = anomaly.cluster_statistics(tables["anomalies"])
    tables["anomaly_totals"] = anomaly.anomaly_totals(tables["anomalies"])
    tables["summary"] = reports.analytics_summary(
        dataset_statistics(current, names), tables["metrics"], tables["drift_summary"], tables["anomaly_totals"])
    return tables
