"""Small report tables read off the results (cards, pickers, observations)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sessionlens.functions.numbers import percent


def split_text(train: str, test: str) -> str:
    """Sizes and whole-percent shares of a split (SQL)."""
    share = f"cast(rint(100 * {train} / ({train} + {test})) as bigint)"
    return (f"case when {train} is null or {test} is null or {train} + {test} <= 0 then 'Unavailable'"
            f" else concat({train}, '/', {test}, ' (', {share}, '% / ', 100 - {share}, '%)') end")


def dataset_card(statistics: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """One row of dataset figures; the split comes from the first-ranked evaluation."""
    card = statistics.selectExpr("row_count sessions", "feature_count features", "failure_categories",
                                 "missing_values", "summary", "1 one")
    if metrics is None:
        return card.withColumn("split", F.lit("Unavailable")).drop("one")
    first = metrics.where("rank = 1").selectExpr("train_size", "test_size", "1 one")
    return card.join(first, "one", "left").withColumn("split", F.expr(split_text("train_size", "test_size"))).drop(
        "one", "train_size", "test_size")


def comparison_table(metrics: DataFrame) -> DataFrame:
    return metrics.select("model_name", "accuracy", "precision", "recall", "macro_f1", "weighted_f1", "micro_f1").orderBy(
        F.desc("macro_f1"), F.desc("accuracy"))


def model_options(metrics: DataFrame) -> DataFrame:
    return metrics.select(F.coalesce("model_name", F.lit("Unknown")).alias("model_name")).distinct().orderBy("model_name")


def matrix_of(confusion: DataFrame, model_name: str) -> DataFrame:
    return confusion.where(F.col("model_name") == model_name).drop("model_name")


def confusion_observations(confusion: DataFrame) -> DataFrame:
    """Most confused pair, best and worst class by recall, per model (first in label order on ties)."""
    order = "map_from_entries(transform(sort_array(collect_set(actual)), (x, i) -> struct(x, i)))"
    ranks = confusion.groupBy("model_name").agg(F.expr(order).alias("at"))
    cells = confusion.join(ranks, "model_name").selectExpr(
        "model_name", "actual", "predicted", "n", "at[actual] r", "at[predicted] c")
    pairs = cells.groupBy("model_name").agg(
        F.expr("max(struct(n, -r, -c, actual, predicted)) filter (where actual <> predicted) pair"))
    recall = cells.groupBy("model_name", "actual", "r").agg(F.expr(
        "coalesce(sum(n) filter (where actual = predicted) / nullif(sum(n), 0), 0.0D) recall"))
    ends = recall.groupBy("model_name").agg(
        F.expr("max(struct(recall, -r, actual)) best"), F.expr("min(struct(recall, r, actual)) worst"))
    return pairs.join(ends, "model_name").selectExpr(
        "model_name",
        "case when pair.n > 0 then concat('Most confused classes: ', pair.actual, ' predicted as ', pair.predicted,"
        " ' (', pair.n, ' sessions).') else 'No cross-class confusions were observed in this holdout.' end most_confused",
        f"concat('Best classified class: ', best.actual, ' (', {percent('best.recall')}, ' recall).') best_class",
        f"concat('Lowest recall class: ', worst.actual, ' (', {percent('worst.recall')}, ' recall).') worst_class",
        "case when pair.n > 0 then concat('The classifier most frequently confuses ', pair.actual, ' with ',"
        " pair.predicted, ' (', pair.n, ' sessions), indicating overlapping telemetry features in the evaluated holdout.')"
        " else 'No class confusions were observed in this evaluation holdout.' end interpretation")


def analytics_summary(statistics: DataFrame, metrics: DataFrame, drift: DataFrame, anomalies: DataFrame) -> DataFrame:
    """One row that joins the card, the best model, the drift status and the anomaly count."""
    card = dataset_card(statistics, metrics).withColumn("one", F.lit(1))
    best = metrics.where("rank = 1").selectExpr("model_name best_model", "accuracy", "1 one")
    return (card.join(best, "one", "left").join(drift.selectExpr("shifted_feature_count", "1 one"), "one", "left")
            .join(anomalies.selectExpr("anomaly_count", "1 one"), "one", "left")
            .selectExpr(
                "sessions", "features", "coalesce(best_model, 'Unavailable') best_model",
                "case when accuracy is null then 'Unavailable'"
                " else concat(format_string('%.1f', accuracy * 100), '%') end accuracy",
                "case when shifted_feature_count is null then 'Unavailable' when shifted_feature_count = 0"
                " then 'No significant drift' else concat(shifted_feature_count, ' shifted features') end drift_status",
                "coalesce(cast(anomaly_count as string), 'Unavailable') anomalies", "split"))
