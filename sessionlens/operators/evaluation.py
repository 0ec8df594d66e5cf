"""Supervised evaluation: stratified holdout, three classifiers, metrics, ranking.

All metrics come from the confusion counts (classes x classes rows).  Training
runs on Spark ML (regression), ``forest`` and ``boosting``; features are imputed with exact
medians of the training part.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window, functions as F

from sessionlens.functions.stats import Preparation, fit_preparation
from sessionlens.operators.boosting import SoftmaxBoosting
from sessionlens.operators.forest import RandomForest
from sessionlens.schema import FEATURES, LABELS
from sessionlens.session import cut_lineage

MODELS = ("Logistic Regression", "Random Forest", "Gradient Boosting")
ROWS_PER_PARTITION = 20_000
MOST_CLASSES = 1000  # classes of a label; class counts and confusion cells are small tables only up to a bound
METRICS = ("accuracy", "precision", "recall", "f1_score", "macro_f1", "weighted_f1", "micro_f1")


class EvaluationError(ValueError):
    """The table cannot support the evaluation."""


# --- checks and split ---------------------------------------------------------


def class_counts(features: DataFrame, label: str, test_size: float = 0.25) -> dict[str, int]:
    """Rows per class, after the checks that a stratified split needs."""
    if label not in LABELS:
        raise EvaluationError(f"Unsupported label kind: {label}")
    found = features.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n")).limit(MOST_CLASSES + 1).collect()
    if len(found) > MOST_CLASSES:
        raise EvaluationError(f"{label} has more than {MOST_CLASSES} classes")
    counts = {r["label"]: r["n"] for r in found}
    if not counts:
        raise EvaluationError("there is no row; at least one is needed")
    if None in counts:
        raise EvaluationError("a label is missing; every feature row needs one")
    if len(counts) < 2:
        raise EvaluationError("all rows agree; a split needs two label classes")
    if min(counts.values()) < 2:
        raise EvaluationError("a label class has fewer than two samples")
    if not 0.0 < test_size < 1.0:
        raise EvaluationError("test_size lies outside (0, 1)")
    return counts


def test_quota(counts: dict[str, int], test_size: float) -> dict[str, int]:
    """Test rows per class: largest remainders for the training part, the rest is tested."""
    total = sum(counts.values())
    tested = -int(-(total * test_size) // 1)
    trained = total - tested
    if min(trained, tested) < len(counts):
        raise EvaluationError("Every class needs a place in both parts of the split.")
    share = {c: trained * n / total for c, n in counts.items()}
    quota = {c: int(s) for c, s in share.items()}
    for c in sorted(counts, key=lambda c: (quota[c] - share[c], c))[: trained - sum(quota.values())]:
        quota[c] += 1
    return {c: counts[c] - quota[c] for c in counts}


def stratified_split(features: DataFrame, label: str, test_size: float = 0.25, seed: int = 42,
                     key: str = "session_id") -> DataFrame:
    """Add ``test``: exactly the quota of each class, chosen by a hash of ``key``.

    The hash range is cut into slices; whole slices below the quota are test rows.
    Only the one slice of a class that straddles its quota is ranked, in a branch of
    its own that ends in one limit per class; the rows themselves are then decided by
    comparison alone, neither shuffled nor sorted.
    """
    counts = class_counts(features, label, test_size)
    quota = test_quota(counts, test_size)
    slices = 1 << 16
    drawn = features.withColumn("_h", F.xxhash64(F.lit(seed), F.col(key))).withColumn("_s", F.pmod("_h", F.lit(slices)))
    goal = F.element_at(F.create_map(*(F.lit(x) for c in sorted(quota) for x in (c, quota[c]))), F.col(label))
    sizes = drawn.groupBy(label, "_s").agg(F.count("*").alias("c"))  # at most classes x slices rows
    upto = F.sum("c").over(Window.partitionBy(label).orderBy("_s"))
    edge = (sizes.withColumn("_upto", upto).withColumn("_goal", goal).where("_upto >= _goal")
            .groupBy(label).agg(F.min(F.struct("_s", (F.col("_goal") - F.col("_upto") + F.col("c")).alias("_take"))).alias("e"))
            .select(label, F.col("e._s").alias("_cut"), F.col("e._take").alias("_take")))
    edge = cut_lineage(edge)  # one row per class
    straddling = drawn.select(label, "_s", "_h", F.col(key).alias("_k")).join(F.broadcast(edge), label).where("_s = _cut")
    rank = F.row_number().over(Window.partitionBy(label).orderBy("_h", "_k"))
    last = straddling.withColumn("_r", rank).where(F.col("_r") == F.col("_take")).select(
        label, F.struct("_h", F.col("_k").alias("_k")).alias("_last"))
    limits = cut_lineage(edge.drop("_take").join(last, label, "left"))
    marked = drawn.join(F.broadcast(limits), label)
    own = F.struct(F.col("_h").alias("_h"), F.col(key).alias("_k"))
    return marked.withColumn("test", F.when(F.col("_s") != F.col("_cut"), F.col("_s") < F.col("_cut"))
                             .otherwise(F.coalesce(own <= F.col("_last"), F.lit(False)))).drop("_h", "_s", "_cut", "_last")


# --- models -------------------------------------------------------------------


@dataclass
class FittedModel:
    """A fitted classifier together with its preparation and label order."""

    name: str
    model: object
    prepared: Preparation
    labels: tuple[str, ...]
    scaled: bool

    def vectors(self, frame: DataFrame, *keep: str) -> DataFrame:
        ready = (self.prepared.scaled if self.scaled else self.prepared.filled)(frame, *keep)
        return VectorAssembler(inputCols=list(self.prepared.columns), outputCol="features").transform(ready).select(
            *keep, "features")

    def predict(self, frame: DataFrame, *keep: str) -> DataFrame:
        """``keep`` columns and the ``predicted`` label."""
        return self.label_of(self.model.transform(self.vectors(frame, *keep)), *keep)

    def label_of(self, scored: DataFrame, *keep: str) -> DataFrame:
        names = F.array(*(F.lit(x) for x in self.labels))
        return scored.select(*keep, F.element_at(names, F.col("prediction").cast("int") + 1).alias("predicted"))


def _estimator(name: str, rows: int, seed: int):
    if name == "Logistic Regression":
        # sum-of-losses with C=1 equals mean loss with penalty 1/n
        return LogisticRegression(family="multinomial", maxIter=1000, elasticNetParam=0.0, regParam=1.0 / rows,
                                  standardization=False)
    if name == "Random Forest":
        return RandomForest(trees=100, seed=seed)
    return SoftmaxBoosting(stages=100, rate=0.1, depth=3)


def fit_model(train: DataFrame, name: str, label: str, features: tuple[str, ...] = FEATURES, impute: str = "median",
              seed: int = 42, prepared: Preparation | None = None, estimator=None, key: str = "session_id") -> FittedModel:
    if name not in MODELS and estimator is None:
        raise EvaluationError(f"Unknown model: {name}")
    prepared = prepared or fit_preparation(train, features, impute)
    sizes = {r[0]: r[1] for r in train.groupBy(label).count().collect()}  # one row per class
    labels = tuple(sorted(sizes))
    fitted = FittedModel(name, None, prepared, labels, name == "Logistic Regression")
    index = F.create_map(*(F.lit(x) for i, c in enumerate(labels) for x in (c, float(i))))
    # training passes over the rows hundreds of times: spread them evenly once, by a key that is unique
    parts = max(train.sparkSession.sparkContext.defaultParallelism, -(-sum(sizes.values()) // ROWS_PER_PARTITION))
    spread = train.repartition(parts, key) if key in train.columns else train
    row = key if key in spread.columns else label
    ready = fitted.vectors(spread, *dict.fromkeys((label, row))).select(
        "features", F.element_at(index, F.col(label)).alias("label"),
        (F.xxhash64(key) if key in spread.columns else F.xxhash64(F.monotonically_increasing_id())).alias("row"))
    ready = ready.persist()
    try:
        fitted.model = (estimator or _estimator(name, sum(sizes.values()), seed)).fit(ready)
    finally:
        ready.unpersist()
    return fitted


def predict_holdout(features: DataFrame, label: str, names: tuple[str, ...] = FEATURES, test_size: float = 0.25,
                    seed: int = 42, models: tuple[str, ...] = MODELS) -> DataFrame:
    """(model_name, session_id, actual, predicted) of the test rows for every model."""
    split = cut_lineage(stratified_split(features, label, test_size, seed))
    train, test = split.where("not test"), split.where("test").withColumn("actual", F.col(label))
    prepared = fit_preparation(train, names, "median")
    parts = []
    for name in models:
        fitted = fit_model(train, name, label, names, seed=seed, prepared=prepared)
        parts.append(fitted.predict(test, "session_id", "actual").withColumn("model_name", F.lit(name)))
    return reduce(DataFrame.unionByName, parts).select("model_name", "session_id", "actual", "predicted")


# --- metrics from predictions ---------------------------------------------------


def confusion(predictions: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(model_name, actual, predicted, n) over all label pairs, empty ones too.

    ``labels`` (column ``label``) names the classes; without it those seen are used.
    Predictions are read once; behind their counts there is one row that holds the
    cells, from which the whole grid is made.  More than ``MOST_CLASSES`` classes
    are an error, which bounds that row.
    """
    counts = predictions.where("model_name is not null").groupBy("model_name", "actual", "predicted").agg(F.count("*").alias("n"))
    if labels is not None:  # rows without a model name the classes
        named = labels.groupBy("label").agg(F.lit(0).cast("bigint").alias("n")).selectExpr(
            "cast(null as string) model_name", "label actual", "label predicted", "n")
        counts = counts.unionByName(named)
        names = "transform(filter(cells, c -> c.model_name is null), c -> c.actual)"
    else:
        names = "flatten(transform(cells, c -> array(c.actual, c.predicted)))"
    whole = counts.agg(F.collect_list(F.struct("model_name", "actual", "predicted", "n")).alias("cells")).selectExpr(
        "filter(cells, c -> c.model_name is not null and c.actual is not null and c.predicted is not null) cells",
        f"array_sort(array_distinct(filter({names}, x -> x is not null))) names")
    fits = f"case when size(names) > {MOST_CLASSES} then raise_error(concat('more than {MOST_CLASSES} classes: ', size(names))) else names end names"
    empty = ("flatten(transform(array_distinct(transform(cells, c -> c.model_name)), m -> flatten(transform(names, a -> transform(names, p ->"
             " named_struct('model_name', m, 'actual', a, 'predicted', p, 'n', 0L))))))")
    known = "filter(cells, c -> array_contains(names, c.actual) and array_contains(names, c.predicted))"
    return whole.selectExpr("cells", fits).selectExpr(f"inline(concat({known}, {empty}))").groupBy(
        "model_name", "actual", "predicted").agg(F.sum("n").alias("n"))


def class_report(matrix: DataFrame) -> DataFrame:
    """(model_name, label, precision, recall, f1_score, support, predicted_count) per class."""
    sums = matrix.selectExpr(
        "model_name",
        "inline(array(named_struct('label', actual, 's', n, 'p', 0L, 'h', if(actual = predicted, n, 0L)),"
        " named_struct('label', predicted, 's', 0L, 'p', n, 'h', 0L)))",
    ).groupBy("model_name", "label").agg(F.sum("s").alias("support"), F.sum("p").alias("predicted_count"),
                                         F.sum("h").alias("hits"))
    return sums.selectExpr(
        "model_name", "label",
        "case when predicted_count > 0 then hits / predicted_count else 0.0D end precision",
        "case when support > 0 then hits / support else 0.0D end recall",
        "case when support + predicted_count > 0 then 2.0D * hits / (support + predicted_count) else 0.0D end f1_score",
        "support", "predicted_count", "hits")


def report_averages(report: DataFrame) -> DataFrame:
    """The accuracy, macro and weighted rows of the per-class report (over all classes)."""
    rows = report.groupBy("model_name").agg(*(F.expr(e) for e in (
        "sum(hits) / sum(support) acc", "avg(precision) mp", "avg(recall) mr", "avg(f1_score) mf",
        "sum(precision * support) / sum(support) wp", "sum(recall * support) / sum(support) wr",
        "sum(f1_score * support) / sum(support) wf", "sum(support) support")))
    return rows.selectExpr("model_name", "inline(array("
                           "named_struct('label', 'accuracy', 'precision', acc, 'recall', acc, 'f1_score', acc, 'support', support),"
                           "named_struct('label', 'macro avg', 'precision', mp, 'recall', mr, 'f1_score', mf, 'support', support),"
                           "named_struct('label', 'weighted avg', 'precision', wp, 'recall', wr, 'f1_score', wf, 'support', support)))")


def model_metrics(report: DataFrame) -> DataFrame:
    """The seven metrics per model; macro F1 is over classes that occur as actual or predicted."""
    whole = report.groupBy("model_name").agg(*(F.expr(e) for e in (
        "sum(hits) / sum(support) accuracy", "sum(precision * support) / sum(support) precision",
        "sum(recall * support) / sum(support) recall", "sum(f1_score * support) / sum(support) f1_score",
        "avg(f1_score) filter (where support + predicted_count > 0) macro_f1",
        "sum(f1_score * support) / sum(support) weighted_f1", "sum(hits) / sum(support) micro_f1",
        "sum(support) test_size")))
    return whole


def rank_models(metrics: DataFrame) -> DataFrame:
    """Best first: macro F1 descending, then name (one row per model)."""
    order = Window.orderBy(F.desc("macro_f1"), "model_name")
    return metrics.withColumn("rank", F.row_number().over(order).cast("bigint"))


def best_model(metrics: DataFrame, features: tuple[str, ...] = FEATURES, label: str = "failure_category") -> DataFrame:
    names = ", ".join(f"'{f}'" for f in features)
    return rank_models(metrics).where("rank = 1").selectExpr(
        "model_name", "macro_f1", f"array({names}) feature_names", f"'{label}' label_kind")


def evaluate(features: DataFrame, label: str = "failure_category", names: tuple[str, ...] = FEATURES,
             test_size: float = 0.25, seed: int = 42, models: tuple[str, ...] = MODELS) -> dict[str, DataFrame]:
    """Train and compare the classifiers; returns the report tables by name."""
    total = features.count()
    predictions = cut_lineage(predict_holdout(features, label, names, test_size, seed, models))
    matrix = confusion(predictions, features.selectExpr(f"{label} label"))
    report = class_report(matrix)
    metrics = rank_models(model_metrics(report)).withColumn("train_size", F.lit(total) - F.col("test_size"))
    return {"predictions": predictions, "confusion": matrix, "class_report": report,
            "averages": report_averages(report), "metrics": metrics,
            "best_model": best_model(metrics.drop("rank"), names, label)}
