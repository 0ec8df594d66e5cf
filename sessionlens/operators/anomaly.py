"""Outliers (isolation forest), clusters (DBSCAN) and unknown-failure candidates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from sessionlens.functions.stats import exact_quantile, fit_preparation
from sessionlens.operators.clusters import dbscan
from sessionlens.operators.tiles import matrix
from sessionlens.schema import FEATURES
from sessionlens.session import cut_lineage

TREES = 100
SAMPLE = 256
EULER = 0.5772156649015329
TOP = np.uint64(1 << 63)  # flips unsigned hashes to signed ones of the same order


class AnomalyError(ValueError):
    """The table or a parameter does not allow the analysis."""


# --- isolation forest -----------------------------------------------------------


def _mean_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3.0)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, 2.0 * (np.log(big - 1) + EULER) - 2.0 * (big - 1) / big))


def _grow(sample: np.ndarray, random: np.random.Generator) -> dict[str, list]:
    """One random tree: a feature that still varies, cut at a uniform point of its range."""
    limit = math.ceil(math.log2(max(len(sample), 2)))
    nodes: dict[str, list] = {"feature": [], "cut": [], "left": [], "right": [], "depth": []}
    stack = [(np.arange(len(sample)), 0, -1, "left")]
    while stack:
        rows, depth, parent, side = stack.pop()
        at = len(nodes["feature"])
        if parent >= 0:
            nodes[side][parent] = at
        part = sample[rows]
        varied = np.nonzero(part.max(0) > part.min(0))[0]
        split = depth < limit and len(varied) > 0
        feature = int(random.choice(varied)) if split else -1
        cut = float(random.uniform(part[:, feature].min(), part[:, feature].max())) if split else 0.0
        for name, value in (("feature", feature), ("cut", cut), ("left", -1), ("right", -1),
                            ("depth", depth + (0.0 if split else float(_mean_path(len(rows)))))):
            nodes[name].append(value)
        if split:
            below = part[:, feature] <= cut
            stack.append((rows[~below], depth + 1, at, "right"))
            stack.append((rows[below], depth + 1, at, "left"))
    return nodes


def _tree_hash(base: np.ndarray, tree: int) -> np.ndarray:
    """A hash of its own per tree from one hash per row."""
    with np.errstate(over="ignore"):
        h = base.astype(np.int64).view(np.uint64) + np.uint64(tree + 1) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _smallest(rows: pd.DataFrame, size: int) -> pd.DataFrame:
    """The ``size`` rows of each tree with the smallest hashes, in their order."""
    return rows.sort_values(["tree", "h", "key"], kind="stable").groupby("tree", sort=False).head(size)


def draw_samples(points: DataFrame, count: int, seed: int = 42, trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """Rows (tree, h, key, vec): for every tree its own uniform sample of the whole table, without replacement.

    Each tree ranks all rows by a hash of its own and takes the ``sample``
    smallest.  One pass draws for all trees: a row enters those whose bound lies
    above its hash, and a task keeps ``sample`` rows per tree at most, so about
    trees x sample rows are shuffled whatever the size of the table.  Should a
    bound leave some tree short, which is rare, the bound is raised and the pass
    repeated; the rows drawn depend neither on the bound nor on partitions.
    """
    size = min(sample, count)
    hashed = points.select(F.xxhash64(F.lit(seed), "key").alias("base"), "key", "vec")
    schema = T.StructType([T.StructField("tree", T.IntegerType()), T.StructField("h", T.LongType()), *points.select("key", "vec").schema.fields])
    share = (1.3 * size + 100) / max(count, 1)
    while True:
        bound = 2 ** 64 - 1 if share >= 1 else int(share * 2 ** 64)

        def enter(batches: Iterator[pd.DataFrame], bound=np.uint64(bound)) -> Iterator[pd.DataFrame]:
            held = None
            for batch in batches:
                base = batch["base"].to_numpy()
                for first in range(0, len(batch), 4096):
                    found = []
                    part = base[first:first + 4096]
                    for tree in range(trees):
                        h = _tree_hash(part, tree)
                        at = np.flatnonzero(h <= bound)
                        if len(at):
                            rows = batch.iloc[at + first][["key", "vec"]]
                            found.append(rows.assign(tree=tree, h=(h[at] ^ TOP).view(np.int64)))
                    held = pd.concat(([held] if held is not None else []) + found) if found else held
                    if held is not None and len(held) > 2 * trees * size:
                        held = _smallest(held, size)
            if held is not None:
                held = _smallest(held, size)
                yield held[["tree", "h", "key", "vec"]]

        entered = hashed.mapInPandas(enter, schema)
        rank = F.row_number().over(Window.partitionBy("tree").orderBy("h", "key"))
        drawn = cut_lineage(entered.withColumn("_r", rank).where(F.col("_r") <= size).drop("_r"))
        got = drawn.groupBy("tree").count().agg(F.count("*").alias("trees"), F.min("count").alias("least")).first()
        if share >= 1 or (got["trees"] == trees and got["least"] == size):
            return drawn
        share *= 4


def isolation_scores(points: DataFrame, seed: int = 42, trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """Add ``anomaly_score`` (near 1 is isolated) to ``points`` (key, vec).

    Every tree is grown in its own group from its own sample of the whole table; the
    forest (at most trees x 511 nodes) is broadcast and scores are computed in batches.
    """
    count = points.count()
    per_tree = min(sample, count)
    drawn = draw_samples(points, count, seed, trees, sample)

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        tree = int(group["tree"].iloc[0])
        nodes = _grow(matrix(group.sort_values(["h", "key"])["vec"]), np.random.default_rng([seed, tree]))
        return pd.DataFrame({"tree": [tree], **{k: [v] for k, v in nodes.items()}})

    grown = drawn.groupBy("tree").applyInPandas(
        grow, "tree int, feature array<int>, cut array<double>, left array<int>, right array<int>, depth array<double>")
    forest = [{k: np.asarray(r[k]) for k in ("feature", "cut", "left", "right", "depth")}
              for r in grown.orderBy("tree").collect()]  # one row per tree
    shared = points.sparkSession.sparkContext.broadcast(forest)
    unit = float(_mean_path(per_tree)) or 1.0

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vec in batches:
            x = matrix(vec)
            depth, every = np.zeros(len(x)), np.arange(len(x))
            for tree in shared.value:
                at = np.zeros(len(x), dtype=int)
                active = every[tree["feature"][at] >= 0]
                while len(active):
                    here = at[active]
                    goes_left = x[active, tree["feature"][here]] <= tree["cut"][here]
                    at[active] = np.where(goes_left, tree["left"][here], tree["right"][here])
                    active = active[tree["feature"][at[active]] >= 0]
                depth += tree["depth"][at]
            yield pd.Series(2.0 ** (-depth / (len(shared.value) * unit)))

    return points.withColumn("anomaly_score", score("vec"))


# --- report ---------------------------------------------------------------------


def analyze_anomalies(features: DataFrame, names: tuple[str, ...] = FEATURES, contamination: float = 0.1,
                      eps: float = 0.8, min_samples: int = 5, seed: int = 42, order: str | None = None,
                      **tiling) -> DataFrame:
    """Score, flag, cluster and unknown-failure mark of every row.

    Columns: session_id, anomaly_score, is_anomaly, cluster_id, is_noise,
    is_unknown_failure.  ``order`` is the row order that numbers clusters
    (default: row_id where there is one, else session_id).
    """
    if not 0.0 < contamination <= 0.5:
        raise AnomalyError("contamination must be in the interval (0, 0.5].")
    missing = [n for n in names if n not in features.columns]
    if missing or "session_id" not in features.columns:
        raise AnomalyError(f"Feature dimensions do not match metadata: {missing or 'session_id'}")
    spark = features.sparkSession
    if features.isEmpty():
        return spark.createDataFrame([], "session_id string, anomaly_score double, is_anomaly boolean,"
                                         " cluster_id bigint, is_noise boolean, is_unknown_failure boolean")
    order = order or ("row_id" if "row_id" in features.columns else "session_id")
    prepared = fit_preparation(features, names, "median")
    vectors = prepared.scaled(features.withColumn("_ord", F.col(order)), "session_id", "_ord").select(
        "session_id", F.col("_ord").alias("ord"), F.concat_ws(":", "session_id", "_ord").alias("key"),
        F.array(*(F.col(c) + 0.0 for c in prepared.columns)).alias("vec"))
    vectors = cut_lineage(vectors)
    scored = cut_lineage(isolation_scores(vectors, seed))
    limit = exact_quantile(scored, "anomaly_score", 1.0 - contamination)
    clustered = dbscan(scored, eps, min_samples, **tiling)
    return finish_records(clustered.withColumn("is_anomaly", F.col("anomaly_score") > F.lit(limit)))


def finish_records(clustered: DataFrame) -> DataFrame:
    """Noise and unknown-failure marks from flags and cluster ids."""
    sizes = clustered.groupBy("cluster_id").agg(F.count("*").alias("size")).where("size <= 1").select(
        "cluster_id", F.lit(True).alias("alone"))
    return clustered.join(sizes, "cluster_id", "left").selectExpr(
        "session_id", "anomaly_score", "is_anomaly", "cluster_id", "cluster_id = -1 is_noise",
        "is_anomaly or cluster_id = -1 or coalesce(alone, false) is_unknown_failure")


def cluster_statistics(records: DataFrame) -> DataFrame:
    return records.groupBy("cluster_id").agg(F.count("*").alias("session_count")).selectExpr(
        "cluster_id", "session_count", "cluster_id = -1 is_noise")


def anomaly_totals(records: DataFrame) -> DataFrame:
    return records.selectExpr("count_if(is_anomaly) anomaly_count", "count_if(is_noise) noise_point_count",
                              "count_if(is_unknown_failure) unknown_failure_count",
                              "count(distinct case when not is_noise then cluster_id end) cluster_count")
