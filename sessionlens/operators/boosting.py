"""Gradient boosting of many classes: one softmax model, K trees per stage.

Every stage fits one tree of ``depth`` levels per class to the residuals
``[class] - probability``.  The K trees grow together: one job per level adds up
a histogram (class x node x feature x bin) of residuals, weights and counts in
each task, one row per class and node leaves a task, and groups of these rows
pick the best split.  Only the splits, at most classes x 2^level rows, reach the
driver, and leaf values come from the sums of the last level, so a stage costs
``depth`` jobs whatever the number of classes.

Rows are kept as blocks: feature bins in one byte each, class and scores.  The
scores follow the trees inside the tasks and are written anew every
``REFRESH`` stages, which bounds what a lost executor costs.  Nothing random is
drawn.  Two classes are the same model with mirrored trees, which is logistic
boosting.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame, functions as F

from sessionlens.session import cut_lineage

BINS = 64
REFRESH = 10
TASK_ROWS = 1 << 14  # rows that a task adds up; fewer are not worth a task of their own, hundreds of times
BLOCK = "bins binary, label binary, scores binary"
SPLIT = "cls int, node int, feature int, cut int, gain double, ls double, lw double, rs double, rw double"


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bin b of a feature holds the values above its b-1st and up to its b-th cut."""
    return np.stack([np.searchsorted(c, x[:, i], "left") for i, c in enumerate(cuts)], 1).astype(np.uint8) if len(cuts) else np.zeros((len(x), 0), np.uint8)


class Tree:
    """A complete tree: splits level by level, then leaf values; feature -1 sends all rows to the left."""

    def __init__(self, depth: int):
        self.feature = np.full(2 ** depth - 1, -1)
        self.cut = np.zeros(2 ** depth - 1, int)
        self.value = np.zeros(2 ** depth)

    def nodes(self, bins: np.ndarray, level: int) -> np.ndarray:
        """The node of each row among those of ``level``."""
        at, every = np.zeros(len(bins), int), np.arange(len(bins))
        for _ in range(level):
            feature = self.feature[at]
            at = 2 * at + 1 + ((feature >= 0) & (bins[every, feature] > self.cut[at]))
        return at - (2 ** level - 1)


def add_trees(scores: np.ndarray, bins: np.ndarray, stages: list[list[Tree]], depth: int) -> np.ndarray:
    for trees in stages:
        for k, tree in enumerate(trees):
            scores[:, k] += tree.value[tree.nodes(bins, depth)]
    return scores


def residuals(scores: np.ndarray, label: np.ndarray) -> np.ndarray:
    p = np.exp(scores - scores.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    out = -p
    out[np.arange(len(label)), label] += 1.0
    return out


def histogram(bins: np.ndarray, node: np.ndarray, nodes: int, r: np.ndarray) -> np.ndarray:
    """Sums of residual, weight and count: nodes x 3 x features x bins."""
    d = bins.shape[1]
    codes = ((node[:, None] * d + np.arange(d)) * BINS + bins).ravel()
    size = nodes * d * BINS
    absolute = np.abs(r)
    sums = [np.bincount(codes, w, size) for w in (np.repeat(r, d), np.repeat(absolute * (1 - absolute), d), None)]
    return np.stack([s.reshape(nodes, d, BINS).astype(float) for s in sums], 1)


def best_split(h: np.ndarray) -> tuple:
    """(feature, cut, gain, sums and weights of both sides) of one node's histogram; feature -1 leaves it whole."""
    total = h[:, 0].sum(1)
    left = h.cumsum(2)[:, :, :-1]
    right = total[:, None, None] - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[2] * right[2] / total[2] * (left[0] / left[2] - right[0] / right[2]) ** 2
    gain = np.where((left[2] > 0.5) & (right[2] > 0.5), gain, 0.0)
    feature, cut = np.unravel_index(int(gain.argmax()), gain.shape)
    if gain[feature, cut] <= 1e-10 * max(1.0, total[2]):
        return -1, 0, 0.0, total[0], total[1], 0.0, 0.0
    return (int(feature), int(cut), float(gain[feature, cut]), left[0][feature, cut], left[1][feature, cut],
            right[0][feature, cut], right[1][feature, cut])


class SoftmaxBoosting:
    """An estimator over (features, label): ``fit`` gives a :class:`BoostedTrees`."""

    def __init__(self, stages: int = 100, rate: float = 0.1, depth: int = 3):
        if stages < 1 or not 0 < rate or not 1 <= depth <= 8:
            raise ValueError("stages and rate must be positive, depth 1 to 8")
        self.stages, self.rate, self.depth = stages, rate, depth

    def fit(self, ready: DataFrame) -> "BoostedTrees":
        rows = ready.select(vector_to_array("features").alias("x"), F.col("label").cast("int").alias("label"))
        counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}  # one row per class
        if not counts:
            raise ValueError("there is no row to learn from")
        k = max(counts) + 1
        prior = np.log(np.array([max(counts.get(i, 0), 1e-9) for i in range(k)]) / sum(counts.values()))
        cuts = self._cuts(rows)
        d = len(cuts)
        depth, rate = self.depth, self.rate

        def blocked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    bins = binned(np.vstack(b["x"].to_numpy()), cuts)
                    yield pd.DataFrame({"bins": [bins.tobytes()], "label": [b["label"].to_numpy().astype(np.int32).tobytes()],
                                        "scores": [np.tile(prior, (len(b), 1)).tobytes()]})

        def opened(b: pd.DataFrame, pending: list[list[Tree]]) -> Iterator[tuple]:
            for bins, label, scores in zip(b["bins"], b["label"], b["scores"]):
                label = np.frombuffer(label, np.int32)
                bins = np.frombuffer(bins, np.uint8).reshape(len(label), d)
                yield bins, label, add_trees(np.frombuffer(scores).reshape(len(label), k).copy(), bins, pending, depth)

        def level_splits(blocks: DataFrame, pending: list[list[Tree]], trees: list[Tree], level: int) -> list:
            nodes = 2 ** level

            def count(batches):
                sums = np.zeros((k, nodes, 3, d, BINS))
                for b in batches:
                    for bins, label, scores in opened(b, pending):
                        r = residuals(scores, label)
                        for c in range(k):
                            sums[c] += histogram(bins, trees[c].nodes(bins, level), nodes, r[:, c])
                if sums.any():
                    yield pd.DataFrame([(c, n, sums[c, n].tobytes()) for c in range(k) for n in range(nodes) if sums[c, n, 2].any()],
                                       columns=["cls", "node", "h"])

            def choose(batches):
                sums: dict[tuple, np.ndarray] = {}
                for b in batches:
                    for c, n, h in zip(b["cls"], b["node"], b["h"]):
                        sums[c, n] = sums.get((c, n), 0.0) + np.frombuffer(h).reshape(3, d, BINS)
                yield pd.DataFrame([(*key, *best_split(h)) for key, h in sums.items()], columns=[c.split()[0] for c in SPLIT.split(", ")])

            parts = blocks.mapInPandas(count, "cls int, node int, h binary")
            return parts.repartition("cls", "node").mapInPandas(choose, SPLIT).collect()  # classes x 2^level rows

        def rescored(pending):
            def run(batches):
                for b in batches:
                    yield b.assign(scores=[s.tobytes() for _, _, s in opened(b, pending)])
            return run

        tasks = -(-sum(counts.values()) // TASK_ROWS)
        blocks = cut_lineage(rows.coalesce(tasks).mapInPandas(blocked, BLOCK))
        done: list[list[Tree]] = []
        gains = np.zeros(max(d, 1))
        pending: list[list[Tree]] = []
        for stage in range(self.stages if d and k > 1 else 0):
            trees = [Tree(depth) for _ in range(k)]
            own = np.zeros((k, d))
            for level in range(depth):
                for s in level_splits(blocks, pending, trees, level):
                    tree, at = trees[s["cls"]], 2 ** level - 1 + s["node"]
                    tree.feature[at], tree.cut[at] = s["feature"], s["cut"]
                    if s["feature"] >= 0:
                        own[s["cls"], s["feature"]] += s["gain"]
                    if level == depth - 1:
                        for side, total, weight in ((0, s["ls"], s["lw"]), (1, s["rs"], s["rw"])):
                            tree.value[2 * s["node"] + side] = rate * (k - 1) / k * total / weight if abs(weight) > 1e-150 else 0.0
            grown = own.sum(1)
            gains += (own[grown > 0] / grown[grown > 0, None]).sum(0)
            done.append(trees)
            pending.append(trees)
            if len(pending) == REFRESH and stage + 1 < self.stages:
                blocks, pending = cut_lineage(blocks.mapInPandas(rescored(pending), BLOCK)), []
        return BoostedTrees(prior, cuts, done, depth, gains)

    @staticmethod
    def _cuts(rows: DataFrame) -> list[np.ndarray]:
        """Up to BINS - 1 distinct quantiles per feature."""
        d = len(rows.select("x").first()["x"])
        shares = F.array(*(F.lit(i / BINS) for i in range(1, BINS)))
        row = rows.agg(*(F.percentile_approx(F.col("x")[i], shares, 10_000).alias(f"c{i}") for i in range(d))).first()
        return [np.unique(np.array(row[f"c{i}"], float)) for i in range(d)]


class BoostedTrees:
    """The fitted model; ``transform`` adds ``prediction``."""

    def __init__(self, prior: np.ndarray, cuts: list[np.ndarray], stages: list[list[Tree]], depth: int, gains: np.ndarray):
        self.prior, self.cuts, self.stages, self.depth = prior, cuts, stages, depth
        self.featureImportances = DenseVector(gains / gains.sum() if gains.sum() > 0 else gains)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return add_trees(np.tile(self.prior, (len(x), 1)), binned(x, self.cuts), self.stages, self.depth)

    def transform(self, frame: DataFrame) -> DataFrame:
        model = frame.sparkSession.sparkContext.broadcast((self.prior, self.cuts, self.stages, self.depth))

        @F.pandas_udf("double")
        def predict(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=float)
            prior, cuts, stages, depth = model.value
            values = np.vstack(x.to_numpy())
            scores = add_trees(np.tile(prior, (len(values), 1)), binned(values, cuts), stages, depth)
            return pd.Series(scores.argmax(1).astype(float))

        return frame.withColumn("prediction", predict(vector_to_array("features")))
