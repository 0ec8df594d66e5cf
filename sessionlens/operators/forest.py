"""Random forest without a depth limit: a distributed top, subtrees finished in single tasks.

A node whose rows fit a task is shipped: blocks send its rows, packed, to one task
per tree and node, which grows the rest of the tree on the raw values, exactly and
to any depth.  Larger nodes are split first, level by level, from histograms
(node x feature x bin x class) that tasks add up and groups choose from; a job takes
as many nodes as its histograms fit ``HISTOGRAM_BYTES``.  Only the splits of the top
reach the driver, about trees x rows / ``task_rows`` of them.

Each row has a Poisson(1) weight per tree, drawn by a hash of its key: a bootstrap
that needs no second pass and does not depend on partitions.  A node looks at
sqrt(features) drawn features, and at further ones only until one can be split.
The prediction is the class with the largest mean share over the leaves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame, functions as F

from sessionlens.operators.boosting import BINS, SoftmaxBoosting, binned
from sessionlens.session import cut_lineage

TASK_ROWS = 1 << 16  # rows of a node that one task finishes
HISTOGRAM_BYTES = 64 << 20
BROADCAST_BYTES = 128 << 20  # a larger forest is brought to the rows by a shuffle
TOGETHER_ROWS = 1 << 19  # rows of the nodes that a task grows side by side
STEP_ROWS = 1 << 14  # rows that a step looks at, unless one node has more
DRAWN = 64  # orders of features drawn at once
INFINITE = 0xFF800000  # keys above it are no numbers
WALK_ROWS = 1 << 15  # rows that meet a copy of their subtree in one task
#: Poisson(1): chance of at most 0, 1, 2 ... copies
COPIES = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(18)])
NODES = "feature array<int>, cut array<double>, left array<int>, right array<int>, share array<double>"


def weights(row: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is in the sample of a tree."""
    with np.errstate(over="ignore"):
        h = row.view(np.uint64) ^ np.uint64((seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h = h ^ (h >> np.uint64(31))
    return np.searchsorted(COPIES, (h >> np.uint64(11)) / float(1 << 53), "right")


def gini_gain(left: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Weighted decrease of the Gini impurity; class counts are in the last axis.  Splits with an empty side gain nothing."""
    right = total - left
    n_left, n_right, n = left.sum(-1), right.sum(-1), total.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (left ** 2).sum(-1) / n_left + (right ** 2).sum(-1) / n_right - (total ** 2).sum() / n
    return np.where((n_left > 0) & (n_right > 0), gain, -1.0)


def ordered(x: np.ndarray) -> np.ndarray:
    """Whole numbers that sort as the float32 values do; what is no number comes last."""
    x = np.where(np.isnan(x), np.float32(np.nan), np.asarray(x, np.float32) + np.float32(0))
    bits = x.view(np.uint32)
    return np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31))


def value_of(key: np.ndarray) -> np.ndarray:
    """The values behind :func:`ordered`."""
    return np.where(key >> 31, key & np.uint32(0x7FFFFFFF), ~key).view(np.float32).astype(float)


class Grower:
    """Whole trees on raw values, grown side by side: a step splits the next node of every tree.

    A tree takes its nodes from the left, parents first, and each mixed node draws the
    next order of features from the tree's own random numbers, so what grows beside a
    tree does not change it.  Nodes of one table are runs of ``order``; a tree of r rows
    has room for 2 r nodes (feature -1 is a leaf).
    """

    def __init__(self, groups: list[tuple], classes: int, randoms: list[np.random.Generator]):
        """``groups``: (values, label, weight) of each tree; the list is emptied."""
        sizes = np.array([len(label) for _, label, _ in groups])
        n, self.d, self.classes, self.randoms = int(sizes.sum()), groups[0][0].shape[1], classes, randoms
        self.few = max(1, int(math.sqrt(self.d)))
        self.base = 2 * (sizes.cumsum() - sizes)
        self.used = np.ones(len(sizes), int)
        self.flat, label, weight = np.empty(n * self.d, np.uint32), np.empty(n, np.int32), np.empty(n, np.int32)
        self.total = np.zeros((2 * n, classes), np.int32)
        groups.reverse()
        for node, size in zip(self.base.tolist(), sizes.tolist()):
            at = node // 2
            x, label[at:at + size], weight[at:at + size] = groups.pop()
            self.flat[at * self.d:(at + size) * self.d] = ordered(x).ravel()
            self.total[node] = np.bincount(label[at:at + size], weight[at:at + size], classes)
        self.gaps = self.flat.max() > INFINITE
        self.label_bits = classes.bit_length()
        self.tail = self.label_bits + int(weight.max()).bit_length()
        self.cell = (weight << self.label_bits) + label
        self.order = np.arange(n, dtype=np.int32)
        self.feature, self.left, self.next = (np.full(2 * n, -1, np.int32) for _ in range(3))
        self.begin, self.size = np.zeros(2 * n, np.int32), np.zeros(2 * n, np.int32)
        self.low, self.high = np.zeros(2 * n, np.uint32), np.zeros(2 * n, np.uint32)
        self.gains = np.zeros((len(sizes), self.d))
        self.parts = -(-self.d // self.few)
        self.drawn, self.part = np.zeros((len(sizes), DRAWN, self.parts, self.few), np.int32), np.zeros(len(sizes), int)
        self.draws = np.full(len(sizes), DRAWN)
        self.begin[self.base], self.size[self.base] = self.base // 2, sizes
        self.now = np.where((self.total[self.base] > 0).sum(1) > 1, self.base, -1)  # the next mixed node of each tree

    def run(self) -> None:
        while len(who := np.flatnonzero(self.now >= 0)):
            large = who[self.size[self.now[who]] > STEP_ROWS // len(who)]
            self._split(large[:1] if len(large) else who)

    def _split(self, who: np.ndarray) -> None:
        """Split the next nodes of the trees ``who``; one that its first features cannot part waits for the next step with further ones."""
        for g in who[self.draws[who] == DRAWN].tolist():  # the same as one permutation after the other
            order = self.randoms[g].permuted(np.tile(np.arange(self.d), (DRAWN, 1)), axis=1)
            self.drawn[g] = np.pad(order, ((0, 0), (0, self.parts * self.few - self.d)), mode="edge").reshape(DRAWN, self.parts, self.few)
            self.draws[g] = 0
        node, drawn = self.now[who], self.drawn[who, self.draws[who], self.part[who]]
        found = self._best(who, node, drawn)
        if not found.all():
            late, node = who[~found], node[~found]
            some = self._first_part(late, node)
            self.part[late] = some
            self.now[late[some < 0]] = self.next[node[some < 0]]  # equal in all features: a leaf
            found[~found] = some < 0
        self.draws[who[found]] += 1
        self.part[who[found]] = 0

    def _first_part(self, who: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Which part of the features drawn is the first to hold one that parts the rows; -1 for none."""
        size = self.size[node]
        start = size.cumsum() - size
        key = self.flat.reshape(-1, self.d)[self.order[(self.begin[node] - start).repeat(size) + np.arange(size.sum())]]
        low = np.minimum.reduceat(key, start)
        high = np.maximum.reduceat(np.where(key > INFINITE, 0, key) if self.gaps else key, start)
        able = np.take_along_axis(high > low, self.drawn[who, self.draws[who]].reshape(len(who), -1).astype(np.int64), 1)
        able = able.reshape(len(who), self.parts, self.few).any(2)
        return np.where(able.any(1), able.argmax(1), -1)

    def _best(self, who: np.ndarray, node: np.ndarray, drawn: np.ndarray) -> np.ndarray:
        """Split those nodes that a drawn feature can part, at the best place; which they are."""
        begin, size, total = self.begin[node], self.size[node], self.total[node].astype(np.int64)
        end, alone = size.cumsum(), len(who) == 1
        n = int(end[-1])
        of = np.zeros(1, np.int64) if alone else np.arange(len(who)).repeat(size)
        place = (begin - end + size)[of] + np.arange(n)
        rows = self.order[place]
        start = rows * np.int64(self.d)
        # a row per feature: node, value, weight and label in one number
        packed = self.flat[start + drawn.T[:, of]].astype(np.int64)
        packed <<= self.tail
        packed += (of << (32 + self.tail)) + self.cell[rows]
        packed.sort(1)
        value = packed >> self.tail  # and node
        parts = np.zeros(packed.shape, bool)
        np.greater(value[:, 1:], value[:, :-1], out=parts[:, :-1])
        if self.gaps:
            parts[:, :-1] &= (value[:, 1:] & 0xFFFFFFFF) <= INFINITE
        parts[:, end - 1] = False
        i = parts.T.ravel().nonzero()[0]  # by rows below, then in the order drawn
        split = np.zeros(len(who), bool)
        if not len(i):
            return split
        at = i // len(parts)
        f = i - at * len(parts)
        s = of if alone else of[at]
        i = at + f * n
        packed &= (1 << self.tail) - 1
        label, weight = packed & ((1 << self.label_bits) - 1), packed >> self.label_bits
        # counts of several classes share a number; own: rows of the same class so far
        bits = int(total.max()).bit_length()
        ones, many = (1 << bits) - 1, 63 // bits
        counts = []
        for k in range(0, self.classes, many):
            shift, add = label * bits, weight
            if self.classes > many:
                here = (label >= k) & (label < k + many)
                shift, add = np.where(here, (label - k) * bits, 0), np.where(here, weight, 0)
            whole = (total[:, k:k + many] << (np.arange(min(many, self.classes - k)) * bits)).sum(1)
            below = (add << shift).cumsum(1)
            below -= (whole.cumsum() - whole)[of]
            found = (below >> shift) & ones
            own = np.where(here, found, own) if k else found
            counts.append(below.ravel())
        weights, squares = total.sum(1), (total * total).sum(1)
        before = (squares.cumsum() - squares)[s]
        n_below = weight.cumsum(1).ravel()[i] - (weights.cumsum() - weights)[s]
        square_below = (weight * (2 * own - weight)).cumsum(1).ravel()[i] - before
        crossed = (weight * total.ravel()[label + of * self.classes]).cumsum(1).ravel()[i] - before
        gain = square_below / n_below + (squares[s] - 2 * crossed + square_below) / (weights[s] - n_below) - (squares / weights)[s]
        if alone:
            hit = gain.argmax()[None]
        else:
            new = np.concatenate(([True], s[1:] > s[:-1])).nonzero()[0]
            most = np.maximum.reduceat(gain, new).repeat(np.concatenate((new[1:], [len(s)])) - new)
            hit = (gain == most).nonzero()[0]
            s = s[hit]
            first = np.concatenate(([True], s[1:] > s[:-1]))
            hit, s = hit[first], s[first]
        f, at = f[hit], i[hit]
        low, high = value.ravel()[at] & 0xFFFFFFFF, value.ravel()[at + 1] & 0xFFFFFFFF
        left_rows = at - f * n - (end - size)[s] + 1
        feature = drawn[s, f]
        below = np.hstack([(c[at, None] >> (np.arange(min(many, self.classes - j * many)) * bits)) & ones for j, c in enumerate(counts)])
        split[s] = True
        to, goal = np.zeros(len(who), np.int64), np.full(len(who), 1 << 32)
        to[s], goal[s] = feature, low
        above = self.flat[start + to[of]] > goal[of]
        self.order[place] = np.concatenate((rows[~above], rows[above])) if alone else rows[(2 * of + above).astype(np.uint16).argsort(kind="stable")]
        who, node = who[s], node[s]
        self.gains[who, feature] += np.maximum(gain[hit], 0.0)
        self.feature[node], self.low[node], self.high[node] = feature, low, high
        self.left[node] = self.used[who]
        left = self.base[who] + self.used[who]
        right = left + 1
        self.used[who] += 2
        self.total[left], self.total[right] = below, self.total[node] - below
        self.begin[left], self.begin[right] = self.begin[node], self.begin[node] + left_rows
        self.size[left], self.size[right] = left_rows, self.size[node] - left_rows
        mixed_left, mixed_right = ((self.total[c] > 0).sum(1) > 1 for c in (left, right))
        after = self.next[node]
        self.next[right] = after
        self.next[left] = np.where(mixed_right, right, after)
        self.now[who] = np.where(mixed_left, left, np.where(mixed_right, right, after))
        return split

    def tree(self, g: int) -> tuple[dict, np.ndarray]:
        """The nodes of a tree in arrays and the gain per feature."""
        room = slice(self.base[g], self.base[g] + self.used[g])
        low, high, left, total = value_of(self.low[room]), value_of(self.high[room]), self.left[room], self.total[room]
        with np.errstate(invalid="ignore"):
            middle = low + (high - low) / 2
        return {"feature": self.feature[room], "cut": np.where((low <= middle) & (middle < high), middle, low), "left": left,
                "right": np.where(left < 0, left, left + 1), "share": total / total.sum(1, keepdims=True)}, self.gains[g]


def grow(x: np.ndarray, label: np.ndarray, weight: np.ndarray, classes: int, random: np.random.Generator) -> tuple[dict, np.ndarray]:
    """A whole tree on raw values (float32): nodes in arrays (feature -1 is a leaf) and the gain per feature."""
    grower = Grower([(x, label, weight)], classes, [random])
    grower.run()
    return grower.tree(0)


class Top:
    """The split nodes of a tree above its shipped ones."""

    def __init__(self):
        self.feature, self.cut, self.value, self.left, self.right = [-1], [0], [0.0], [-1], [-1]
        self.share: dict[int, np.ndarray] = {}  # leaves
        self.shipped: set[int] = set()

    def split(self, node: int, feature: int, cut: int, value: float) -> tuple[int, int]:
        at = len(self.feature)
        self.feature[node], self.cut[node], self.value[node], self.left[node], self.right[node] = feature, cut, value, at, at + 1
        for column, blank in ((self.feature, -1), (self.cut, 0), (self.value, 0.0), (self.left, -1), (self.right, -1)):
            column += [blank, blank]
        return at, at + 1


def descend(columns: tuple, x: np.ndarray) -> np.ndarray:
    """The end node of each row: ``columns`` are feature, cut, left and right; rows up to the cut go left."""
    feature, cut, left, right = map(np.asarray, columns)
    at = np.zeros(len(x), int)
    active = np.flatnonzero(feature[at] >= 0)
    while len(active):
        here = at[active]
        at[active] = np.where(x[active, feature[here]] <= cut[here], left[here], right[here])
        active = active[feature[at[active]] >= 0]
    return at


class RandomForest:
    """An estimator over (features, label, row); ``fit`` gives a :class:`Forest`.  ``row`` is a hash of the row's key."""

    def __init__(self, trees: int = 100, seed: int = 42, task_rows: int = TASK_ROWS):
        if trees < 1 or task_rows < 2:
            raise ValueError("a forest needs a tree, a task two rows")
        self.trees, self.seed, self.task_rows = trees, seed, task_rows

    def fit(self, ready: DataFrame) -> "Forest":
        trees, seed = self.trees, self.seed
        row = F.col("row") if "row" in ready.columns else F.xxhash64(F.monotonically_increasing_id())
        rows = ready.select(vector_to_array("features").alias("x"), F.col("label").cast("int").alias("label"), row.alias("row"))
        sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}  # one row per class
        if not sizes:
            raise ValueError("there is no row to learn from")
        classes, count = max(sizes) + 1, sum(sizes.values())
        prior = np.array([sizes.get(i, 0) for i in range(classes)]) / count
        cuts = SoftmaxBoosting._cuts(rows)
        d = len(cuts)

        def blocked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    x = np.vstack(b["x"].to_numpy()).astype(np.float32)
                    yield pd.DataFrame({"x": [x.tobytes()], "label": [b["label"].to_numpy().astype(np.int32).tobytes()],
                                        "row": [b["row"].to_numpy().astype(np.int64).tobytes()]})

        blocks = cut_lineage(rows.mapInPandas(blocked, "x binary, label binary, row binary"))

        def opened(b: pd.DataFrame) -> Iterator[tuple]:
            for x, label, row in zip(b["x"], b["label"], b["row"]):
                label = np.frombuffer(label, np.int32)
                yield np.frombuffer(x, np.float32).reshape(len(label), d).astype(float), label, np.frombuffer(row, np.int64)

        tops = [Top() for _ in range(trees)]
        gains = np.zeros((trees, d))
        if count <= self.task_rows:
            for top in tops:
                top.shipped.add(0)
        else:
            self._grow_tops(blocks, opened, tops, gains, cuts, classes)
        columns = [((t.feature, t.value, t.left, t.right), frozenset(t.shipped)) for t in tops]

        def ship(batches):
            for b in batches:
                for x, label, row in opened(b):
                    for tree, (split, shipped) in enumerate(columns):
                        w = weights(row, tree, seed)
                        inside = np.flatnonzero(w)
                        at = descend(split, x[inside])
                        found = [(tree, node, inside[at == node]) for node in np.unique(at).tolist() if node in shipped]
                        if found:
                            yield pd.DataFrame([(t, n, x[i].astype(np.float32).tobytes(), label[i].tobytes(), w[i].astype(np.int32).tobytes()) for t, n, i in found],
                                               columns=["tree", "node", "x", "label", "w"])

        def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            keys, groups, pieces = [], [], []

            def close():
                x, label, w = (np.concatenate(c) for c in zip(*pieces))
                groups.append((x.reshape(-1, d), label, w))
                pieces.clear()

            def grown():
                grower = Grower(groups, classes, [np.random.default_rng([seed, tree, node]) for tree, node in keys])
                grower.run()
                for i, (tree, node) in enumerate(keys):
                    nodes, gain = grower.tree(i)
                    yield pd.DataFrame({"tree": [tree], "node": [node], **{k: [v.ravel()] for k, v in nodes.items()}, "gain": [gain]})
                keys.clear()

            for b in batches:
                for tree, node, x, label, w in zip(b["tree"].tolist(), b["node"].tolist(), b["x"], b["label"], b["w"]):
                    if keys and keys[-1] != (tree, node):
                        close()
                        if sum(len(g[1]) for g in groups) >= TOGETHER_ROWS:
                            yield from grown()
                    if not keys or keys[-1] != (tree, node):
                        keys.append((tree, node))
                    pieces.append((np.frombuffer(x, np.float32), np.frombuffer(label, np.int32), np.frombuffer(w, np.int32)))
            if keys:
                close()
                yield from grown()

        shipped = blocks.mapInPandas(ship, "tree int, node int, x binary, label binary, w binary")
        met = shipped.repartition("tree", "node").sortWithinPartitions("tree", "node")
        subtrees = cut_lineage(met.mapInPandas(finish, f"tree int, node int, {NODES}, gain array<double>"))
        for r in subtrees.selectExpr("tree", "posexplode(gain) as (f, g)").groupBy("tree", "f").agg(F.sum("g").alias("g")).collect():
            gains[r["tree"], r["f"]] += r["g"]  # trees x features
        share = gains / np.where(gains.sum(1, keepdims=True) > 0, gains.sum(1, keepdims=True), 1.0)
        return Forest(tops, subtrees.drop("gain"), prior, share.mean(0))

    def _grow_tops(self, blocks: DataFrame, opened, tops: list[Top], gains: np.ndarray, cuts: list[np.ndarray], classes: int) -> None:
        d, seed = len(cuts), self.seed
        few = max(1, int(math.sqrt(d)))
        # every task sends one histogram per node: no more tasks than cores, or their bytes grow with rows times nodes
        together = blocks.coalesce(blocks.sparkSession.sparkContext.defaultParallelism)
        waiting = [(t, 0, False) for t in range(len(tops))]  # (tree, node, look at all features)
        while waiting:
            wide = waiting[0][2]
            taken = [w for w in waiting if w[2] == wide][:max(1, HISTOGRAM_BYTES // ((d if wide else few) * BINS * classes * 8))]
            now = set(taken)
            waiting = [w for w in waiting if w not in now]
            drawn = {(t, n): np.sort(np.random.default_rng([seed, t, n, 1]).permutation(d)[:d if wide else few]) for t, n, _ in taken}
            slot = {key: i for i, key in enumerate(drawn)}
            of_tree: dict[int, list[int]] = {}
            for t, n in drawn:
                of_tree.setdefault(t, []).append(n)
            shape = (d if wide else few, BINS, classes)
            binary = {t: (tops[t].feature, tops[t].cut, tops[t].left, tops[t].right) for t in of_tree}

            def count(batches, of_tree=of_tree, slot=slot, drawn=drawn, shape=shape, binary=binary):
                sums = np.zeros((len(slot), *shape))
                for b in batches:
                    for x, label, row in opened(b):
                        bins = binned(x, cuts)
                        for t, nodes in of_tree.items():
                            w = weights(row, t, seed)
                            at = descend(binary[t], bins)
                            for n in nodes:
                                rows = np.flatnonzero((at == n) & (w > 0))
                                codes = (np.arange(shape[0]) * BINS + bins[np.ix_(rows, drawn[t, n])]) * classes + label[rows, None]
                                sums[slot[t, n]] += np.bincount(codes.ravel(), np.repeat(w[rows], shape[0]), math.prod(shape)).reshape(shape)
                yield pd.DataFrame([(i, h.tobytes()) for i, h in enumerate(sums) if h.any()], columns=["slot", "h"])

            def choose(batches, shape=shape):
                sums: dict[int, np.ndarray] = {}
                for b in batches:
                    for i, h in zip(b["slot"], b["h"]):
                        sums[i] = sums.get(i, 0.0) + np.frombuffer(h).reshape(shape)
                out = []
                for i, h in sums.items():
                    left, total = h.cumsum(1)[:, :-1], h[0].sum(0)
                    gain = gini_gain(left, total)
                    f, c = np.unravel_index(int(gain.argmax()), gain.shape)
                    out.append((i, int(f), int(c), float(gain[f, c]), left[f, c].tolist(), (total - left[f, c]).tolist()))
                yield pd.DataFrame(out, columns=["slot", "f", "c", "gain", "below", "above"])

            parts = together.mapInPandas(count, "slot int, h binary").repartition("slot")
            chosen = parts.mapInPandas(choose, "slot int, f int, c int, gain double, below array<double>, above array<double>").collect()  # one row per node
            keys = list(drawn)
            for r in chosen:
                t, n = keys[r["slot"]]
                top, sides = tops[t], (np.array(r["below"]), np.array(r["above"]))
                if r["gain"] < 0 and not wide:
                    waiting.append((t, n, True))
                elif r["gain"] < 0:  # no quantile parts these rows: equal in all bins, they are finished as they are
                    top.share[n] = (sides[0] + sides[1]) / (sides[0] + sides[1]).sum()
                else:
                    f = int(drawn[t, n][r["f"]])
                    gains[t, f] += max(r["gain"], 0.0)
                    for child, counts in zip(top.split(n, f, r["c"], float(cuts[f][r["c"]])), sides):
                        if (counts > 0).sum() < 2:
                            top.share[child] = counts / counts.sum()
                        elif counts.sum() <= self.task_rows:
                            top.shipped.add(child)
                        else:
                            waiting.append((t, child, False))


class Forest:
    """The fitted model; ``transform`` adds ``prediction``.  Subtrees stay a table until they are proven small."""

    def __init__(self, tops: list[Top], subtrees: DataFrame, prior: np.ndarray, importances: np.ndarray):
        self.tops, self.subtrees, self.prior = tops, subtrees, prior
        self.featureImportances = DenseVector(importances)

    def depth(self) -> int:
        """Levels of the deepest shipped subtree."""
        def levels(batches):
            for b in batches:
                deepest = []
                for left, right in zip(b["left"], b["right"]):
                    depth = np.zeros(len(left), int)
                    for i in range(len(left)):  # children come after their parent
                        for child in (left[i], right[i]):
                            if child >= 0:
                                depth[child] = depth[i] + 1
                    deepest.append(int(depth.max()))
                yield pd.DataFrame({"depth": deepest})
        return self.subtrees.select("left", "right").mapInPandas(levels, "depth int").agg(F.max("depth")).first()[0] or 0

    def transform(self, frame: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
        classes, prior = len(self.prior), self.prior
        size = self.subtrees.agg(F.sum(F.size("feature"))).first()[0] or 0
        tops = [((t.feature, t.value, t.left, t.right), t.share) for t in self.tops]
        if size * (20 + 8 * classes) > broadcast_bytes:
            return self._shuffled(frame, tops)
        grown: dict[tuple, tuple] = {(r["tree"], r["node"]): ([np.array(r[c]) for c in ("feature", "cut", "left", "right")], np.array(r["share"]).reshape(-1, classes))
                                     for r in self.subtrees.collect()}
        shared = frame.sparkSession.sparkContext.broadcast((tops, grown))

        @F.pandas_udf("double")
        def predict(features: pd.Series) -> pd.Series:
            if not len(features):
                return pd.Series([], dtype=float)
            x = np.vstack(features.to_numpy()).astype(np.float32).astype(float)
            total = np.zeros((len(x), classes))
            tops, grown = shared.value
            for tree, (split, leaves) in enumerate(tops):
                at = descend(split, x)
                for node in np.unique(at).tolist():
                    rows = np.flatnonzero(at == node)
                    if (tree, node) in grown:
                        columns, share = grown[tree, node]
                        total[rows] += share[descend(columns, x[rows])]
                    else:
                        total[rows] += leaves.get(node, prior)
            return pd.Series(total.argmax(1).astype(float))

        return frame.withColumn("prediction", predict(vector_to_array("features")))

    def _spread(self, load: DataFrame) -> DataFrame:
        """The subtrees that rows enter, one copy for each ``salt`` of ``load`` (tree, node, chunks)."""
        return self.subtrees.join(F.broadcast(load), ["tree", "node"]).withColumn(
            "salt", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")

    def _shuffled(self, frame: DataFrame, tops: list, walk_rows: int = WALK_ROWS) -> DataFrame:
        """Rows meet the subtrees of their nodes in a shuffle; the shares of a row are added up again.

        A subtree is copied only as often as its rows need more than one task.
        """
        classes, prior = len(self.prior), self.prior
        rows = cut_lineage(frame.withColumn("_n", F.monotonically_increasing_id()))
        asked = rows.select("_n", vector_to_array("features").alias("x"))

        def counted(batches):
            for b in batches:
                if len(b):
                    x = np.vstack(b["x"].to_numpy()).astype(np.float32).astype(float)
                    found = [(tree, *np.unique(descend(split, x), return_counts=True)) for tree, (split, _) in enumerate(tops)]
                    yield pd.DataFrame([(t, int(node), int(n)) for t, nodes, sizes in found for node, n in zip(nodes, sizes)], columns=["tree", "node", "n"])

        load = cut_lineage(asked.mapInPandas(counted, "tree int, node int, n bigint").groupBy("tree", "node").agg(
            F.ceil(F.sum("n") / walk_rows).cast("int").alias("chunks")))  # one row per end node of the tops
        chunks = {(r["tree"], r["node"]): r["chunks"] for r in load.where("chunks > 1").collect()}

        def enter(batches):
            for b in batches:
                if len(b):
                    short = np.vstack(b["x"].to_numpy()).astype(np.float32)
                    x, packed, number = short.astype(float), [v.tobytes() for v in short], b["_n"].to_numpy()
                    for tree, (split, leaves) in enumerate(tops):
                        at = descend(split, x)
                        known = [(leaves[n] if n in leaves else None) for n in at.tolist()]
                        salt = number % np.array([chunks.get((tree, n), 1) for n in at.tolist()])
                        yield pd.DataFrame({"_n": number, "x": packed, "tree": tree, "node": at.astype("int32"), "salt": salt.astype("int32"), "share": known})

        def walk(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left):
                return pd.DataFrame({"_n": pd.Series(dtype="int64"), "share": pd.Series(dtype=object)})
            if not len(right):
                return pd.DataFrame({"_n": left["_n"], "share": [s if s is not None else prior for s in left["share"]]})
            sub = right.iloc[0]
            x = np.frombuffer(b"".join(left["x"]), np.float32).reshape(len(left), -1).astype(float)
            end = descend(tuple(sub[c] for c in ("feature", "cut", "left", "right")), x)
            return pd.DataFrame({"_n": left["_n"], "share": list(np.asarray(sub["share"]).reshape(-1, classes)[end])})

        keys = ("tree", "node", "salt")
        entered = asked.mapInPandas(enter, "_n bigint, x binary, tree int, node int, salt int, share array<double>")
        shares = entered.groupBy(*keys).cogroup(self._spread(load).groupBy(*keys)).applyInPandas(walk, "_n bigint, share array<double>")
        sums = shares.groupBy("_n").agg(*(F.sum(F.col("share")[i]).alias(f"s{i}") for i in range(classes)))
        best = sums.select("_n", (F.array_position(F.array(*(f"s{i}" for i in range(classes))), F.greatest(*(f"s{i}" for i in range(classes)), F.lit(-1.0))) - 1)
                           .cast("double").alias("prediction"))
        return rows.join(best, "_n").drop("_n")
