"""Exact DBSCAN on packed blocks of neighbouring points.

Equal vectors are merged first (with their weight).  Points are packed into blocks
twice, by zones of two kinds: one that finds ``min_samples`` neighbours in its own block is
core without looking further, and core points of a block are linked there.  Only the
others look into all blocks they can reach, and name their few neighbours; then only
core points outside the largest component look for links to other components.  Blocks
meet without a shuffle (see ``kd_blocks``); degrees, neighbours of points that are not
core and links between components are all that leaves a task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sessionlens.functions.stats import number_rows
from sessionlens.operators.kd_blocks import BLOCK_ROWS, Block, close, each, meet, pack, reached, zone_tree, zoned
from sessionlens.session import cut_lineage

ZONES = 8


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node of the component.

    Alternating large-star and small-star steps (Kiveris et al., 2014), each
    materialised so that a lost executor costs one step at most.
    """
    stars = cut_lineage(edges.where("a <> b").selectExpr("greatest(a, b) u", "least(a, b) v").distinct())
    before = None
    while True:
        both = stars.unionByName(stars.selectExpr("v u", "u v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) m")
        large = both.where("v > u").join(low, "u").selectExpr("v u", "m v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").selectExpr("v u", "m v").unionByName(least.selectExpr("u", "m v"))
        stars = cut_lineage(small.where("u <> v").selectExpr("greatest(u, v) u", "least(u, v) v").distinct())
        state = stars.agg(F.count("*"), F.expr("coalesce(sum(cast(xxhash64(u, v) as decimal(38, 0))), 0)")).first()
        if state == before:
            break
        before = state
    return stars.selectExpr("u node", "v root").unionByName(stars.selectExpr("v node", "v root").distinct())


class _Sets:
    """Disjoint sets of a block's components; the smallest number is the root."""

    def __init__(self, numbers: np.ndarray):
        self.names, self.at = np.unique(numbers, return_inverse=True)
        self.root = np.arange(len(self.names))

    def of(self, rows) -> np.ndarray:
        return self.root[self.at[rows]]

    def link(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """Unite the sets of roots a[i] and b[i]; the pairs that were apart, by name."""
        apart = a != b
        new, up = [], {}

        def top(x: int) -> int:
            while x in up:
                x = up[x]
            return x

        for pair in np.unique(a[apart] * len(self.names) + b[apart]).tolist():
            x, y = map(top, divmod(pair, len(self.names)))
            if x != y:
                new.append((int(self.names[x]), int(self.names[y])))
                up[max(x, y)] = min(x, y)
        if up:
            to = np.arange(len(self.names))
            to[list(up)] = [top(x) for x in up]
            self.root = to[self.root]
        return new


def _touch(left: Block, right: Block, sets: _Sets, shift: int, eps: float) -> list[tuple[int, int]]:
    """Links between the rows of two blocks; right's rows follow left's in ``sets`` by ``shift``.

    Rows that belong to the only component of a leaf already are not compared with it.
    """
    found, every = [], np.arange(len(left.vec))

    def apart(part: slice) -> np.ndarray | None:
        there = sets.of(slice(part.start + shift, part.stop + shift))
        return sets.of(every) != there[0] if (there == there[0]).all() else None

    for part, own in reached(left, every, right, eps, apart):
        for i, j in close(left, own, right, part, eps):
            found += sets.link(sets.of(i), sets.of(j + shift))
    return found


def _beside(block: Block) -> list[tuple[np.ndarray, slice]]:
    """The rows of each leaf with the rows of that leaf and the next one."""
    return [(np.arange(p.start, p.stop), slice(p.start, q.stop)) for p, q in zip(block.parts, [*block.parts[1:], *block.parts[-1:]])]


def _inside(block: Block, eps: float, min_samples: int) -> dict[str, np.ndarray]:
    """Of each row of a block the component it is known by (-1: not known to be core) and the one it has in the block."""
    known, weight = block.of["comp"], block.of["w"]
    total = np.where(known >= 0, min_samples, 0)

    def weigh(rows: np.ndarray, part: slice) -> None:
        rows = rows[total[rows] < min_samples]
        for i, j in close(block, rows, block, part, eps) if len(rows) else ():
            total[:] += np.bincount(i, weight[j], len(total)).astype("int64")

    for rows, part in _beside(block):
        weigh(rows, part)
    rest = np.flatnonzero(total < min_samples)
    total[rest] = 0
    for part, rows in reached(block, rest, block, eps):
        weigh(rows, part)
    core = np.flatnonzero(total >= min_samples)
    comp = np.where(total >= min_samples, np.where(known >= 0, known, block.of["pid"]), -1)
    if not len(core):
        return {"comp": comp, "root": comp}
    own, sets, root = block.only(core), _Sets(comp[core]), comp.copy()
    for rows, part in _beside(own):
        for i, j in close(own, rows, own, part, eps):
            sets.link(sets.of(i), sets.of(j))
    _touch(own, own, sets, 0, eps)
    root[core] = sets.names[sets.of(slice(None))]
    return {"comp": comp, "root": root}


def _names_of(packed: DataFrame, *names: str) -> DataFrame:
    return each(packed, names, lambda b: pd.DataFrame({n: b.of[n] for n in names}), ", ".join(f"{n} bigint" for n in names))


def _points_of(packed: DataFrame, *names: str, unknown: bool = False) -> DataFrame:
    """The rows of the blocks again; ``unknown``: only those not known to be core."""
    def rows(block: Block) -> pd.DataFrame:
        at = np.flatnonzero(block.of["comp"] < 0) if unknown else np.arange(len(block.vec))
        return pd.DataFrame({**{n: block.of[n][at] for n in names}, "vec": [*block.vec[at]]})
    return each(packed, tuple({*names, "comp"}), rows, ", ".join([*(f"{n} bigint" for n in names), "vec array<double>"]))


def dbscan(rows: DataFrame, eps: float = 0.8, min_samples: int = 5, order: str = "ord", tile_rows: int = BLOCK_ROWS,
           pivots: int | None = None) -> DataFrame:
    """Add ``cluster_id`` to ``rows`` (``vec`` array<double>, ``order``); noise is -1.

    Neighbours are within ``eps`` (closed), the point itself included.  Clusters are
    numbered by their first core row in ``order``; a border row joins the lowest
    numbered cluster among its core neighbours.  ``pivots`` is the number of zones
    (default: ``ZONES`` per block of ``tile_rows``).
    """
    merged = rows.groupBy("vec").agg(F.count("*").alias("w"), F.min(order).alias("first"))
    points = cut_lineage(merged.withColumn("pid", F.monotonically_increasing_id()))
    count = points.count()
    if count == 0:
        return rows.withColumn("cluster_id", F.lit(-1).cast("bigint"))

    zones = pivots or ZONES * -(-count // tile_rows)
    tree = zone_tree(points, zones, eps)

    cores = rows.sparkSession.sparkContext.defaultParallelism

    def packed(some: DataFrame, number: int, *names: str, zones: tuple = tree, **options) -> DataFrame:
        size = min(tile_rows, max(-(-tile_rows // 2), -(-number // (4 * cores))))  # smaller blocks where there are few
        return pack(zoned(some, zones), number, *names, rows=size, radius=eps, **options)

    inside = {"work": lambda b: _inside(b, eps, min_samples), "adds": ("comp", "root")}
    every = packed(points.select("pid", "w", "vec", F.lit(-1).cast("bigint").alias("comp")), count, "pid", "w", "comp", **inside)
    again = every
    if every.count() > 1:  # rows are blocks
        again = packed(_points_of(every, "pid", "w", "root").withColumnRenamed("root", "comp"), count, "pid", "w", "comp",
                       zones=zone_tree(points, zones, turned=True), **inside)
    listed = cut_lineage(_names_of(again, "pid", "comp", "root").withColumn("comp", F.col("root" if again is every else "comp")))
    near = _neighbours(again, every, listed.where("comp < 0").count(), eps, min_samples, packed)
    labelled = _label(points, listed, again, near, eps, min_samples, packed)
    found = points.select("pid", "vec").join(labelled, "pid").select("vec", "cluster_id")
    return rows.join(found, "vec", "left").withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1)).cast("bigint"))


def _neighbours(again: DataFrame, every: DataFrame, unknown: int, eps: float, min_samples: int, packed: Callable[..., DataFrame]) -> DataFrame:
    """(pid, other, w): neighbours of the rows not known to be core, and their weight; ``min_samples`` or more in a block have no names."""
    schema = "pid bigint, other bigint, w bigint"

    def search(left: Block, right: Block) -> pd.DataFrame:
        total, weight, pairs = np.zeros(len(left.vec), dtype="int64"), right.of["w"], []
        for part, rows in reached(left, np.arange(len(left.vec)), right, eps):
            rows = rows[total[rows] < min_samples]
            for i, j in close(left, rows, right, part, eps) if len(rows) else ():
                total += np.bincount(i, weight[j], len(total)).astype("int64")
                pairs.append((i, j))
        if not pairs:
            return pd.DataFrame({"pid": [], "other": [], "w": []}, dtype="Int64")
        i, j = (np.concatenate(x) for x in zip(*pairs))
        few, many = total[i] < min_samples, np.flatnonzero(total >= min_samples)
        i, j = i[few], j[few]
        return pd.DataFrame({"pid": np.concatenate([left.of["pid"][i], left.of["pid"][many]]),
                             "other": pd.array(np.concatenate([right.of["pid"][j], np.zeros(len(many), "int64")]), "Int64"),
                             "w": np.concatenate([weight[j], total[many]])}).assign(
                                 other=lambda f: f["other"].mask(np.arange(len(f)) >= len(i)))

    if not unknown:
        return again.sparkSession.createDataFrame([], schema)
    asked = packed(_points_of(again, "pid", unknown=True), unknown, "pid")
    return cut_lineage(meet(asked, every, ("pid",), ("pid", "w"), search, schema, radius=eps))


def _joined(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """``rows`` (pid, comp) with the components that ``edges`` (a, b) unite."""
    edges = cut_lineage(edges.distinct())
    if edges.isEmpty():
        return rows
    roots = cut_lineage(connected_components(edges).withColumnRenamed("node", "comp"))
    return cut_lineage(rows.join(roots, "comp", "left").select("pid", F.coalesce("root", "comp").alias("comp")))


def _label(points: DataFrame, listed: DataFrame, again: DataFrame, near: DataFrame, eps: float, min_samples: int,
           packed: Callable[..., DataFrame]) -> DataFrame:
    """(pid, cluster_id) of core and border points."""
    late = cut_lineage(near.groupBy("pid").agg(F.sum("w").alias("w")).where(F.col("w") >= min_samples).select("pid"))
    known = listed.where("comp >= 0")
    core = known.select("pid", "comp").unionByName(late.select("pid", F.col("pid").alias("comp")))
    core = _joined(core, known.where("comp <> root").selectExpr("comp a", "root b"))

    def links(left: Block, right: Block) -> pd.DataFrame:
        sets = _Sets(np.concatenate([left.of["comp"], right.of["comp"]]))
        return pd.DataFrame(_touch(left, right, sets, len(left.vec), eps), columns=["a", "b"], dtype="int64")

    largest = core.groupBy("comp").count().orderBy(F.desc("count"), "comp").first()
    total = core.count()
    if largest and largest["count"] < total:
        vectors = cut_lineage(_points_of(again, "pid").join(core, "pid"))
        held = packed(vectors, total, "pid", "comp")
        apart = packed(vectors.where(F.col("comp") != largest["comp"]), total - largest["count"], "pid", "comp")
        core = _joined(core, meet(apart, held, ("pid", "comp"), ("pid", "comp"), links, "a bigint, b bigint", radius=eps))
    touched = near.join(late, "pid", "left_anti").join(core.withColumnRenamed("pid", "other"), "other").select("pid", "comp")
    starts = core.join(points.select("pid", "first"), "pid").groupBy("comp").agg(F.min("first").alias("start"))
    numbers = number_rows(starts, "start", name="cluster_id").select("comp", "cluster_id")
    return core.unionByName(touched).join(numbers, "comp").groupBy("pid").agg(F.min("cluster_id").alias("cluster_id"))
