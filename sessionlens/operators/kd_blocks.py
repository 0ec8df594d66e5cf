"""Packed blocks of neighbouring points, and joins of all blocks without a shuffle.

Points are dealt to zones by a tree of cuts through a bounded sample, so a zone is
small in space; its rows are packed into blocks in the order of a further tree whose
leaves hold at most ``LEAF_ROWS`` rows.  ``meet`` brings every block together with
every block: tasks read the materialised blocks, and only results leave them.  Inside
a pair of blocks a row is compared with the leaves whose box it can reach.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from sessionlens.operators.tiles import MAX_PIVOTS, SLACK, blocks, matrix
from sessionlens.session import cut_lineage

BLOCK_ROWS = 1 << 14
LEAF_ROWS = 128
SAMPLE_ROWS = 8 * MAX_PIVOTS  # fixed bound on what the driver sees of the points
CUT_ROWS = 256  # rows that judge a cut
TASK_BLOCKS, TASKS = 8, 12  # of a meeting: partitions of the right per task, least tasks per core


def _sparse_cut(points: np.ndarray, radius: float) -> tuple[int, float] | None:
    """(feature, cut) that parts most pairs of ``points`` by more than ``radius``, judged by some of them.

    Rows that lie within the radius of the other side count as pairs still to be compared.
    """
    some = np.sort(points[::max(1, len(points) // CUT_ROWS)], axis=0)
    n, every = len(some), np.arange(some.shape[1])
    first = some[[n * q // 10 for q in range(1, 10)]]  # lowest value of the upper side
    below = (some[:, None] < first).sum(0)
    last = some[np.maximum(below - 1, 0), every]
    left = below - (some[:, None] < first - radius).sum(0)
    right = (some[:, None] <= last + radius).sum(0) - below
    kept = np.where((below >= max(1, n // 10)) & (n - below >= max(1, n // 10)),
                    below ** 2.0 + (n - below) ** 2.0 + 2.0 * left * right, np.inf)
    at, feature = np.unravel_index(kept.argmin(), kept.shape)
    if not np.isfinite(kept[at, feature]):
        return None
    middle = (last[at, feature] + first[at, feature]) / 2
    return int(feature), float(middle if middle < first[at, feature] else last[at, feature])


def kd_order(points: np.ndarray, leaf: int, radius: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of a tree and the first row of each leaf.

    The tree halves the widest spread; with a ``radius`` it cuts where the fewest pairs are that close.
    """
    order, starts, stack = [], [], [np.arange(len(points))]
    at = 0
    while stack:
        rows = stack.pop()
        if len(rows) <= leaf:
            order.append(rows)
            starts.append(at)
            at += len(rows)
            continue
        own = points[rows]
        found = _sparse_cut(own, radius) if radius is not None else None
        if found:
            below = own[:, found[0]] <= found[1]
            if 0 < below.sum() < len(rows):
                stack += [rows[~below], rows[below]]
                continue
        rows = rows[own[:, own.var(0).argmax()].argsort(kind="stable")]
        stack += [rows[len(rows) // 2:], rows[:len(rows) // 2]]
    return np.concatenate(order), np.array(starts)


def _zones(sample: np.ndarray, zones: int, radius: float | None = None) -> list[tuple]:
    """Nodes (feature, cut, left, right) of a tree; a leaf has feature -1 and its zone as cut."""
    nodes: list = [None]
    stack, given = [(0, sample, zones)], 0
    while stack:
        at, rows, n = stack.pop()
        feature = int(rows.var(0).argmax()) if len(rows) else 0
        if n <= 1 or len(rows) < 2 or rows[:, feature].min() == rows[:, feature].max():
            nodes[at] = (-1, given, 0, 0)
            given += 1
            continue
        found = _sparse_cut(rows, radius) if radius is not None else None
        if found:
            feature, cut = found
            lower = max(1, min(n - 1, round(n * float((rows[:, feature] <= cut).mean()))))
        else:
            values, lower = np.sort(rows[:, feature]), n // 2
            cut = values[max(0, min(len(values) - 2, len(values) * (n // 2) // n - 1))]
            cut = cut if cut < values[-1] else values[values < cut][-1]
        left, right = len(nodes), len(nodes) + 1
        nodes += [None, None]
        nodes[at] = (feature, float(cut), left, right)
        below = rows[:, feature] <= cut
        stack += [(right, rows[~below], n - lower), (left, rows[below], lower)]
    return nodes


def zone_tree(points: DataFrame, zones: int, radius: float | None = None, turned: bool = False) -> tuple:
    """(axes, nodes) of the tree of ``zones``, from a sample of materialised ``points`` (vec, ...).

    With a ``radius`` zones part where few pairs are that close; ``turned`` cuts along the
    principal axes of the points instead, so that other points share a zone.
    """
    rows = min(SAMPLE_ROWS, 64 * zones) if zones > 1 else 1
    sample = np.array([r["vec"] for r in points.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(rows).collect()], dtype=float)
    axes = np.linalg.eigh(np.cov(sample.T, ddof=0).reshape(sample.shape[1], -1))[1] if turned and len(sample) > 1 and np.isfinite(sample).all() else None
    return axes, _zones(sample, zones, radius) if axes is None else _zones(sample @ axes, zones)


def zoned(points: DataFrame, zones: int | tuple) -> DataFrame:
    """Add ``zone`` to ``points`` (vec, ...); ``zones``: their number or their tree."""
    axes, nodes = zones if isinstance(zones, tuple) else zone_tree(points, zones)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            zone, x = np.zeros(len(batch), dtype="int32"), matrix(batch["vec"])
            x = x if axes is None or not len(x) else x @ axes
            stack = [(0, np.arange(len(batch)))]
            while stack:
                at, own = stack.pop()
                feature, cut, left, right = nodes[at]
                if feature < 0 or not len(own):
                    zone[own] = cut if feature < 0 else 0
                    continue
                below = x[own, feature] <= cut
                stack += [(left, own[below]), (right, own[~below])]
            yield batch.assign(zone=zone)

    return points.mapInPandas(assign, T.StructType([*points.schema.fields, T.StructField("zone", T.IntegerType())]))


@dataclass
class Block:
    """Points with the first row of each leaf and further columns of whole numbers."""

    vec: np.ndarray
    starts: np.ndarray
    of: dict[str, np.ndarray]
    number: int = -1

    @cached_property
    def norms(self) -> np.ndarray:
        return (self.vec * self.vec).sum(1)

    @cached_property
    def parts(self) -> list[slice]:
        """The rows of each leaf."""
        return [slice(int(a), int(b)) for a, b in zip(self.starts, [*self.starts[1:], len(self.vec)])]

    @cached_property
    def boxes(self) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest values of each leaf."""
        return np.minimum.reduceat(self.vec, self.starts), np.maximum.reduceat(self.vec, self.starts)

    @cached_property
    def widest(self) -> float:
        return float(np.abs(self.vec).max()) if len(self.vec) else 0.0

    @cached_property
    def brief(self) -> np.ndarray:
        """The points in single precision, which is enough to rule rows out (see ``_brief_limit``)."""
        return self.vec.astype("float32") if self.widest < 1e6 else self.vec

    def only(self, rows: np.ndarray) -> "Block":
        """The block of some of its ``rows``, ascending."""
        starts = np.unique(np.searchsorted(rows, self.starts))
        return Block(self.vec[rows], starts[starts < len(rows)], {n: v[rows] for n, v in self.of.items()}, self.number)


def _bytes(vec: np.ndarray, of: dict[str, np.ndarray], radius: float | None, work: Callable[[Block], dict[str, np.ndarray]] | None) -> dict:
    order, starts = kd_order(vec, LEAF_ROWS, radius)
    block = Block(vec[order], starts.astype("int64"), {n: v[order].astype("int64") for n, v in of.items()})
    of = {**block.of, **(work(block) if work else {})}
    return {"vec": block.vec.tobytes(), "starts": block.starts.tobytes(), "dim": vec.shape[1], "low": vec.min(0), "high": vec.max(0),
            **{n: v.astype("int64").tobytes() for n, v in of.items()}}


def opened(row, names: tuple[str, ...], prefix: str = "") -> Block:
    get = lambda n: getattr(row, prefix + n)
    return Block(np.frombuffer(get("vec")).reshape(-1, get("dim")), np.frombuffer(get("starts"), "int64"),
                 {n: np.frombuffer(get(n), "int64") for n in names}, int(get("block")))


def pack(points: DataFrame, count: int, *names: str, rows: int = BLOCK_ROWS, radius: float | None = None,
         work: Callable[[Block], dict[str, np.ndarray]] | None = None, adds: tuple[str, ...] = ()) -> DataFrame:
    """Blocks of at most ``rows`` of the ``points`` (zone, vec, names...), ``count`` of them.

    ``work`` gives each block the columns it ``adds`` (or replaces) before it is written.
    """
    if radius is None:
        dealt = points.repartitionByRange(max(1, -(-count // rows)), "zone")
    else:  # some room, so that most partitions fill one block
        dealt = points.repartitionByRange(max(1, -(-count * 5 // (rows * 4))), "zone").sortWithinPartitions("zone")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            for part in blocks(len(batch), rows):
                some = batch.iloc[part]
                held.append((matrix(some["vec"]), {n: some[n].to_numpy() for n in names}))
                size += len(some)
                if size >= rows:
                    vec, of = np.concatenate([h[0] for h in held]), {n: np.concatenate([h[1][n] for h in held]) for n in names}
                    yield pd.DataFrame([_bytes(vec[:rows], {n: v[:rows] for n, v in of.items()}, radius, work)])
                    held, size = [(vec[rows:], {n: v[rows:] for n, v in of.items()})], size - rows
        if size:
            yield pd.DataFrame([_bytes(np.concatenate([h[0] for h in held]), {n: np.concatenate([h[1][n] for h in held]) for n in names}, radius, work)])

    schema = ", ".join(["vec binary", "starts binary", "dim int", "low array<double>", "high array<double>",
                        *(f"{n} binary" for n in dict.fromkeys([*names, *adds]))])
    return cut_lineage(dealt.select("vec", *names).mapInPandas(run, schema).withColumn("block", F.monotonically_increasing_id()))


def each(packed: DataFrame, names: tuple[str, ...], work: Callable[[Block], pd.DataFrame | None], schema: str) -> DataFrame:
    """``work`` of every block by itself."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                out = work(opened(row, names))
                if out is not None and len(out):
                    yield out
    return packed.mapInPandas(run, schema)


def meet(left: DataFrame, right: DataFrame, names: tuple[str, ...], others: tuple[str, ...],
         work: Callable[[Block, Block], pd.DataFrame | None], schema: str, where: str | None = None,
         radius: float | None = None) -> DataFrame:
    """``work`` of every block of ``left`` with every one of ``right``; ``where`` compares l_block and r_block.

    With a ``radius`` blocks whose boxes are further apart do not meet.
    """
    near = None
    if radius is not None:
        near = ("aggregate(zip_with(zip_with(l_low, r_high, (x, y) -> x - y), zip_with(r_low, l_high, (x, y) -> x - y), (x, y) -> greatest(x, y, 0D)),"
                f" 0D, (total, x) -> total + x * x) <= {_limit(radius)!r}D")
        # a task reads a few blocks of the right and a share of the left: tasks do not grow with the square of the blocks
        many = max(1, right.rdd.getNumPartitions() // TASK_BLOCKS)
        share = max(1, -(-TASKS * left.sparkSession.sparkContext.defaultParallelism // many))
        left, right = left.coalesce(share), right.coalesce(many)
    l, r = (frame.select(*(F.col(c).alias(f"{side}_{c}") for c in frame.columns)) for frame, side in ((left, "l"), (right, "r")))
    where = " and ".join(f"({c})" for c in (where, near) if c)
    both = l.join(r.hint("shuffle_replicate_nl"), F.expr(where)) if where else l.crossJoin(r.hint("shuffle_replicate_nl"))
    both = both.drop("l_low", "l_high", "r_low", "r_high")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                out = work(opened(row, names, "l_"), opened(row, others, "r_"))
                if out is not None and len(out):
                    yield out
    return both.mapInPandas(run, schema)


def _limit(radius: float) -> float:
    """Square of the distance to a box up to which one of its points may lie within ``radius``."""
    return radius * radius * (1 + SLACK) + SLACK


def _brief_limit(radius: float, widest: float, dimension: int) -> float:
    """The same for single precision of coordinates up to ``widest``."""
    return (radius * (1 + 2e-7 * (dimension + 4)) + 1e-6 * (1 + widest) * dimension ** 0.5) ** 2


def _away(low: np.ndarray, high: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of boxes (or points) from the box between ``a`` and ``b``."""
    away = low - b
    np.maximum(away, a - high, out=away)
    np.maximum(away, 0.0, out=away)
    return np.einsum("ij,ij->i", away, away)


def reached(left: Block, rows: np.ndarray, right: Block, radius: float,
            wanted: Callable[[slice], np.ndarray | None] | None = None) -> Iterator[tuple[slice, np.ndarray]]:
    """Each leaf of ``right`` with those of left's ``rows`` (ascending) that may lie within ``radius`` of one of its points.

    ``wanted`` may tell for a leaf which rows of left matter.
    """
    if not len(rows):
        return
    limit, (low, high) = _limit(radius), left.boxes
    ends = np.searchsorted(rows, [*left.starts, len(left.vec)])
    held = np.flatnonzero(ends[1:] > ends[:-1])
    low, high = low[held], high[held]
    if left.brief.dtype == right.brief.dtype == np.float32:
        points, kind, bound = left.brief, "float32", _brief_limit(radius, max(left.widest, right.widest), left.vec.shape[1])
    else:
        points, kind, bound = left.vec, "float64", limit
    for part, a, b in zip(right.parts, *right.boxes):
        leaves = held[_away(low, high, a, b) <= limit]
        if not len(leaves):
            continue
        some = np.concatenate([rows[ends[k]:ends[k + 1]] for k in leaves])
        mask = wanted(part) if wanted else None
        some = some if mask is None else some[mask[some]]
        x = points[some]
        some = some[_away(x, x, a.astype(kind), b.astype(kind)) <= bound]
        if len(some):
            yield part, some


def close(left: Block, rows: np.ndarray, right: Block, part: slice, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of left, row of right) within the closed ball; near-boundary ones are measured again by differences."""
    limit, dimension = radius * radius, left.vec.shape[1]
    x, y, error = left.vec, right.vec[part], 1e-9
    if left.brief.dtype == right.brief.dtype == np.float32:
        x, y, error = left.brief, right.brief[part], 2e-7 * (dimension + 8)  # several times the rounding of a product
    y2 = right.norms[part]
    half = (y2 / 2).astype(y.dtype)
    for some in blocks(len(rows), 2048):
        own = rows[some]
        x2 = left.norms[own]
        product = x[own] @ y.T
        product -= half
        widest = error * (1.0 + limit + x2.max() + y2.max())
        at = np.flatnonzero(product >= ((x2 - limit - widest) / 2).astype(y.dtype)[:, None])
        if not len(at):
            continue
        i, j = np.divmod(at, len(y))
        d = x2[i] - 2.0 * product.ravel()[at]
        near = d <= limit
        doubt = np.flatnonzero(np.abs(d - limit) <= error * (1.0 + limit + x2[i] + y2[j]))
        if len(doubt):
            near[doubt] = np.sqrt(((left.vec[own[i[doubt]]] - right.vec[part][j[doubt]]) ** 2).sum(1)) <= radius
        yield own[i[near]], j[near] + part.start
