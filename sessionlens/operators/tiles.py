"""Exact neighbour search over vectors without all-pairs joins.

Points are assigned to the nearest of a bounded number of pivots (a *cell*).  A
cell of more than one tile is split again by pivots of its own, chosen among its
points in proportion to their number, so the tiles of a growing table stay as
small in space as they are in rows.  Only the first level is held by the driver;
the pivots of the split cells are a table with one row per cell.  A part of a
cell that still exceeds a tile is cut by hash, so no task ever holds more than
one tile and one chunk of visitors however hot a region is.  A visitor is sent
only to cells, and in split cells to parts, that can hold a point within its
radius, by two bounds that never lose a neighbour:

* ring: all points of a cell lie between its smallest and largest pivot distance;
* bisector: a point of another cell lies beyond the plane halfway between the
  two pivots.

Tasks compare a visitor chunk with a tile by matrix products and return one
result per visitor; pairs are never emitted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from sessionlens.session import cut_lineage

MAX_PIVOTS = 2048  # fixed bound on everything that is collected or broadcast here
ROWS_PER_PIVOT = 1024
TILE_ROWS = 4096
SLACK = 1e-9


def matrix(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_numpy()) if len(column) else np.zeros((0, 0))


def nothing(*columns: str) -> pd.DataFrame:
    """An empty result; object columns convert to any Arrow type."""
    return pd.DataFrame({c: pd.Series([], dtype=object) for c in columns})


def squared_distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    d = (left * left).sum(1)[:, None] + (right * right).sum(1)[None, :] - 2.0 * (left @ right.T)
    return np.maximum(d, 0.0)


def blocks(n: int, size: int = 512) -> Iterator[slice]:
    for start in range(0, n, size):
        yield slice(start, min(n, start + size))


def within(left: np.ndarray, right: np.ndarray, radius: float) -> np.ndarray:
    """Exact closed-ball test; near-boundary pairs are measured again by differences."""
    d = squared_distances(left, right)
    limit = radius * radius
    scale = 1e-9 * (1.0 + limit + (left * left).sum(1)[:, None] + (right * right).sum(1)[None, :])
    near = d <= limit
    doubt = np.abs(d - limit) <= scale
    if doubt.any():
        i, j = np.nonzero(doubt)
        near[i, j] = np.sqrt(((left[i] - right[j]) ** 2).sum(1)) <= radius
    return near


@dataclass(frozen=True)
class Cells:
    """Pivots and per-cell bounds; at most ``MAX_PIVOTS`` rows.

    ``salts``: parts of each cell, 0 for an empty one.  ``inner``: pivots and bounds
    of the parts (cell, pivots, parts), where some cell is split; tasks never see it.
    """

    pivots: np.ndarray
    low: np.ndarray
    high: np.ndarray
    salts: np.ndarray
    inner: DataFrame | None = None

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("pivots", "low", "high", "salts")} | {"inner": None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)

    @cached_property
    def between(self) -> np.ndarray:
        return np.sqrt(squared_distances(self.pivots, self.pivots))

    def reach(self, points: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Which cells may hold something within ``radius`` of each point."""
        square = squared_distances(points, self.pivots)
        dist = np.sqrt(square)
        slack = SLACK * (1.0 + dist) + 1e-6
        home = square.argmin(1)
        between = self.between[home]
        ahead = (square - square[np.arange(len(points)), home][:, None]) / np.maximum(2.0 * between, 1e-300)
        r = radius[:, None] + slack
        ring = (dist <= self.high[None, :] + r) & (dist >= self.low[None, :] - r)
        return ring & ((ahead <= r) | (between <= 0)) & (self.salts > 0)[None, :]


def _plus(frame: DataFrame, **fields: T.DataType) -> T.StructType:
    return T.StructType([*frame.schema.fields, *(T.StructField(n, t) for n, t in fields.items())])


def nearest(points: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and distance of the nearest pivot of each point."""
    home, dist = np.zeros(len(points), dtype="int32"), np.zeros(len(points))
    for part in blocks(len(points)):
        square = squared_distances(points[part], pivots)
        home[part] = square.argmin(1)
        dist[part] = np.sqrt(square[np.arange(len(square)), home[part]])
    return home, dist


def _assign(pivots: np.ndarray) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches):
        for batch in batches:
            home, dist = nearest(matrix(batch["vec"]), pivots) if len(batch) else (np.zeros(0, dtype="int32"), np.zeros(0))
            yield batch.assign(cell=home, dist=dist)
    return run


def tile_points(points: DataFrame, count: int, tile_rows: int = TILE_ROWS,
                pivots: int | None = None) -> tuple[DataFrame, Cells]:
    """Give ``points`` (pid, vec, ...) their ``cell`` and ``salt``, the number of a tile in the cell.

    ``points`` must be materialised and its vectors distinct; ``count`` is its size.
    """
    wanted = pivots or min(MAX_PIVOTS, max(1, -(-count // ROWS_PER_PIVOT)))
    chosen = points.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(min(wanted, MAX_PIVOTS)).collect()
    centres = np.array([row["vec"] for row in chosen], dtype=float)
    schema = _plus(points, cell=T.IntegerType(), dist=T.DoubleType())
    placed = points.mapInPandas(_assign(centres), schema)
    stats = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi"))
    low, high = np.zeros(len(centres)), np.zeros(len(centres))
    rows = np.zeros(len(centres), dtype=int)
    for row in stats.collect():  # one row per pivot
        low[row["cell"]], high[row["cell"]], rows[row["cell"]] = row["lo"], row["hi"], row["n"]
    if (rows <= tile_rows).all():
        return placed.withColumn("salt", F.lit(0)), Cells(centres, low, high, (rows > 0).astype(int))
    tiles, inner = _split_cells(cut_lineage(placed), rows, tile_rows)
    salts = np.where(rows > tile_rows, np.minimum(MAX_PIVOTS, -(-rows // _part_rows(tile_rows))), rows > 0).astype(int)
    return tiles, Cells(centres, low, high, salts, inner)


def _part_rows(tile_rows: int) -> int:
    """Rows per pivot of a split cell: uneven parts still fit into a tile."""
    return max(1, tile_rows // 4)


def _per_cell(values: np.ndarray, cell: str):
    return F.element_at(F.array(*(F.lit(int(v)) for v in values)), F.col(cell) + 1)


def _split_cells(placed: DataFrame, rows: np.ndarray, tile_rows: int) -> tuple[DataFrame, DataFrame]:
    """Tiles, and the pivots and parts of the cells that hold more than one tile."""
    large = [int(c) for c in np.flatnonzero(rows > tile_rows)]
    wanted = np.minimum(MAX_PIVOTS, -(-rows // _part_rows(tile_rows)))
    split, whole = placed.where(F.col("cell").isin(large)), placed.where(~F.col("cell").isin(large))
    rank = F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("vec"), "vec"))
    chosen = split.select("cell", "vec").withColumn("r", rank).where(F.col("r") <= MAX_PIVOTS).where(F.col("r") <= _per_cell(wanted, "cell"))
    centres = cut_lineage(chosen.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("r", "vec"))).getField("vec").alias("pivots")))
    chunks = -(-rows // (16 * tile_rows))
    dealt = split.withColumn("chunk", F.pmod(F.xxhash64("pid", F.lit(11)), _per_cell(chunks, "cell")).cast("int"))
    shown = centres.withColumn("chunk", F.explode(F.sequence(F.lit(0), _per_cell(chunks, "cell") - 1)))

    def place(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.drop(columns="chunk")
        if not len(left):
            return left.assign(salt=pd.Series(dtype="int32"))
        salt, dist = nearest(matrix(left["vec"]), matrix(pd.Series(right["pivots"].iloc[0])))
        return left.assign(salt=salt, dist=dist)

    schema = _plus(split, salt=T.IntegerType())
    inside = cut_lineage(dealt.groupBy("cell", "chunk").cogroup(shown.groupBy("cell", "chunk")).applyInPandas(place, schema))
    sizes = inside.groupBy("cell", "salt").agg(F.count("*").alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi"))
    parts = sizes.withColumn("cuts", F.ceil(F.col("n") / tile_rows).cast("int"))
    hot = parts.where("cuts > 1").select("cell", "salt", "cuts")  # what even its own pivots leave too large is cut by hash
    if not hot.isEmpty():
        cut = F.pmod(F.xxhash64("pid"), F.coalesce("cuts", F.lit(1))).cast("int")
        inside = inside.join(hot, ["cell", "salt"], "left").withColumn("salt", F.col("salt") + MAX_PIVOTS * cut).select(*schema.names)
    listed = parts.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("salt", "lo", "hi", "cuts"))).alias("parts"))
    inner = cut_lineage(centres.join(listed, "cell"))
    return whole.withColumn("salt", F.lit(0)).unionByName(inside), inner


def route(visitors: DataFrame, cells: Cells, radius: Callable[[pd.DataFrame], np.ndarray],
          skip: Callable[[pd.DataFrame, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """One row per visitor and cell it must look into (column ``to``).

    ``skip`` may rule cells out of the reach mask for reasons of its own.
    """
    schema = _plus(visitors, to=T.IntegerType())

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            points = matrix(batch["vec"])
            for part in blocks(len(batch)):
                rows = batch.iloc[part]
                mask = cells.reach(points[part], radius(rows))
                if skip is not None:
                    mask = mask & ~skip(rows, mask)
                i, j = np.nonzero(mask)
                yield rows.iloc[i].assign(to=j.astype("int32"))

    return visitors.mapInPandas(run, schema)


def home_only(visitors: DataFrame, cells: Cells) -> DataFrame:
    """One row per visitor: the cell of its nearest non-empty pivot."""
    placed = visitors.mapInPandas(_assign(cells.pivots), _plus(visitors, cell=T.IntegerType(), dist=T.DoubleType()))
    return placed.withColumnRenamed("cell", "to").drop("dist")


def _enter(visits: DataFrame, cells: Cells, key: str, chunk_rows: int, radius: Callable[[pd.DataFrame], np.ndarray] | None, seen: bool) -> DataFrame:
    """One row per visit and tile (column ``salt``) that it must look into.

    Without ``radius`` a visit sees the part with the nearest pivot; with ``seen`` it
    leaves that part out in its home cell.
    """
    if cells.inner is None:
        return visits.withColumn("salt", F.lit(0))
    split = F.element_at(F.array(*(F.lit(bool(n > 1)) for n in cells.salts)), F.col("to") + 1)
    load = {r["to"]: r["n"] for r in visits.where(split).groupBy("to").agg(F.count("*").alias("n")).collect()}  # one row per pivot
    chunks = np.array([max(1, -(-load.get(c, 0) // (4 * chunk_rows))) for c in range(len(cells.pivots))])
    dealt = visits.where(split).withColumn("chunk", F.pmod(F.xxhash64(F.col(key), F.lit(13)), _per_cell(chunks, "to")).cast("int"))
    shown = cells.inner.where(F.col("cell").isin([int(c) for c in load])).withColumn("to", F.col("cell")).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), _per_cell(chunks, "to") - 1)))

    def choose(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = left.drop(columns="chunk")
        if not len(rows):
            return rows.assign(salt=pd.Series(dtype="int32"))
        own, parts = right["pivots"].iloc[0], right["parts"].iloc[0]
        low, high, cuts = np.zeros(len(own)), np.zeros(len(own)), np.zeros(len(own), dtype=int)
        for p in parts:
            low[p["salt"]], high[p["salt"]], cuts[p["salt"]] = p["lo"], p["hi"], p["cuts"]
        inner = Cells(matrix(pd.Series(own)), low, high, cuts)
        points = matrix(rows["vec"])
        i, j = [], []
        for part in blocks(len(rows)):
            home, _ = nearest(points[part], inner.pivots)
            if radius is None:
                mask = np.zeros((len(home), len(own)), dtype=bool)
                mask[np.arange(len(home)), home] = True
            else:
                mask = inner.reach(points[part], radius(rows.iloc[part]))
                if seen:
                    at_home = nearest(points[part], cells.pivots)[0] == rows["to"].iloc[part].to_numpy()
                    mask[np.flatnonzero(at_home), home[at_home]] = False
            a, b = np.nonzero(mask)
            i.append(a + part.start)
            j.append(b)
        i, j = np.concatenate(i), np.concatenate(j)
        times = cuts[j]
        cut = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        return rows.iloc[np.repeat(i, times)].assign(salt=(np.repeat(j, times) + MAX_PIVOTS * cut).astype("int32"))

    entered = dealt.groupBy("to", "chunk").cogroup(shown.groupBy("to", "chunk")).applyInPandas(choose, _plus(visits, salt=T.IntegerType()))
    return visits.where(~split).withColumn("salt", F.lit(0)).unionByName(entered)


def visit(visits: DataFrame, tiles: DataFrame, cells: Cells, key: str,
          compare: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, chunk_rows: int = TILE_ROWS,
          radius: Callable[[pd.DataFrame], np.ndarray] | None = None, seen: bool = False) -> DataFrame:
    """Bring every visit (column ``to``) together with the tiles of that cell within its ``radius``.

    Visitors of a tile are cut into hash chunks of bounded size, and the tile is
    repeated once per chunk; ``compare`` sees one chunk and one tile.  Without
    ``radius`` a split cell shows its nearest part only; ``seen`` leaves that one out.
    """
    going = _enter(visits, cells, key, chunk_rows, radius, seen)
    if cells.inner is not None:
        going = cut_lineage(going)
    load = going.groupBy("to", "salt").agg(F.ceil(F.count("*") / chunk_rows).cast("int").alias("chunks"))  # one row per tile
    load = cut_lineage(load)
    going = going.join(load, ["to", "salt"]).withColumn("chunk", F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.col("chunks")).cast("int")).drop("chunks")
    shown = tiles.withColumn("to", F.col("cell")).join(load, ["to", "salt"]).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    grouped = going.groupBy("to", "salt", "chunk").cogroup(shown.groupBy("to", "salt", "chunk"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return compare(left, right)

    return grouped.applyInPandas(run, schema)
