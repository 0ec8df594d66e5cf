"""Sharding by k-d tree partitioning.

The set of documents is a cell.  A cell that holds more than one shard's bytes
is split across the dimension in which it is widest (relative to the whole
table), at the weighted median of that dimension: the value that leaves half of
the cell's bytes (for an odd number of shards the nearest share) on its lower
side.  All cells of a level are split at once.  A median is found by counting:
passes over 16 384 bins narrow the range until the bin that holds the median is
light or a single value.  Where a heavy single value holds the median, the cell
takes its next widest dimension; where all dimensions do, a hash splits the value.

Per pass one row per cell reaches the driver, so the number of shards bounds
what it holds and what is broadcast.

Defined cases: null dimensions sort first; null sizes count as 0 plus the
overhead; identical rows share a shard; an empty table gives no rows; shards
may stay empty when there are fewer documents than shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

BINS = 1 << 14
TIES = (1 << 31) - 1
ROOT = "case when _size >= 0 then 0 end"  # no literal: a join on it would be folded to a nested loop
Cut = tuple[int, int, int, int, int]  # node, right node, dimension, value, tie: left is (v, t) < (value, tie)


def code(column: Column, kind: str) -> Column:
    """Order-preserving whole number of a column: numbers as they are, text by its first seven bytes."""
    if kind == "string":
        head = F.rpad(F.hex(F.substring(F.encode(column, "UTF-8"), 1, 7)), 14, "0")
        return F.coalesce(F.conv(head, 16, 10).cast("bigint"), F.lit(-1))
    return F.coalesce(column.cast("bigint"), F.lit(-1))


def _side(frame: DataFrame, cuts: list[Cut], dims: int) -> DataFrame:
    """Move the rows of every cut cell to its side."""
    spark = frame.sparkSession
    table = F.broadcast(spark.createDataFrame(cuts, "_at int, _right int, _dim int, _value bigint, _tie bigint"))  # one row per cell
    v = F.element_at(F.array(*(F.col(f"_d{i}") for i in range(dims))), F.col("_dim") + 1)
    left = F.col("_dim").isNull() | (v < F.col("_value")) | ((v == F.col("_value")) & (F.col("_t") < F.col("_tie")))
    return frame.join(table, F.col("_node") == F.col("_at"), "left") \
        .withColumn("_node", F.when(left, F.col("_node")).otherwise(F.col("_right"))).drop("_at", "_right", "_dim", "_value", "_tie")


def _narrow(frame: DataFrame, searches: list[tuple], dims: int) -> dict[int, tuple]:
    """One pass: least and largest value, bytes below and bytes of the bin in which each search reaches its goal."""
    spark = frame.sparkSession
    table = F.broadcast(spark.createDataFrame(searches, "_at int, _dim int, _fixed bigint, _lo bigint, _hi bigint, _step bigint, _goal double"))
    v = F.element_at(F.array(*(F.col(f"_d{i}") for i in range(dims))), F.col("_dim") + 1)
    v = F.when(F.col("_fixed").isNull(), v).when(v == F.col("_fixed"), F.col("_t"))
    counted = frame.join(table, F.col("_node") == F.col("_at")).withColumn("_v", v).where("_v between _lo and _hi") \
        .groupBy("_at", F.expr("(_v - _lo) div _step").alias("_bin"), "_goal").agg(F.sum("_size").alias("_mass"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    before = F.sum("_mass").over(Window.partitionBy("_at").orderBy("_bin")) - F.col("_mass")
    found = counted.withColumn("_before", before).where("_before + _mass >= _goal") \
        .groupBy("_at").agg(F.min_by(F.struct("_least", "_most", "_before", "_mass"), "_bin").alias("x"))
    return {r["_at"]: tuple(r["x"]) for r in found.collect()}  # one row per cell


def kd_cuts(points: DataFrame, dims: int, shards: int, tolerance: float = 0.002) -> list[list[Cut]]:
    """The cuts of every level over ``points`` with ``_size``, ``_d0`` .. and the tie hash ``_t``.

    ``tolerance``: a median may be off by this part of one shard's bytes.
    """
    frame, levels, cells = points.withColumn("_node", F.expr(ROOT)), [], {0: shards}
    whole: list[int] | None = None
    while any(n > 1 for n in cells.values()):
        stats = frame.groupBy("_node").agg(F.sum("_size"), *(f(f"_d{i}") for i in range(dims) for f in (F.min, F.max))).collect()
        state = {}
        for node, mass, *ends in stats:  # one row per cell
            spans = [ends[2 * i + 1] - ends[2 * i] for i in range(dims)]
            whole = whole or [max(s, 1) for s in spans]
            if cells[node] > 1:
                widest = sorted(range(dims), key=lambda i: -spans[i] / whole[i])
                lower, d = -(-cells[node] // 2), widest.pop(0)
                state[node] = {"dim": d, "next": widest, "ends": ends, "fixed": None, "lo": ends[2 * d], "hi": ends[2 * d + 1],
                               "share": mass * lower / cells[node], "goal": mass * lower / cells[node],
                               "slack": tolerance * mass / cells[node], "right": node + lower}
        cuts, open_ = [], dict(state)
        while open_:  # a few passes
            searches = []
            for node, s in open_.items():
                s["step"] = max(1, -(-(s["hi"] - s["lo"] + 1) // BINS))
                searches.append((node, s["dim"], s["fixed"], s["lo"], s["hi"], s["step"], float(s["goal"])))
            found = _narrow(frame, searches, dims)
            for node, s in list(open_.items()):
                lo, hi, before, mass = found[node]
                s["goal"] -= before
                if mass > s["slack"] and lo < hi:
                    s.update(lo=lo, hi=hi)
                elif mass > s["slack"] and s["next"]:  # many rows share the median: try the next widest dimension
                    d = s["next"].pop(0)
                    s.update(dim=d, lo=s["ends"][2 * d], hi=s["ends"][2 * d + 1], goal=s["share"])
                elif mass > s["slack"] and s["fixed"] is None:
                    s.update(fixed=lo, lo=0, hi=TIES)
                else:
                    edge = lo if s["goal"] < mass / 2 else hi + 1
                    value, tie = (edge, 0) if s["fixed"] is None else (s["fixed"], edge)
                    cuts.append((node, s["right"], s["dim"], value, tie))
                    del open_[node]
        cells = {k: v for node, n in cells.items() for k, v in ({node: -(-n // 2), node + -(-n // 2): n // 2} if n > 1 else {node: n}).items()}
        if not cuts:
            return levels
        levels.append(cuts)
        frame = _side(frame, cuts, dims)
    return levels


def with_points(docs: DataFrame, dims: list[str], size: Column, key: str) -> DataFrame:
    """``docs`` with the helper columns of a point: size, coordinates and tie hash."""
    kinds = dict(docs.dtypes)
    tie = F.xxhash64(F.col(key).cast("string")).bitwiseAND(TIES)
    return docs.withColumns({"_size": size.cast("bigint"), "_t": tie, **{f"_d{i}": code(F.col(d), kinds[d]) for i, d in enumerate(dims)}})


def kd_assign(points: DataFrame, dims: int, levels: list[list[Cut]]) -> DataFrame:
    """Add ``shard`` and drop the helper columns."""
    frame = points.withColumn("_node", F.expr(ROOT))
    for cuts in levels:
        frame = _side(frame, cuts, dims)
    return frame.withColumn("shard", F.col("_node")).drop("_node", "_size", "_t", *(f"_d{i}" for i in range(dims)))


def with_slots(rows: DataFrame, shards: int, order: list[str], slice_rows: int = 10_000) -> DataFrame:
    """Number the rows of each shard from 0 without gaps, in slices of bounded size.

    A shard's slices are numbered one after the other: offsets come from
    counts, so no task sees a whole shard.
    """
    total = rows.count()
    parts = max(16, -(-total // (max(1, shards) * slice_rows)))
    cut = rows.withColumn("_slice", F.pmod(F.xxhash64(*order, F.lit(5)), F.lit(parts)))
    counts = cut.groupBy("shard", "_slice").agg(F.count("*").alias("_n"))
    offsets = counts.select(F.col("shard").alias("_s"), F.col("_slice").alias("_p"),
                            (F.sum("_n").over(Window.partitionBy("shard").orderBy("_slice")) - F.col("_n")).alias("_offset"))
    within = F.row_number().over(Window.partitionBy("shard", "_slice").orderBy(*order)) - 1
    return cut.withColumn("_i", within).join(offsets, (F.col("shard") == F.col("_s")) & (F.col("_slice") == F.col("_p"))) \
        .withColumn("slot", (F.col("_offset") + F.col("_i")).cast("bigint")).drop("_s", "_p", "_offset", "_i", "_slice")
