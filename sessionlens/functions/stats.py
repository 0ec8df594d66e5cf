"""Exact column statistics that stay distributed: quantiles, imputation, scaling.

Results on the driver are a few numbers per column, never rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

ACCURACY = 10000  # of the sketch that brackets a quantile; the answer itself is exact


def present(name: str) -> str:
    """The value, with NaN counted as missing."""
    return f"nanvl(cast({name} as double), cast(null as double))"


def unpivot(frame: DataFrame, columns: list[str] | tuple[str, ...], keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., name, value) rows of the values that are there."""
    cells = ", ".join(f"named_struct('name', '{c}', 'value', {present(c)})" for c in columns)
    return frame.selectExpr(*keep, f"inline(array({cells}))").where("value is not null")


@dataclass(frozen=True)
class ColumnStats:
    rows: int
    count: dict[str, int]
    mean: dict[str, float | None]
    variance: dict[str, float | None]
    low: dict[str, float | None]
    high: dict[str, float | None]
    quantile: dict[str, float | None]


def column_stats(frame: DataFrame, columns: list[str] | tuple[str, ...], p: float | None = 0.5) -> ColumnStats:
    """Count, mean, population variance, range and (for ``p``) the exact p-quantile of each column.

    One pass gives the moments and a sketch that brackets the quantile; a second
    one counts what lies below the bracket and ranks the few values inside, so no
    task sees more than the bracket of one column.  Quantiles interpolate linearly.
    """
    columns = list(columns)
    near = f"percentile_approx(value, array({max(0.0, p - 3 / ACCURACY)}D, {min(1.0, p + 3 / ACCURACY)}D), {ACCURACY})" \
        if p is not None else "null"
    cells = unpivot(frame, columns)
    seen = {r["name"]: r for r in cells.groupBy("name").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("var"),
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.expr(near).alias("near")).collect()}
    rows = frame.count()

    def get(field: str, empty=None) -> dict:
        return {c: seen[c][field] if c in seen else empty for c in columns}

    found: dict[str, float | None] = dict.fromkeys(columns)
    if p is not None and seen:
        spread = {c: (r["near"][0], r["near"][1]) for c, r in seen.items()}
        found.update(_ranked(cells, {c: r["n"] for c, r in seen.items()}, spread, p))
        missed = [c for c in seen if found[c] is None]
        if missed:  # the sketch missed its bracket: rank the whole column
            wide = {c: (seen[c]["lo"], seen[c]["hi"]) for c in missed}
            found.update(_ranked(cells, {c: seen[c]["n"] for c in missed}, wide, p))
    return ColumnStats(rows, get("n", 0), get("mean"), get("var"), get("lo"), get("hi"), found)


def _ranked(cells: DataFrame, count: dict[str, int], spread: dict[str, tuple[float, float]], p: float) -> dict:
    """Quantiles of the columns in ``spread``, each searched between two values."""
    low = "map(" + ", ".join(f"'{c}', double('{lo!r}')" for c, (lo, _) in spread.items()) + ")"
    high = "map(" + ", ".join(f"'{c}', double('{hi!r}')" for c, (_, hi) in spread.items()) + ")"
    marked = cells.selectExpr("name", "value", f"{low}[name] lo", f"{high}[name] hi").where("value <= hi")
    # everything below the bracket collapses into one group per column before the shuffle
    counted = marked.selectExpr("name", "case when value < lo then null else value end value").groupBy(
        "name", "value").agg(F.count("*").alias("n"))
    order = Window.partitionBy("name").orderBy(F.asc_nulls_first("value"))
    placed = counted.withColumn("upto", F.sum("n").over(order))
    wanted = {c: (count[c] - 1) * p for c in spread}
    first = "map(" + ", ".join(f"'{c}', {int(w)}L" for c, w in wanted.items()) + ")[name]"
    hits = placed.where(f"value is not null and upto > {first} and upto - n <= {first} + 1").collect()  # <= 2 per column
    out: dict[str, float | None] = {}
    for c, w in wanted.items():
        at = int(w)
        own = sorted((h["value"], h["upto"] - h["n"], h["upto"]) for h in hits if h["name"] == c)
        left = next((v for v, a, b in own if a <= at < b), None)
        right = next((v for v, a, b in own if a <= at + 1 < b), left if at + 1 >= count[c] else None)
        if left is None or (right is None and w > at):
            out[c] = None
        else:
            out[c] = left if w == at else left + (right - left) * (w - at)
    return out


def exact_quantile(frame: DataFrame, column: str, p: float) -> float | None:
    return column_stats(frame, [column], p).quantile[column]


@dataclass(frozen=True)
class Preparation:
    """Fitted imputation and (optional) scaling.  Columns without any value are left out."""

    columns: tuple[str, ...]
    fill: dict[str, float]
    mean: dict[str, float]
    scale: dict[str, float]

    def filled(self, frame: DataFrame, *keep: str) -> DataFrame:
        return frame.selectExpr(*keep, *(f"coalesce({present(c)}, {self.fill[c]!r}D) {c}" for c in self.columns))

    def scaled(self, frame: DataFrame, *keep: str) -> DataFrame:
        return frame.selectExpr(*keep, *(
            f"(coalesce({present(c)}, {self.fill[c]!r}D) - {self.mean[c]!r}D) / {self.scale[c]!r}D {c}"
            for c in self.columns))


def fit_preparation(frame: DataFrame, columns: list[str] | tuple[str, ...], impute: str = "median") -> Preparation:
    """Median (exact) or mean imputation and the scale of the imputed columns (population deviation)."""
    if impute not in ("median", "mean"):
        raise ValueError(f"unknown imputation: {impute}")
    s = column_stats(frame, columns, 0.5 if impute == "median" else None)
    kept = tuple(c for c in columns if s.count[c])
    for c in kept:
        if not math.isfinite(s.low[c]) or not math.isfinite(s.high[c]):
            raise ValueError(f"column {c} holds an infinite value")
    fill = {c: s.quantile[c] if impute == "median" else s.mean[c] for c in kept}
    mean, scale = {}, {}
    for c in kept:
        n, k = s.rows, s.count[c]
        share = k / n
        mean[c] = share * s.mean[c] + (1 - share) * fill[c]
        variance = (share * (s.variance[c] + (s.mean[c] - mean[c]) ** 2) + (1 - share) * (fill[c] - mean[c]) ** 2)
        constant = s.low[c] == s.high[c] and (k == n or fill[c] == s.low[c])
        mean[c] = s.low[c] if constant else mean[c]
        scale[c] = 1.0 if constant or variance <= 0 else variance ** 0.5
    return Preparation(kept, fill, mean, scale)


def number_rows(frame: DataFrame, *order: str, name: str = "n") -> DataFrame:
    """Add the 0-based position in ``order`` without collecting rows in one task.

    ``frame`` is range-partitioned by the sort; positions inside partitions are
    shifted by the sizes of the earlier ones (one small row per partition).
    """
    from sessionlens.session import cut_lineage

    placed = cut_lineage(frame.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    sizes = sorted((r["p"], r["c"]) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("c")).collect())
    if not sizes:
        return placed.withColumn(name, F.lit(0).cast("bigint")).drop("_id")
    before, start = [], 0
    for p, c in sizes:
        before.append((p, start))
        start += c
    offsets = frame.sparkSession.createDataFrame(before, "_p bigint, _start bigint")
    return (placed.withColumn("_p", part).join(F.broadcast(offsets), "_p")  # one row per partition
            .withColumn(name, F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_p", "_start", "_id"))
