"""Feature and label drift between two feature tables.

Two passes over the features (joint range, then histogram), each one
map-side-combined aggregation to one row per feature; nothing else is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sessionlens.functions.stats import unpivot
from sessionlens.schema import FEATURES

EPSILON = 1e-12
LABEL_GROUPS = ("root_cause", "failure_category", "affected_component")


class DriftError(ValueError):
    """The two tables cannot be compared."""


def _check(baseline: DataFrame, current: DataFrame, features: tuple[str, ...]) -> None:
    order = [[c for c in frame.columns if c in set(features)] for frame in (baseline, current)]
    if order[0] != order[1]:
        raise DriftError("the two tables order their features differently")
    if len(order[0]) != len(features):
        raise DriftError("some of the features are missing")


def _sides(baseline: DataFrame, current: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return baseline.selectExpr("0 side", *columns).unionByName(current.selectExpr("1 side", *columns))


def feature_drift(baseline: DataFrame, current: DataFrame, features: tuple[str, ...] = FEATURES,
                  threshold: float = 0.1, bins: int = 10) -> DataFrame:
    """Jensen-Shannon divergence, PSI and the shifted flag per feature.

    Equal-width bins over the joint range, the last one closed; a range edge is
    ``low + i * width``.  Missing values are left out.
    """
    _check(baseline, current, features)
    return histogram_drift(unpivot(_sides(baseline, current, features), features, ("side",)), features, threshold, bins)


def histogram_drift(cells: DataFrame, features: tuple[str, ...], threshold: float = 0.1, bins: int = 10) -> DataFrame:
    """The same from (side, name, value) rows; side 0 is the baseline."""
    spark = cells.sparkSession
    ranges = cells.groupBy("name").agg(
        F.min("value").alias("low"), F.max("value").alias("high"),
        F.count_if(F.col("side") == 0).alias("n0"), F.count_if(F.col("side") == 1).alias("n1"))
    # one row per feature, so the broadcast has a fixed size
    placed = cells.join(F.broadcast(ranges.selectExpr("name", "low", f"(high - low) / {bins} width")), "name").selectExpr(
        "name", "side", " + ".join(f"cast(value >= {i} * width + low as int)" for i in range(1, bins)) + " bin")
    counts = placed.groupBy("name").agg(*(
        F.count_if((F.col("side") == side) & (F.col("bin") == b)).alias(f"c{side}_{b}")
        for side in (0, 1) for b in range(bins)))

    def share(side: int) -> str:
        smoothed = ", ".join(f"c{side}_{b} + {EPSILON}D" for b in range(bins))
        return f"array({smoothed}) s{side}"

    names = spark.range(1).selectExpr("posexplode(array(" + ", ".join(f"'{f}'" for f in features) + ")) as (position, name)")
    joined = names.join(F.broadcast(ranges), "name", "left").join(F.broadcast(counts), "name", "left")
    total = "aggregate({0}, 0.0D, (a, x) -> a + x)"
    p = joined.selectExpr("*", share(0), share(1)).selectExpr(
        "*", f"transform(s0, x -> x / {total.format('s0')}) p", f"transform(s1, x -> x / {total.format('s1')}) q")
    kl = "aggregate(zip_with({0}, {1}, (a, b) -> a * ln(2 * a / (a + b))), 0.0D, (s, x) -> s + x)"
    scored = p.selectExpr(
        "cast(position as bigint) position", "name feature_name", "coalesce(n0, 0) n0", "coalesce(n1, 0) n1", "low", "high",
        f"0.5D * ({kl.format('p', 'q')} + {kl.format('q', 'p')}) js",
        "aggregate(zip_with(p, q, (a, b) -> (b - a) * ln(b / a)), 0.0D, (s, x) -> s + x) psi")
    flat = "(n0 = 0 and n1 = 0) or (n0 > 0 and n1 > 0 and low = high)"
    return scored.selectExpr(
        "position", "feature_name",
        f"case when {flat} then 0.0D when n0 = 0 or n1 = 0 then 1.0D else js end jensen_shannon_divergence",
        f"case when {flat} then 0.0D when n0 = 0 or n1 = 0 then 1.0D else psi end population_stability_index",
        f"case when {flat} then false when n0 = 0 or n1 = 0 then true else js >= {threshold}D end shifted",
        "(n0 > 0) = (n1 > 0) comparable")


def label_drift(baseline: DataFrame, current: DataFrame, groups: tuple[str, ...] = LABEL_GROUPS) -> DataFrame:
    """Share of every label on both sides and its change in points; missing is ``unlabeled``."""
    cells = ", ".join(f"named_struct('label_group', '{g}', 'label', coalesce(nullif({g}, ''), 'unlabeled'))" for g in groups)
    counts = _sides(baseline, current, groups).selectExpr("side", f"inline(array({cells}))").groupBy(
        "label_group", "label").agg(F.count_if(F.col("side") == 0).alias("n0"), F.count_if(F.col("side") == 1).alias("n1"))
    # one row per label from here on
    whole = counts.selectExpr("*", "sum(n0) over (partition by label_group) t0", "sum(n1) over (partition by label_group) t1")
    return whole.selectExpr(
        "label_group", "label",
        "case when t0 > 0 then 100.0D * n0 / t0 else 0.0D end baseline_percentage",
        "case when t1 > 0 then 100.0D * n1 / t1 else 0.0D end current_percentage",
    ).selectExpr("*", "current_percentage - baseline_percentage percentage_change")


def drift_summary(features: DataFrame) -> DataFrame:
    return features.selectExpr(
        "count_if(shifted) shifted_feature_count",
        "coalesce(max(jensen_shannon_divergence), 0.0D) largest_drift",
        "coalesce(avg(jensen_shannon_divergence), 0.0D) average_drift",
        "coalesce(avg(jensen_shannon_divergence), 0.0D) overall_drift_score")


def largest_shift(features: DataFrame) -> DataFrame:
    """Name and divergence of the worst shifted feature, ``None`` without one (first on ties)."""
    from sessionlens.functions.numbers import fixed
    best = features.selectExpr(
        "max_by(feature_name, struct(jensen_shannon_divergence, -position)) filter (where shifted) f",
        "max(jensen_shannon_divergence) filter (where shifted) d")
    return best.selectExpr(f"case when f is null then 'None' else concat(f, ' (', {fixed('d')}, ')') end largest_shifted_feature")


def feature_bands(features: DataFrame) -> DataFrame:
    d = "jensen_shannon_divergence"
    return features.selectExpr("*", f"case when {d} < 0.1 then 'low' when {d} < 0.3 then 'medium' else 'high' end band")


def label_bands(labels: DataFrame) -> DataFrame:
    d = "abs(percentage_change)"
    return labels.selectExpr("*", f"case when {d} < 2 then 'low' when {d} < 5 then 'medium' else 'high' end band")
