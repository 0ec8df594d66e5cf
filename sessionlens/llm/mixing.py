"""Mixing sources to target weights by capped water-filling.

Every source may be used for at most ``max_epochs`` epochs.  Targets start in
proportion to the weights; sources whose share exceeds their cap are clamped
and the excess goes to the others in proportion to their weights, until no
source is above its cap.  A target is then met by whole repetitions of all its
documents and one fractional repetition: the documents whose seeded hash lies
under a cut that makes their sizes add up to the rest.

Defined cases: a null source is a source of its own; documents of size 0 or
null take part with size 0; weights of 0 or null give target 0; repeated rows
with the same key are taken together; when all caps together are below the
budget every source stops at its cap; an empty table gives an empty result.
Input columns that have the name of a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from sessionlens.llm.common import keep

SLICES = 1024  # the hash range is cut into so many slices to find where a fractional repetition ends
STEP = (1 << 60) // SLICES


def seeded_hash(key: Column, seed: int) -> Column:
    """60 uniform bits of a key, the same in every engine that has md5."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def water_fill(sources: DataFrame, budget: float) -> DataFrame:
    """Add ``target`` to rows of ``weight`` and ``cap``; two sums per round reach the driver."""
    weight, cap = F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)), F.col("cap").cast("double")
    level, clamped = 0.0, -1
    while True:
        full = (cap <= weight * level) | (weight <= 0)
        caps, free, count = sources.agg(F.sum(F.when(full, F.when(weight > 0, cap).otherwise(0.0)).otherwise(0.0)),
                                        F.sum(F.when(full, 0.0).otherwise(weight)), F.count_if(full)).first()
        if not free or count == clamped:
            break
        level, clamped = max(level, (budget - caps) / free), count
    target = F.when(weight > 0, F.least(cap, weight * level)).otherwise(0.0)
    return sources.withColumn("target", target if free else F.when(weight > 0, cap).otherwise(0.0))


def plan_mix(docs: DataFrame, weights: DataFrame, *, key: str = "doc_id", size: str = "size", source: str = "source",
             budget: float | None = None, max_epochs: float = 3, seed: int = 17) -> DataFrame:
    """Per source: size, target, whole repetitions and the hash up to which documents get one more.

    ``weights`` has ``source`` and ``weight``; sources that it lacks weigh
    nothing.  The budget is the size of all documents unless given.
    """
    rows = docs.select(F.col(source).alias("source"), F.coalesce(F.col(size).cast("bigint"), F.lit(0)).alias("size"),
                       seeded_hash(F.col(key), seed).alias("u"))
    slices = keep(rows.groupBy("source", F.expr(f"u div {STEP}").alias("slice")).agg(F.sum("size").alias("mass")), "slices")
    sizes = slices.groupBy("source").agg(F.sum("mass").alias("source_size"))
    given = weights.select(F.col("source").alias("given"), F.col("weight").cast("double").alias("weight"))
    sources = keep(sizes.join(given, sizes.source.eqNullSafe(given.given), "left").drop("given")
                   .withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))), "sources")
    if budget is None:
        budget = float(sources.agg(F.sum("source_size")).first()[0] or 0)
    filled = water_fill(sources, budget)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    filled = keep(filled.withColumn("whole", epochs).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "targets")

    def beside(frame: DataFrame, *extra: str) -> DataFrame:
        other = filled.select(F.col("source").alias("of"), "rest", *extra)
        return frame.join(other, frame.source.eqNullSafe(other.of)).drop("of")

    upto = Window.partitionBy("source").orderBy("slice")
    cut = beside(slices).withColumn("before", F.sum("mass").over(upto) - F.col("mass")) \
        .where("before <= rest and rest < before + mass").select("source", "slice", "before", "rest")
    cut = keep(cut, "cut")
    of = cut.select(F.col("source").alias("of"), F.col("slice").alias("at"), "before", "rest")
    last = rows.join(of, rows.source.eqNullSafe(of.of) & (F.expr(f"u div {STEP}") == of["at"])) \
        .groupBy("source", "u").agg(F.sum("size").alias("size"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    ahead = Window.partitionBy("source").orderBy("u")
    last = last.withColumn("upto", F.col("before") + F.sum("size").over(ahead)) \
        .where("upto - size / 2 <= rest").groupBy("source").agg(F.max("u").alias("u"))
    ends = keep(cut.join(last.withColumnRenamed("source", "of"), cut.source.eqNullSafe(F.col("of")), "left")
                .select(F.col("source").alias("of"), F.coalesce("u", F.col("slice") * STEP - 1).alias("upto")), "ends")
    # a rest of a whole source (no slice straddles it) cannot be: the rest is below the source's size
    return keep(filled.join(ends, filled.source.eqNullSafe(ends.of), "left")
                .select("source", "source_size", "target", "whole", F.coalesce("upto", F.lit(-1)).alias("upto")), "plan")


def mix(docs: DataFrame, plan: DataFrame, *, key: str = "doc_id", source: str = "source", max_epochs: float = 3,
        seed: int = 17) -> DataFrame:
    """All documents with ``source_size``, ``target`` and ``copies``, how often the mix holds the document."""
    ours = plan.select(F.col("source").alias("_mix_source"), *(F.col(c).alias(f"_mix_{c}") for c in plan.columns if c != "source"))
    joined = docs.join(ours, docs[source].eqNullSafe(ours["_mix_source"]), "left")
    extra = (seeded_hash(docs[key], seed) <= F.col("_mix_upto")).cast("bigint")
    copies = F.least(F.coalesce(F.col("_mix_whole") + extra, F.lit(0)), F.lit(int(-(-max_epochs // 1))))
    return joined.withColumns({"source_size": F.col("_mix_source_size"), "target": F.col("_mix_target"), "copies": copies}) \
        .drop(*ours.columns)


def repeated(mixed: DataFrame, *columns: str) -> DataFrame:
    """The mix itself: every document as often as ``copies`` says."""
    times = F.explode(F.expr("case when copies > 0 then sequence(1L, copies) else array() end"))
    return mixed.select(*columns, times.alias("_mix_time")).drop("_mix_time")


def ranked_weights(docs: DataFrame, source: str = "source", cycle: int = 3) -> DataFrame:
    """Sources by code point, null last, weigh 1, 2 ... ``cycle``, repeating; one row per source."""
    names = docs.groupBy(F.col(source).alias("source")).count()
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    return names.select("source", ((rank - 1) % cycle + 1).cast("double").alias("weight"))
