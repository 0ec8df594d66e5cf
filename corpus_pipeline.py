"""The corpus pipeline: documents in, placed documents of the mix out.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept; all but the last return the columns of documents, whatever else they
are called.  Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sessionlens.llm import decontaminate, mixing, ngram_join, quality, sharding
from sessionlens.llm.common import free_name, keep

WORD = r"[^\x20\x09-\x0D]+"
SHARDS = 24


def whole(docs: DataFrame) -> DataFrame:
    """Rows as one struct, so that no column of theirs meets one that an operator adds."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_whole"))


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts are scored as texts without words; equal rows have equal scores and stay or go together.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.score(whole(docs), quality.train(docs.select("doc_id", "text"), labels), text="_whole.text")
    return scored.where("predicted = 1").select("_whole.*")


def jaccard_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id.

    Documents without words are in no group and stay; of rows that repeat id and text one stays.
    """
    groups = keep(ngram_join.jaccard_components(docs.select("doc_id", "text")), "groups")
    return ngram_join.one_of_each(whole(docs), groups, key="_whole.doc_id", text="_whole.text", group_key="doc_id").select("_whole.*")


def decontamination_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain an item of the benchmark go, with the rows that repeat their id and text.

    Null and empty texts hold no item.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.find_items(docs.select("doc_id", "text"), benchmark)
    return decontaminate.without_items(whole(docs), found, key="_whole.doc_id", text="_whole.text").select("_whole.*")


def mixing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix holds it: sources weigh 1, 2, 3 by code point, three epochs at most.

    Null sources are one source; rows that share an id share their draw; empty texts have size 0 and take the copies of their draw.
    """
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    small = keep(docs.select("doc_id", "source", words.alias("_words")), "sizes")
    plan = mixing.plan_mix(small, mixing.ranked_weights(small), size="_words")
    return mixing.repeated(mixing.mix(whole(docs), plan, key="_whole.doc_id", source="_whole.source"), "_whole").select("_whole.*")


def sharding_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard: k-d cells over language, length and checksum of near equal bytes.

    Null languages and texts have places of their own in the order; rows that agree in all dimensions are parted by a
    hash of the id.  Where the documents have a column ``shard``, it stays and the new one is called ``_shard``.
    """
    dims = ["_lang", "_bytes", "_crc"]
    text = F.col("_whole.text")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")
    coordinates = {"_lang": F.col("_whole.lang"), "_bytes": size, "_crc": F.coalesce(F.crc32(text), F.lit(0)).cast("bigint")}
    placed = sharding.with_points(whole(docs).withColumns(coordinates), dims, size + 8, "_whole.doc_id")
    points = keep(placed.select("_size", "_t", *(f"_d{i}" for i in range(len(dims)))), "points")
    levels = sharding.kd_cuts(points, len(dims), SHARDS)
    return sharding.kd_assign(placed, len(dims), levels).select("_whole.*", F.col("shard").alias(free_name(docs, "shard")))


STAGES = [("quality", quality_stage), ("jaccard", jaccard_stage), ("decontamination", decontamination_stage), ("mixing", mixing_stage),
          ("sharding", sharding_stage)]


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier, the mix of what it keeps and the cells have no SQL form.
ORACLE_SQL = None
