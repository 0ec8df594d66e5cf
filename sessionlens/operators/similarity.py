"""Exact top-k cosine matches in a history of sessions.

Vectors are standardised with history statistics and scaled to unit length.
Matches are ordered by similarity (compared at nine decimals), then by session
id and history row.

Plans with equal results:

* history that a size check proves small: broadcast it and answer each batch of
  queries by one matrix product, without any shuffle of the queries;
* larger history: distinct vectors in pivot tiles (``tiles``), a first look at
  the nearest cell for a lower bound and a second at the cells that may beat it.
  Where these are many, as in high dimensions, copying each query to every cell
  would outgrow the tables; there packed blocks meet without a shuffle
  (``kd_blocks``).

Either way each distinct history vector keeps only its k first sessions: no
other one can be among the k best.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from sessionlens.functions.numbers import clamp01, fixed, shortest
from sessionlens.functions.stats import number_rows
from sessionlens.operators.kd_blocks import Block, meet, pack
from sessionlens.operators.tiles import TILE_ROWS, blocks, home_only, matrix, nearest, nothing, route, tile_points, visit
from sessionlens.schema import SIMILARITY_FEATURES
from sessionlens.session import cut_lineage

BROADCAST_BYTES = 64 << 20  # history that is sent to all tasks: vectors and texts
VISIT_BYTES = 256 << 20  # visits of a second look that are made whatever their share
VISIT_SHARE = 0.1  # of all queries x cells; beyond it tiles no longer pay
HISTORY_BLOCK = 1 << 15  # history rows of a packed block
MATCH = "array<struct<session_id: string, similarity_score: double, failure_type: string, summary: string>>"


def history_table(signals: DataFrame, failure_type: str = "null", stored_latency: str = "null",
                  rule_count: str = "0", dataset_version: str = "null", pipeline_version: str = "null",
                  tool_latency: str = "average_tool_latency",
                  duration: str = "interview_duration_seconds") -> DataFrame:
    """Searchable history from wide signal rows: identity, known failure, summary, features.

    The arguments are SQL over ``signals``.
    """
    row = "row_id" if "row_id" in signals.columns else "0"
    shown = signals.selectExpr(
        "session_id", f"cast({row} as bigint) row_id", f"cast({failure_type} as string) failure_type",
        f"cast({duration} as double) d", f"cast({stored_latency} as double) l", f"cast({tool_latency} as double) t",
        f"cast({rule_count} as string) r", f"cast({dataset_version} as string) dv",
        f"cast({pipeline_version} as string) pv",
        *(f"coalesce({n}, 0.0D) {n}" for n in SIMILARITY_FEATURES))
    summary = (f"concat('duration_seconds=', {fixed('d')}, '; average_llm_latency_ms=', {shortest('l')},"
               f" '; average_tool_latency_ms=', {fixed('t')}, '; supporting_rule_count=', r,"
               f" '; dataset_version=', coalesce(dv, 'None'), '; pipeline_version=', coalesce(pv, 'None'))")
    return shown.selectExpr("session_id", "row_id", "failure_type", f"{summary} summary", *SIMILARITY_FEATURES)


def history_of_sessions(sessions: DataFrame) -> DataFrame:
    """History from nested sessions that carry signal columns (stored signals preferred).

    The summary shows the recorded duration and tool latency even where stored signals differ.
    """
    staged = sessions.selectExpr(
        "*", "filter(transform(timeline, e -> unix_micros(e.timestamp)), x -> x is not null) _seen",
        "filter(transform(tool_calls, c -> c.duration_ms), x -> x is not null) _spent")
    return history_table(
        staged, "ground_truth.expected_failure_type", "metrics.avg_llm_latency_ms",
        "coalesce(size(diagnosis.rules_triggered), 0)", "dataset_version", "pipeline_version",
        "case when size(_spent) > 0 then aggregate(_spent, 0.0D, (a, x) -> a + x) / size(_spent) else 0.0D end",
        "coalesce((array_max(_seen) - array_min(_seen)) / 1e6D, 0.0D)")


def index_statistics(history: DataFrame, features: tuple[str, ...] = SIMILARITY_FEATURES) -> list[tuple[float, float]]:
    """Mean and population deviation per feature (deviation 0 counts as 1); one pass."""
    row = history.selectExpr(*(f"{f}({n})" for n in features for f in ("avg", "stddev_pop"))).first()
    return [(row[2 * i] or 0.0, row[2 * i + 1] or 1.0) for i in range(len(features))]


def unit_vector(stats: list[tuple[float, float]], features: tuple[str, ...] = SIMILARITY_FEATURES) -> str:
    """Standardised features at unit length (SQL); a zero vector stays zero."""
    scaled = ", ".join(f"(coalesce(cast({n} as double), 0.0D) - {m!r}D) / {s!r}D"
                       for n, (m, s) in zip(features, stats))
    return f"array({scaled})"


def with_unit_vector(frame: DataFrame, array: str, name: str = "vec") -> DataFrame:
    # adding 0.0 turns -0.0 into 0.0, so that equal vectors are equal keys
    return (frame.selectExpr("*", f"{array} _raw")
            .selectExpr("*", "sqrt(aggregate(_raw, 0.0D, (a, x) -> a + x * x)) _norm")
            .selectExpr("* except (_raw, _norm)",
                        f"transform(_raw, x -> case when _norm = 0 then 0.0D else x / _norm end + 0.0D) {name}"))


# ---------------------------------------------------------------------------


def _best(queries: np.ndarray, history: np.ndarray, k: int):
    """(query, row, similarity) of the k best rows, ties by row number; rows come in tie order.

    Both sides are taken in blocks and only the k best so far are kept, so memory does
    not grow with the history.
    """
    found = []
    for part in blocks(len(queries)):
        own = queries[part]
        floor = np.full(len(own), -np.inf)  # similarity of the k-th best so far
        i, j, s = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        for there in blocks(len(history), TILE_ROWS):
            scores = own @ history[there].T
            if not there.start and k < scores.shape[1]:
                least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k] - 1e-9
            else:  # of equal similarities the earlier row counts; rounding moves one by half of 1e-9
                least = floor + 4e-10
            a, b = np.nonzero(scores >= least[:, None])
            if not len(a):
                continue
            i, j = np.concatenate([i, a]), np.concatenate([j, b + there.start])
            s = np.concatenate([s, np.round(scores[a, b], 9) + 0.0])
            order = np.lexsort((j, -s, i))
            i, j, s = i[order], j[order], s[order]
            place = np.arange(len(i)) - np.searchsorted(i, i, side="left")
            floor[i[place == k - 1]] = s[place == k - 1]
            i, j, s = i[place < k], j[place < k], s[place < k]
        found.append((i + part.start, j, s))
    return [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, int)] * 2 + [np.zeros(0)]


def _first_members(history: DataFrame, k: int) -> DataFrame:
    """At most k sessions per distinct vector; the limit is applied before the shuffle."""
    order = Window.partitionBy("vec").orderBy("session_id", "row_id")
    return history.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _broadcast_matches(queries: DataFrame, rows: list, k: int) -> DataFrame:
    spark = queries.sparkSession
    shared = spark.sparkContext.broadcast((
        np.array([r["vec"] for r in rows], dtype=float),
        np.array([r["session_id"] for r in rows], dtype=object),
        np.array([r["failure_type"] for r in rows], dtype=object),
        np.array([r["summary"] for r in rows], dtype=object),
    ))

    @F.pandas_udf("struct<ids: array<string>, scores: array<double>, kinds: array<string>, notes: array<string>>")
    def search(vec: pd.Series) -> pd.DataFrame:
        history, ids, kinds, notes = shared.value
        if not len(vec):
            return nothing("ids", "scores", "kinds", "notes")
        i, j, s = _best(matrix(vec), history, k)
        cut = np.searchsorted(i, np.arange(1, len(vec)))

        def per_query(values: np.ndarray) -> list[list]:
            return [part.tolist() for part in np.split(values, cut)]

        return pd.DataFrame({"ids": per_query(ids[j]), "scores": per_query(s), "kinds": per_query(kinds[j]),
                             "notes": per_query(notes[j])})

    found = queries.withColumn("_found", search("vec"))
    score = clamp01("_found.scores[i]")
    return found.selectExpr(
        "* except (_found)",
        "transform(_found.ids, (id, i) -> named_struct('session_id', id, 'similarity_score', "
        f"{score}, 'failure_type', _found.kinds[i], 'summary', _found.notes[i])) similar")


def _lift(vec: str, extra: int) -> str:
    """Two more coordinates give zero vectors unit length without changing any product."""
    own = ", ".join("1.0D" if i == extra else "0.0D" for i in range(2))
    return f"concat({vec}, case when forall({vec}, x -> x = 0) then array({own}) else array(0.0D, 0.0D) end)"


def _block_matches(asked: DataFrame, points: DataFrame, k: int, rows: int = HISTORY_BLOCK) -> DataFrame:
    """(qid, pid, score) of the k best of ``points`` for each of ``asked``, by blocks that all meet."""
    zone = F.pmod(F.xxhash64("vec"), F.lit(1 << 20)).cast("int").alias("zone")
    known = cut_lineage(number_rows(points.select("pid", "vec", "session_id", "row_id"), "session_id", "row_id", "pid", name="ord").select("pid", "vec", "ord"))
    left = pack(asked.select("qid", "vec", zone), asked.count(), "qid", rows=rows // 2)
    right = pack(known.select("ord", "vec", zone), known.count(), "ord", rows=rows)

    def compare(queries: Block, history: Block) -> pd.DataFrame:
        order = history.of["ord"].argsort()
        i, j, s = _best(queries.vec, history.vec[order], k)
        return pd.DataFrame({"qid": queries.of["qid"][i], "ord": history.of["ord"][order[j]], "score": s})

    found = meet(left, right, ("qid",), ("ord",), compare, "qid bigint, ord bigint, score double")
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "ord")
    top = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")
    return top.join(known.select("pid", "ord"), "ord").select("qid", "pid", "score")


def _visits(bounded: DataFrame, cells, radius) -> int:
    """How many cells all queries together must look into."""
    def run(batches):
        n = 0
        for batch in batches:
            points = matrix(batch["vec"])
            n += sum(int(cells.reach(points[part], radius(batch.iloc[part])).sum()) for part in blocks(len(batch)))
        yield pd.DataFrame({"n": [n]})
    return bounded.mapInPandas(run, "n bigint").agg(F.sum("n")).first()[0] or 0


def _tile_matches(asked: DataFrame, points: DataFrame, k: int, tile_rows: int, pivots: int | None) -> DataFrame:
    """(qid, pid, score) of the k best by pivot tiles, unless they would be visited too often."""
    tiles, cells = tile_points(points, points.count(), tile_rows, pivots)
    schema = "qid bigint, pid bigint, session_id string, row_id bigint, score double"

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return nothing("qid", "pid", "session_id", "row_id", "score")
        right = right.sort_values(["session_id", "row_id", "pid"])
        i, j, s = _best(matrix(left["vec"]), matrix(right["vec"]), k)
        hit = right.iloc[j]
        return pd.DataFrame({"qid": left["qid"].to_numpy()[i], "pid": hit["pid"].to_numpy(),
                             "session_id": hit["session_id"].to_numpy(), "row_id": hit["row_id"].to_numpy(),
                             "score": s})

    narrow = asked.select("qid", "vec")
    first = cut_lineage(visit(home_only(narrow, cells), tiles, cells, "qid", compare, schema, tile_rows))
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "session_id", "row_id", "pid")
    kth = first.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select("qid", F.col("score").alias("kth"))
    bounded = narrow.join(kth, "qid", "left").withColumn("kth", F.coalesce("kth", F.lit(-1.0)))

    dimension = len(cells.pivots[0])

    def radius(rows: pd.DataFrame) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (rows["kth"].to_numpy() - 2e-9)))

    def at_home(rows: pd.DataFrame, mask: np.ndarray) -> np.ndarray:
        """The home cell has been seen whole, unless it is split."""
        seen = np.zeros_like(mask)
        seen[np.arange(len(rows)), nearest(matrix(rows["vec"]), cells.pivots)[0]] = True
        return seen & (cells.salts <= 1)[None, :]

    visits = _visits(bounded, cells, radius)
    if visits * (8 * dimension + 32) > VISIT_BYTES and visits > VISIT_SHARE * asked.count() * len(cells.pivots):
        return _block_matches(asked, points, k)
    onward = cut_lineage(route(bounded, cells, radius, at_home))
    second = visit(onward, tiles, cells, "qid", compare, schema, tile_rows, radius, seen=True)
    return first.unionByName(second).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).select("qid", "pid", "score")


def _tiled_matches(queries: DataFrame, members: DataFrame, k: int, dimension: int, tile_rows: int,
                   pivots: int | None, only_blocks: bool = False) -> DataFrame:
    """Top-k per distinct query vector; returns (vec, similar)."""
    points = cut_lineage(
        members.where("rank = 1").selectExpr(f"{_lift('vec', 0)} vec", "session_id", "row_id",
                                             "monotonically_increasing_id() pid"))
    asked = cut_lineage(queries.select(F.col("vec").alias("query")).distinct()
                        .selectExpr("query", "monotonically_increasing_id() qid", f"{_lift('query', 1)} vec"))
    top = _block_matches(asked, points, k) if only_blocks else _tile_matches(asked, points, k, tile_rows, pivots)
    # from vectors back to the sessions that share them
    owners = points.select("pid", F.slice("vec", 1, dimension).alias("vec")).join(top, "pid").select("qid", "vec", "score")
    rows = owners.join(members.select("vec", "session_id", "row_id", "failure_type", "summary"), "vec")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "session_id", "row_id")
    rows = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    match = F.expr(f"named_struct('r', r, 'session_id', session_id, 'similarity_score', {clamp01('score')},"
                   " 'failure_type', failure_type, 'summary', summary)")
    lists = rows.groupBy("qid").agg(F.sort_array(F.collect_list(match)).alias("m"))  # at most k entries each
    return asked.join(lists, "qid").selectExpr(
        "query vec", "transform(m, x -> named_struct('session_id', x.session_id, 'similarity_score',"
        " x.similarity_score, 'failure_type', x.failure_type, 'summary', x.summary)) similar")


def top_matches(queries: DataFrame, history: DataFrame, k: int = 5, plan: str = "auto",
                broadcast_bytes: int = BROADCAST_BYTES, tile_rows: int = TILE_ROWS,
                pivots: int | None = None) -> DataFrame:
    """Add ``similar`` to ``queries``; both sides carry a unit vector ``vec``.

    ``history`` has session_id, row_id, failure_type, summary and vec.  ``plan`` is
    ``auto`` (broadcast behind a size check), ``broadcast``, ``tiles`` or ``blocks``.
    """
    nothing = queries.withColumn("similar", F.array().cast(MATCH))
    if k <= 0:
        return nothing
    members = _first_members(history, k)
    if plan not in ("tiles", "blocks"):
        # the bytes of what would be sent are added up; only a history that fits is collected
        members = cut_lineage(members)
        text = " + ".join(f"coalesce(octet_length({c}), 0L)" for c in ("session_id", "failure_type", "summary"))
        size = members.agg(F.expr(f"sum({text} + 8L * size(vec) + 64L)")).first()[0]
        if size is None:
            return nothing
        if size <= broadcast_bytes:
            return _broadcast_matches(queries, members.orderBy("session_id", "row_id").collect(), k)
        if plan == "broadcast":
            raise ValueError(f"history exceeds {broadcast_bytes} bytes")
    else:
        members = cut_lineage(members)
    sample = members.select("vec").first()
    if sample is None:
        return nothing
    answers = _tiled_matches(queries, members, k, len(sample["vec"]), tile_rows, pivots, plan == "blocks")
    return queries.join(answers, "vec", "left")


def find_similar(signals: DataFrame, history: DataFrame | None, k: int = 5, **options) -> DataFrame:
    """Add ``similar`` to wide signal rows from a ``history_table`` (or none)."""
    if history is None:
        return signals.withColumn("similar", F.array().cast(MATCH))
    stats = index_statistics(history)
    raw = unit_vector(stats)
    return top_matches(with_unit_vector(signals, raw), with_unit_vector(history, raw), k, **options).drop("vec")


def matches(frame: DataFrame, *keys: str) -> DataFrame:
    """``similar`` as rows with their 1-based rank."""
    keys = keys or ("session_id",)
    return frame.selectExpr(*keys, "posexplode(similar) as (pos, m)").selectExpr(
        *keys, "cast(pos + 1 as bigint) rank", "m.session_id match_session_id",
        "m.similarity_score similarity_score", "m.failure_type failure_type", "m.summary summary")
