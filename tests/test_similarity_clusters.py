import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sessionlens.operators import anomaly, clusters, similarity, tiles
from sessionlens.schema import FEATURES, SIMILARITY_FEATURES
from sessionlens.session import cut_lineage


def signals(spark, rows):
    names = SIMILARITY_FEATURES
    return spark.createDataFrame([(sid, *(float(v.get(n, 0.0)) for n in names)) for sid, v in rows],
                                 "session_id string, " + ", ".join(f"{n} double" for n in names))


def test_empty_history_and_zero_k(spark):
    q = signals(spark, [("a", {})])
    assert similarity.find_similar(q, None).first()["similar"] == []
    assert similarity.find_similar(q, similarity.history_table(q.where("false"))).first()["similar"] == []
    assert similarity.find_similar(q, similarity.history_table(q), k=0).first()["similar"] == []


def test_self_first_and_descending(spark):
    h = signals(spark, [(n, {"average_llm_latency_ms": v, "retry_count": r}) for n, v, r in (("a", 100, 0), ("b", 1000, 3), ("c", 10000, 1))])
    found = similarity.find_similar(h.where("session_id = 'b'"), similarity.history_table(h)).first()["similar"]
    scores = [m["similarity_score"] for m in found]
    assert found[0]["session_id"] == "b" and len(found) == 3 and scores == sorted(scores, reverse=True)


@pytest.mark.parametrize("plan", ["auto", "tiles"])
def test_duplicates_are_kept_and_no_variance_scores_zero(spark, plan):
    h = signals(spark, [("a", {"retry_count": 1}), ("a", {"retry_count": 1})])
    found = similarity.find_similar(h.limit(1), similarity.history_table(h), k=10, plan=plan).first()["similar"]
    assert [(m["session_id"], m["similarity_score"]) for m in found] == [("a", 0.0), ("a", 0.0)]


def test_size_check_refuses_a_large_broadcast(spark):
    h = signals(spark, [(str(i), {"retry_count": i}) for i in range(5)])
    with pytest.raises(ValueError):
        similarity.find_similar(h, similarity.history_table(h), plan="broadcast", broadcast_bytes=400)


@pytest.mark.parametrize("k, tile_rows, pivots", [(1, 16, 5), (5, 20, 8), (40, 7, 3)])
def test_tiles_equal_broadcast_equal_brute_force(spark, k, tile_rows, pivots):
    """A third of the history is one and the same vector, ties and zero vectors included."""
    rng = np.random.default_rng(5)
    rows = [(f"s{i:03d}", {n: float(rng.integers(0, 4)) for n in SIMILARITY_FEATURES[:5]}) for i in range(120)]
    rows += [(f"t{i:03d}", {"retry_count": 3.0}) for i in range(60)]
    h = signals(spark, rows)
    q = h.where("session_id < 's040' or session_id = 't001'")
    history = similarity.history_table(h)

    def answers(**options):
        found = similarity.matches(similarity.find_similar(q, history, k, **options))
        return [(r["session_id"], r["rank"], r["match_session_id"], round(r["similarity_score"], 8))
                for r in found.orderBy("session_id", "rank").collect()]

    tiled = answers(plan="tiles", tile_rows=tile_rows, pivots=pivots)
    assert tiled == answers()
    x = np.array([[v.get(n, 0.0) for n in SIMILARITY_FEATURES] for _, v in rows])
    sd = x.std(0)
    z = (x - x.mean(0)) / np.where(sd == 0, 1, sd)
    norm = np.linalg.norm(z, axis=1, keepdims=True)
    u = np.divide(z, norm, out=np.zeros_like(z), where=norm > 0)
    ids = [r[0] for r in rows]
    at = {s: i for i, s in enumerate(ids)}
    for sid in sorted({a[0] for a in tiled}):
        s = np.round(u @ u[at[sid]], 9)
        want = sorted(range(len(ids)), key=lambda j: (-s[j], ids[j]))[:k]
        assert [a[2] for a in tiled if a[0] == sid] == [ids[j] for j in want]


def brute(x, eps, least):
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= eps
    core, label, number = near.sum(1) >= least, -np.ones(len(x), int), 0
    for i in range(len(x)):
        if label[i] != -1 or not core[i]:
            continue
        stack, label[i] = [i], number
        while stack:
            j = stack.pop()
            if core[j]:
                for m in np.nonzero(near[j])[0]:
                    if label[m] == -1:
                        label[m] = number
                        stack.append(m)
        number += 1
    return label


@pytest.mark.parametrize("eps, least, tiling", [(0.4, 5, {}), (0.4, 5, dict(tile_rows=40, pivots=7)), (0.25, 3, dict(tile_rows=16, pivots=3))])
def test_dbscan_equals_brute_force(spark, eps, least, tiling):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, .5, (120, 3)), rng.normal(3, .3, (100, 3)), rng.uniform(-4, 6, (60, 3)),
                   np.repeat([[9., 9., 9.]], 90, 0), np.repeat([[9., 9., 9.9]], 3, 0)])
    rng.shuffle(x)
    frame = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "ord long, vec array<double>")
    got = {r["ord"]: r["cluster_id"] for r in clusters.dbscan(frame, eps, least, **tiling).collect()}
    assert [got[i] for i in range(len(x))] == brute(x, eps, least).tolist()


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(0, 60) if i != 30] + [(100, 200), (200, 300), (7, 7)]
    random.seed(1)
    random.shuffle(edges)
    roots = {r["node"]: r["root"] for r in clusters.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {roots[i] for i in range(31)} == {0} and {roots[i] for i in range(31, 61)} == {31}
    assert {roots[i] for i in (100, 200, 300)} == {100}


def table(spark, points):
    return spark.createDataFrame([(f"s{i:02d}", float(a), float(b)) for i, (a, b) in enumerate(points)], "session_id string, x double, y double")


POINTS = [(0, 0), (.1, 0), (0, .1), (.1, .1), (.05, .05), (3, 3), (3.1, 3), (3, 3.1), (3.1, 3.1), (3.05, 3.05), (20, 20)]


def test_anomaly_report_of_two_clusters_and_a_remote_point(spark):
    records = anomaly.analyze_anomalies(table(spark, POINTS), ("x", "y"), min_samples=3)
    rows = {r["session_id"]: r for r in records.collect()}
    far = rows["s10"]
    assert len(rows) == 11 and far["is_noise"] and far["is_anomaly"] and far["is_unknown_failure"]
    assert far["anomaly_score"] == max(r["anomaly_score"] for r in rows.values())
    totals = anomaly.anomaly_totals(records).first()
    assert totals["noise_point_count"] >= 1 and totals["anomaly_count"] >= 1
    assert sum(r["session_count"] for r in anomaly.cluster_statistics(records).collect()) == 11


def test_anomaly_scores_do_not_depend_on_partitions(spark):
    points = table(spark, POINTS * 30).selectExpr("session_id key", "array(x, y) vec")
    a = {r["key"]: r["anomaly_score"] for r in anomaly.isolation_scores(points.repartition(1)).collect()}
    b = {r["key"]: r["anomaly_score"] for r in anomaly.isolation_scores(points.repartition(7)).collect()}
    assert a == b and all(0 < v < 1 for v in a.values())


def spread_points(spark, n, dimension=3, seed=3):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(5, dimension)) * 4
    x = centres[draw.integers(0, 5, n)] + draw.normal(size=(n, dimension))
    return cut_lineage(spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "pid bigint, vec array<double>")), x


def test_tiles_stay_small_when_points_grow(spark):
    tile = 32
    for n in (600, 6000):
        points, x = spread_points(spark, n)
        placed, cells = tiles.tile_points(points, n, tile_rows=tile, pivots=4)
        rows = placed.select("pid", "cell", "salt").collect()
        groups = {}
        for r in rows:
            groups.setdefault((r["cell"], r["salt"]), []).append(r["pid"])
        assert len(rows) == n and max(map(len, groups.values())) <= tile
        # a tile is small in space too: the mean distance to its centre shrinks with the number of points
        spread = np.mean([np.linalg.norm(x[ids] - x[ids].mean(0), axis=1).mean() for ids in groups.values()])
        inner = sum(len(r["parts"]) for r in cells.inner.collect())
        assert inner > n / tile and (n == 600 or spread < 0.6 * before)
        before = spread


def test_split_cells_lose_no_neighbour(spark):
    points, x = spread_points(spark, 3000)
    placed, cells = tiles.tile_points(points, 3000, tile_rows=40, pivots=5)
    placed = cut_lineage(placed)
    asked = placed.where("pid % 20 = 0").select("pid", "vec")
    radius = lambda rows: np.full(len(rows), 0.35)

    def count(left, right):
        near = tiles.within(tiles.matrix(left["vec"]), tiles.matrix(right["vec"]), 0.35).sum(1) if len(left) and len(right) else np.zeros(len(left), int)
        return pd.DataFrame({"pid": left["pid"], "n": near, "seen": len(right)})

    going = cut_lineage(tiles.route(asked, cells, radius))
    got = tiles.visit(going, placed, cells, "pid", count, "pid bigint, n bigint, seen bigint", 40, radius).groupBy("pid").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))
    found = {r["pid"]: r for r in got.collect()}
    want = {i: int((np.linalg.norm(x - x[i], axis=1) <= 0.35).sum()) for i in range(0, 3000, 20)}
    assert {i: r["n"] for i, r in found.items()} == want
    assert np.mean([r["seen"] for r in found.values()]) < 0.25 * 3000  # most tiles are not looked into


def drawn_by_hand(rows, tree, size):
    return [key for _, key in sorted((int(anomaly._tree_hash(np.array([base]), tree)[0]), key) for key, base in rows)[:size]]


@pytest.mark.parametrize("count, trees, sample", [(3000, 20, 64), (50, 7, 256), (1, 3, 256)])
def test_every_tree_draws_from_the_whole_table(spark, count, trees, sample):
    points = spark.range(count, numPartitions=5).selectExpr("cast(id as string) key", "array(cast(id as double), 1.0D) vec")
    rows = points.selectExpr("key", "xxhash64(42, key) base").collect()
    drawn = {}
    for r in anomaly.draw_samples(points, count, 42, trees, sample).orderBy("tree", "h", "key").collect():
        drawn.setdefault(r["tree"], []).append(r["key"])
    size = min(sample, count)
    assert drawn == {t: drawn_by_hand([(r["key"], r["base"]) for r in rows], t, size) for t in range(trees)}
    if count == 3000:  # no common pool: 20 x 64 draws from 3000 rows meet about 1040 different ones, from both halves
        union = {k for keys in drawn.values() for k in keys}
        assert len(union) > 900 and sum(int(k) >= 1500 for k in union) > 400
        again = anomaly.draw_samples(points.repartition(3), count, 42, trees, sample)
        assert {(r["tree"], r["key"]) for r in again.collect()} == {(t, k) for t, keys in drawn.items() for k in keys}


def test_a_bound_that_leaves_a_tree_short_is_raised(spark):
    points = spark.range(2000).selectExpr("cast(id as string) key", "array(1.0D) vec")
    # told far more rows than there are, the first bounds are too low
    drawn = anomaly.draw_samples(points, 2000 * 50, 42, 4, 100)
    assert [r["count"] for r in drawn.groupBy("tree").count().collect()] == [100] * 4


def test_anomaly_checks(spark):
    t = table(spark, POINTS)
    with pytest.raises(anomaly.AnomalyError):
        anomaly.analyze_anomalies(t, ("x", "y"), contamination=0.6)
    with pytest.raises(anomaly.AnomalyError):
        anomaly.analyze_anomalies(t, ("x", "missing"))
    assert anomaly.analyze_anomalies(t.where("false"), ("x", "y")).count() == 0
    assert len(FEATURES) == 31


def test_lone_cluster_member_is_an_unknown_failure(spark):
    frame = spark.createDataFrame([("a", 0.1, False, 0), ("b", 0.1, False, 1), ("c", 0.1, False, 1), ("d", 0.9, True, 1), ("e", 0.1, False, -1)],
                                  "session_id string, anomaly_score double, is_anomaly boolean, cluster_id bigint")
    got = {r["session_id"]: r["is_unknown_failure"] for r in anomaly.finish_records(frame).collect()}
    assert got == {"a": True, "b": False, "c": False, "d": True, "e": True}


def test_the_best_matches_of_a_large_history_are_found_in_blocks():
    import tracemalloc
    rng = np.random.default_rng(3)
    asked, history = rng.normal(size=(64, 4)).round(1), rng.normal(size=(60_000, 4)).round(1)
    asked[0] = 0  # ties with every row
    tracemalloc.start()
    i, j, s = similarity._best(asked, history, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    scores = np.round(asked @ history.T, 9) + 0.0
    want = np.argsort(-scores, axis=1, kind="stable")[:, :3]
    assert (j.reshape(64, 3) == want).all() and (i.reshape(64, 3) == np.arange(64)[:, None]).all()
    assert np.array_equal(s.reshape(64, 3), np.take_along_axis(scores, want, 1))
    assert peak < scores.nbytes  # 31 MB; the product of all rows was held several times


def test_blocks_that_meet_give_the_matches_of_tiles_and_nothing_is_copied_per_tile(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(int(i), str(i), int(i), None, None, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(rng.normal(size=(400, 24)).round(1))]
    rows += [(400 + i, str(400 + i), 400 + i, None, None, rows[i][5]) for i in range(20)]
    items = cut_lineage(spark.createDataFrame(rows, "vec_id int, session_id string, row_id bigint, failure_type string, summary string, vec array<double>"))

    def answers(**options):
        found = similarity.top_matches(items.select("vec_id", "vec"), items.drop("vec_id"), 4, **options)
        return sorted((r["vec_id"], [(m["session_id"], round(m["similarity_score"], 8)) for m in r["similar"]]) for r in found.collect())

    want, routed = answers(), []
    monkeypatch.setattr(similarity, "HISTORY_BLOCK", 64)
    monkeypatch.setattr(similarity._block_matches, "__defaults__", (64,))
    assert answers(plan="blocks") == want
    monkeypatch.setattr(similarity, "VISIT_BYTES", 0)
    monkeypatch.setattr(similarity, "route", lambda *a, **b: routed.append(1) or tiles.route(*a, **b))
    assert answers(plan="tiles", tile_rows=40, pivots=10) == want
    assert not routed  # in so many dimensions a second look would copy every query to nearly every cell


def test_points_of_blocks_meet_without_a_shuffle_and_lose_no_neighbour(spark):
    from sessionlens.operators import kd_blocks
    rng = np.random.default_rng(4)
    x = np.unique(np.vstack([rng.normal(size=(900, 3)).round(2), rng.integers(0, 3, (300, 3)).astype(float)]), axis=0)
    points = cut_lineage(spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "pid bigint, vec array<double>"))
    packed = kd_blocks.pack(kd_blocks.zoned(points, 4), len(x), "pid", rows=300)
    assert packed.count() >= 4

    def count(left, right):
        total = np.zeros(len(left.vec), int)
        for part, rows in kd_blocks.reached(left, np.arange(len(left.vec)), right, 0.5):
            assert len(rows) and part.stop - part.start <= kd_blocks.LEAF_ROWS
            for i, j in kd_blocks.close(left, rows, right, part, 0.5):
                total += np.bincount(i, minlength=len(total))
        return pd.DataFrame({"pid": left.of["pid"], "n": total})

    met = kd_blocks.meet(packed, packed, ("pid",), ("pid",), count, "pid bigint, n bigint")
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    found = {r["pid"]: r["n"] for r in met.groupBy("pid").agg(F.sum("n").alias("n")).collect()}
    want = (np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= 0.5).sum(1)
    assert [found[i] for i in range(len(x))] == want.tolist()


def test_cuts_between_whole_numbers_leave_few_leaves_to_compare():
    from sessionlens.operators import kd_blocks
    rng = np.random.default_rng(5)
    x = np.hstack([rng.integers(0, 2, (4000, 6)) * 2.0, rng.normal(0, 3, (4000, 4))])  # the spread is widest elsewhere

    def compared(**options):
        order, starts = kd_blocks.kd_order(x, 64, **options)
        assert sorted(order) == list(range(len(x)))
        low, high = kd_blocks.Block(x[order], starts, {}).boxes
        away = np.maximum(np.maximum(low[:, None] - high, low - high[:, None]), 0)
        return ((away ** 2).sum(2) <= 1.0).mean()

    assert compared(radius=1.0) < compared() / 4


def test_blocks_out_of_reach_do_not_meet_and_tasks_grow_with_the_blocks(spark):
    from sessionlens.operators import kd_blocks
    points = cut_lineage(spark.createDataFrame([(i, [float(i // 100 * 10), i % 100 / 100]) for i in range(6400)], "pid bigint, vec array<double>"))
    packed = kd_blocks.pack(kd_blocks.zoned(points, kd_blocks.zone_tree(points, 64, 1.0)), 6400, "pid", rows=50, radius=1.0)
    number = packed.count()

    def seen(left, right):
        return pd.DataFrame({"a": [left.number], "b": [right.number]})

    met = kd_blocks.meet(packed, packed, ("pid",), ("pid",), seen, "a bigint, b bigint", radius=1.0)
    assert met.rdd.getNumPartitions() < number * number / 8
    pairs = met.collect()
    assert {(r["a"], r["a"]) for r in pairs} <= {(r["a"], r["b"]) for r in pairs} and number <= len(pairs) < 8 * number


def test_pairs_at_the_very_radius_are_near_far_from_the_origin():
    from sessionlens.operators import kd_blocks
    x = np.array([[a, b, 4000.0] for a in range(20) for b in range(20)]) + [[7000.0, -9000.0, 0.0]]
    block = kd_blocks.Block(x, np.arange(0, 400, 50), {})
    assert block.brief.dtype == np.float32  # too coarse for these coordinates by itself
    for radius, least in ((1.0, 5), (2.0 ** 0.5 - 1e-9, 5), (1.0 - 1e-9, 1)):
        total = np.zeros(400, int)
        for part, rows in kd_blocks.reached(block, np.arange(400), block, radius):
            for i, j in kd_blocks.close(block, rows, block, part, radius):
                total += np.bincount(i, minlength=400)
        assert total.max() == least and total.tolist() == (np.sqrt(((x[:, None] - x) ** 2).sum(2)) <= radius).sum(1).tolist()


def test_rows_that_are_not_core_alone_look_beyond_their_blocks(spark):
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(0, .05, (300, 4)), rng.normal(2, .05, (300, 4)), rng.uniform(-6, 6, (40, 4)),
                   np.repeat(rng.uniform(-6, 6, (30, 4)), 2, 0), np.linspace(0, 2, 60)[:, None] + rng.normal(0, .02, (60, 4))]).round(3)
    rng.shuffle(x)
    frame = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "ord long, vec array<double>")
    asked = []
    meet = clusters.meet
    clusters.meet = lambda left, right, *a, **b: asked.append(left.selectExpr("sum(length(pid)) div 8").first()[0]) or meet(left, right, *a, **b)
    try:
        got = {r["ord"]: r["cluster_id"] for r in clusters.dbscan(frame, .3, 4, tile_rows=64).collect()}
    finally:
        clusters.meet = meet
    want = brute(x, .3, 4)
    assert [got[i] for i in range(len(x))] == want.tolist()
    assert asked[0] < len(x) / 3  # of neighbours: the 600 rows of the dense parts stay at home
    assert max(asked) < len(x) * 2 / 3  # of links: so does the largest component
