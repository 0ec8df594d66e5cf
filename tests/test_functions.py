import math
import random

import pytest
from pyspark.sql import functions as F

from sessionlens.functions.numbers import fixed, general, rounded, shortest
from sessionlens.functions.stats import column_stats, exact_quantile, fit_preparation, number_rows
from sessionlens.functions.text import is_blank, mentions, token_estimate, word_count

NUMBERS = [0.0, 2.675, 1.005, 0.125, 0.375, 0.625, 0.005, 2.5, 1e-9, 1234.565, 99999.995, 7717.305, 1 / 3, 8589934592.115]


def values(spark, items, kind="double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")


def test_rounding_matches_exact_half_even(spark):
    random.seed(1)
    items = NUMBERS + [random.randint(0, 10**7) / random.choice([8, 16, 200, 1000, 3, 7]) for _ in range(2000)]
    items += [-x for x in items[:50]]
    got = values(spark, items).selectExpr("i", f"{rounded('v')} r").orderBy("i").collect()
    assert [r["r"] for r in got] == [round(x, 2) for x in items]


def test_fixed_text(spark):
    got = values(spark, NUMBERS).selectExpr("i", f"{fixed('v')} t").orderBy("i").collect()
    assert [r["t"] for r in got] == [f"{x:.2f}" for x in NUMBERS]


def test_general_text(spark):
    items = [0.0, 5000.0, 10022.0, 0.5, 1801.4444, 1234567.0, 999999.5, 999999.4, 100000.0, 1e6, 1.5e10, 0.0001,
             0.00012345678, 0.00001, 123.456789, 30500.5, 1e-5, 12.0, 100.25, -3.5, 0.001]
    got = values(spark, items).selectExpr("i", f"{general('v')} t").orderBy("i").collect()
    assert [r["t"] for r in got] == [f"{x:g}" for x in items]


def test_shortest_text(spark):
    items = [1145.46, None, 0.5, 41399.86, 12345678.25, 10000000.0, 0.001]
    got = values(spark, items).selectExpr("i", f"{shortest('v')} t").orderBy("i").collect()
    assert [r["t"] for r in got] == [str(x) for x in items]


@pytest.mark.parametrize("text", ["", "  ", "\t\n", " 　", "a b", " a b\x1cc ", "one", "x\u0085y"])
def test_words_and_blanks(spark, text):
    row = values(spark, [text], "string").selectExpr(f"{word_count('v')} w", f"{is_blank('v')} b",
                                                     f"{token_estimate('v')} t").first()
    assert row["w"] == len(text.split())
    assert row["b"] == (not text.strip())
    assert row["t"] == max(1, round(len(text.split()) * 1.3))


def test_mentions_ignores_case_and_null(spark):
    got = values(spark, ["Retry now", "RETRYING", None, "try"], "string").selectExpr("i", f"{mentions('v', 'retry')} m")
    assert [r["m"] for r in got.orderBy("i").collect()] == [True, True, False, False]


@pytest.mark.parametrize("p", [0.0, 0.1, 0.5, 0.9, 1.0])
def test_exact_quantile(spark, p):
    import numpy as np
    random.seed(2)
    items = [random.gauss(0, 1) for _ in range(3001)] + [0.25] * 1500 + [None, float("nan")]
    frame = values(spark, items).repartition(5)
    clean = [x for x in items if x is not None and x == x]
    assert exact_quantile(frame, "v", p) == pytest.approx(np.percentile(clean, 100 * p), abs=1e-12)


def test_quantile_of_nothing(spark):
    assert exact_quantile(values(spark, [None, None]), "v", 0.5) is None


def test_preparation_fills_scales_and_drops_empty_columns(spark):
    frame = spark.createDataFrame([(1.0, None, 5.0), (2.0, None, 5.0), (None, None, 5.0), (9.0, None, 5.0)],
                                  "a double, b double, c double")
    p = fit_preparation(frame, ["a", "b", "c"])
    assert p.columns == ("a", "c") and p.fill["a"] == 2.0
    rows = p.scaled(frame).collect()
    assert sum(r["a"] for r in rows) == pytest.approx(0) and {r["c"] for r in rows} == {0.0}
    assert sum(r["a"] ** 2 for r in rows) / 4 == pytest.approx(1)
    assert fit_preparation(frame, ["a"], "mean").fill["a"] == 4.0


def test_moments(spark):
    s = column_stats(values(spark, [1.0, 2.0, 3.0, None]), ["v"])
    assert (s.rows, s.count["v"], s.mean["v"], s.low["v"], s.high["v"]) == (4, 3, 2.0, 1.0, 3.0)
    assert s.variance["v"] == pytest.approx(2 / 3)


def test_row_numbers_follow_the_order_whatever_the_partitions(spark):
    items = list(range(1000))
    random.seed(3)
    random.shuffle(items)
    frame = spark.createDataFrame([(x,) for x in items], "x int").repartition(7)
    assert {r["x"]: r["n"] for r in number_rows(frame, "x").collect()} == {x: x for x in range(1000)}


def test_large_values_are_rounded_too(spark):
    rng = random.Random(3)
    values = [rng.uniform(1e12, 1e15) for _ in range(3000)] + [8100000000000.126, 8e12 + 0.125, 9e15 + 0.5, 1e300, float("inf")]
    values += [-v for v in values]
    frame = spark.createDataFrame([(v,) for v in values], "x double").selectExpr("x", f"{rounded('x')} y")
    assert all(r.y == (r.x if math.isinf(r.x) else round(r.x, 2)) for r in frame.collect())


def test_an_infinite_value_is_named(spark):
    frame = spark.createDataFrame([(float("inf"),), (float("inf"),), (1.0,)], "latency double")
    with pytest.raises(ValueError, match="latency"):
        fit_preparation(frame, ["latency"])
