"""Quantiles by radix selection: bit by bit the same however cells are cut, and equal to the built-in aggregate."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import calibrate, quantile
from tidewatch.operators.quantile import digits, exact_quantiles

QS = [i / 98 for i in range(99)]


def values(rng):
    tiny = 5e-324
    odd = [0.0, -0.0, tiny, -tiny, 2.2e-308, 1e308, -1.7e308, math.inf, -math.inf, 8.0, 8.000000000000002, 7.999999999999999]
    return {
        "repeated": [rng.gauss(0, 1) for _ in range(400)] * 3,
        "odd": odd * 2 + [2.0**k for k in range(-1074, 1024, 7)] + [-(2.0**k) for k in range(-1074, 1024, 13)],
        "narrow": [1.7e9 + i / 1024 for i in range(3000)],
        "equal": [4.25] * 500,
        "few": [3.0, 1.0],
        None: [rng.uniform(-5, 5) for _ in range(300)],
    }


@pytest.fixture(scope="module")
def table(spark):
    rows = [(g, x) for g, xs in values(random.Random(1)).items() for x in xs]
    rows += [("repeated", None), ("few", math.nan), ("none", None)]
    return spark.createDataFrame(rows, "g string, v double").repartition(7).cache()


def bits(rows):
    return {r.g: (r.n, [x.hex() for x in r.quantiles]) for r in rows}


def test_one_formula_at_every_size(table):
    whole = bits(exact_quantiles(table, ["g"], "v", QS, one_run=10**9).collect())
    assert set(whole) == {"repeated", "odd", "narrow", "equal", "few", None}
    for one_run in (0, 300):
        assert bits(exact_quantiles(table, ["g"], "v", QS, one_run=one_run).collect()) == whole


def test_equal_to_the_built_in_aggregate(table):
    some = table.where("g <> 'odd' OR g IS NULL").where("NOT isnan(v) AND v IS NOT NULL")
    built_in = some.groupBy("g").agg(F.count("v").alias("n"), F.percentile("v", QS).alias("quantiles"))
    assert bits(exact_quantiles(some, ["g"], "v", QS, one_run=50).collect()) == bits(built_in.collect())


def test_ranks_of_odd_values(table):
    xs = sorted(values(random.Random(1))["odd"])
    ranks = [i / (len(xs) - 1) for i in range(len(xs))]
    got = exact_quantiles(table.where("g = 'odd'"), [], "v", ranks, one_run=3).first()
    assert got.n == len(xs)
    # a rank that is not a whole number by rounding lies between two neighbours
    for x, i in zip(got.quantiles, range(len(xs)), strict=True):
        near = xs[max(0, i - 1) : i + 2]
        assert math.isnan(x) or min(near) <= x <= max(near)


def test_cells_keep_the_order_of_values(spark):
    rng = random.Random(3)
    xs = [rng.choice([-1, 1]) * rng.random() * 2.0 ** rng.randrange(-1074, 1024) for _ in range(5000)]
    for k in range(-1070, 1023, 11):
        p = 2.0**k
        xs += [p, math.nextafter(p, 0), math.nextafter(p, math.inf), p * 1.5, -p]
    rows = spark.createDataFrame([(x,) for x in xs], "v double").select("v", F.array(*digits(F.col("v"))).alias("d")).collect()
    ordered = sorted(rows, key=lambda r: r.v)
    assert all(list(a.d) <= list(b.d) for a, b in zip(ordered, ordered[1:], strict=False))


def test_nothing_to_rank(spark, table):
    assert exact_quantiles(table.where("false"), ["g"], "v", [0.5]).count() == 0
    none = exact_quantiles(table.where("g = 'none'"), [], "v", [0.5]).first()
    assert none.n is None and none.quantiles == [None]
    assert quantile.quantile_columns(table.where("g = 'few'"), ["g"], {"m": ("v", 0.5)}).first().m == 2.0


def test_quantiles_of_neighbouring_doubles_by_their_gap(spark):
    rng = random.Random(4)
    xs = {g: [1 - rng.randrange(6) * 2.0**-53 for _ in range(200 + g)] for g in range(12)}
    xs[12] = [rng.uniform(0.9, 1.0) for _ in range(300)]
    table = spark.createDataFrame([(g, x) for g, each in xs.items() for x in each], "g int, v double")
    qs = [float(q) for q in np.linspace(0.90, 0.999, 200)]
    for r in exact_quantiles(table, ["g"], "v", qs, by_gap=True).collect():
        assert r.quantiles == np.quantile(xs[r.g], qs).tolist()
        assert r.quantiles == sorted(r.quantiles)


def test_quantiles_by_a_gap_beyond_the_doubles(spark):
    table = spark.createDataFrame([("a", -1.5e308), ("a", 1.5e308), ("b", -math.inf), ("b", 1.0)], "g string, v double")
    got = {r.g: r.quantiles for r in exact_quantiles(table, ["g"], "v", [0.0, 0.25, 1.0], by_gap=True).collect()}
    assert got == {"a": [-1.5e308, -0.75e308, 1.5e308], "b": [-math.inf, -math.inf, 1.0]}


def test_candidate_thresholds_never_fall(spark):
    rng = random.Random(5)
    scores = [1 - rng.randrange(400) * 2.0**-53 for _ in range(494)]
    calib = spark.createDataFrame([("a", i, x) for i, x in enumerate(scores)], "k string, row_no long, score double")
    got = calibrate.candidate_events(calib, "score", [(5, 3)], 0.98, ["k"]).orderBy("cand").collect()
    assert [r.tau for r in got] == np.quantile(scores, calibrate.CANDIDATES).tolist()
