"""Exact order statistics against sorted arrays, with hot groups, ties and extreme values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import quantiles

PLACES = {"p0": quantiles.share(0), "p2": quantiles.share(0.02), "mid": quantiles.share(0.5), "p98": quantiles.share(0.98), "p100": quantiles.share(1), "up": quantiles.upper, "top10": quantiles.from_top(10)}


def plain(values):
    v = np.sort(np.array(values, np.float64))
    n = len(v)
    k = max(1, round(n * 0.1))
    lin = lambda q: float(np.quantile(v, q))
    return [n, v[0], lin(0.02), lin(0.5), lin(0.98), v[-1], v[n // 2], v[n - k]]


@pytest.mark.parametrize(("small", "buckets"), [(10_000, 4_096), (50, 16), (1, 2)])
def test_places_are_those_of_sorted_values(spark, small, buckets):
    r = np.random.default_rng(1)
    rows = [("hot", float(x)) for x in r.normal(size=700)] + [("ties", float(x)) for x in r.integers(0, 4, 300)] + [("one", 3.5)] + [(None, float(x)) for x in r.integers(-5, 90, 120)]
    rows += [("wide", x) for x in (-1.7e308, 1.7e308, 0.0, 1e-300, 2e-300, -1e-300, 5.0, 5.0, 1e300)] + [("none", None)] * 3
    got = quantiles.exact(spark.createDataFrame(rows, "g string, v double").repartition(4), ["g"], "v", PLACES, small, buckets).collect()
    want = {}
    for g, v in rows:
        if v is not None:
            want.setdefault(g, []).append(v)
    assert {x.g for x in got} == want.keys() and len(got) == len(want)
    for x in got:
        with np.errstate(over="ignore", invalid="ignore"):
            assert x.n == len(want[x.g]) and list(x[2:]) == pytest.approx(plain(want[x.g])[1:], rel=1e-9) if x.g != "wide" else x.up == 2e-300


@pytest.mark.parametrize("small", [10_000, 20])
def test_places_of_a_whole_table(spark, small):
    v = np.random.default_rng(2).integers(0, 1000, 900).astype(float)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    row = quantiles.exact(df, [], "v", PLACES, small, 8).head()
    assert list(row) == pytest.approx(plain(v))
    assert quantiles.exact(df.limit(0), [], "v", PLACES, small).count() == 0


def test_two_keys_and_whole_numbers(spark):
    df = spark.range(3_000).select((F.col("id") % 2).alias("a"), F.when(F.col("id") % 5 == 0, "x").alias("b"), (F.hash("id") % 100).alias("v"))
    got = {(r.a, r.b): (r.n, r.m) for r in quantiles.exact(df, ["a", "b"], "v", {"m": quantiles.share(0.5)}, 100, 8).collect()}
    want = {(r.a, r.b): (r.n, r.m) for r in df.groupBy("a", "b").agg(F.count("v").alias("n"), F.median("v").alias("m")).collect()}
    assert got == want


def test_statistics_of_a_hot_slide_are_those_of_small_ones(spark, monkeypatch):
    from tilewright.plans.quality_queries import statistics53

    df = spark.range(4_000).select(F.when(F.col("id") % 4 == 0, 1).otherwise(0).alias("slide"), F.pmod(F.hash("id"), F.lit(37)).cast("double").alias("x"))
    small = statistics53(df, "slide", "x").orderBy("slide").collect()
    kept = quantiles.exact
    monkeypatch.setattr(quantiles, "exact", lambda *a, **k: kept(*a, **{**k, "small": 100, "buckets": 8}))
    assert statistics53(df, "slide", "x").orderBy("slide").collect() == small
