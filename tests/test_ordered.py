"""Numbering and nearest rows over many parts against plain loops, with one group of all rows."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tilewright.operators import models, ordered, relational


@pytest.mark.parametrize("part", [1 << 18, 40, 3])
def test_numbers_are_those_of_a_window(spark, part):
    r = np.random.default_rng(1)
    rows = [(None if k % 17 == 0 else "hot" if k % 3 else f"g{k % 5}", int(v), k) for k, v in enumerate(r.integers(0, 30, 400))]
    df = spark.createDataFrame(rows, "g string, v int, k int").repartition(5)
    got = ordered.numbered(df, ["g"], [F.col("v").desc(), "k"], part_rows=part)
    want = df.withColumn("number", F.row_number().over(Window.partitionBy("g").orderBy(F.col("v").desc(), "k")).cast("long"))
    assert got.columns == ["g", "v", "k", "number"]
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    all_ = ordered.numbered(df, [], ["k"], "n", part_rows=part)
    assert [x.n for x in all_.orderBy("k").collect()] == list(range(1, 401))
    assert ordered.numbered(df.limit(0), ["g"], ["k"]).count() == 0


def test_equal_rows_are_numbered_once_each(spark):
    df = spark.range(500).select(F.lit("a").alias("g"), F.lit(1).alias("v"))
    assert sorted(x.number for x in ordered.numbered(df, ["g"], ["v"], part_rows=60).collect()) == list(range(1, 501))


def test_a_group_fills_many_parts_of_bounded_size(spark):
    df = spark.range(20_000).select(F.lit(0).alias("g"), F.hash("id").alias("v"), "id")
    sizes = [x["count"] for x in ordered.in_parts(df, ["g", "v"], 1_000).groupBy("_part").count().collect()]
    assert sum(sizes) == 20_000 and len(sizes) >= 15 and max(sizes) <= 2_500


@pytest.mark.parametrize("part", [1 << 18, 30, 4])
def test_nearest_without_a_group_equals_all_pairs(spark, part):
    r = np.random.default_rng(3)
    a = [(k, None if k % 19 == 0 else float(v)) for k, v in enumerate(r.integers(0, 300, 150))]
    b = [(k, None if k % 13 == 0 else float(v)) for k, v in enumerate(np.append(r.integers(0, 120, 40), [290, 290, 291]))]
    got = ordered.nearest(spark.createDataFrame(a, "k int, v double"), spark.createDataFrame(b, "k int, v double"), "v", "k", part_rows=part)
    want = {k: min(((abs(v - v2), k2) for k2, v2 in b if v2 is not None), default=(None, None)) if v is not None else (None, None) for k, v in a}
    assert {x.k: (x.distance, x.control) for x in got.collect()} == want


@pytest.mark.parametrize("part", [1 << 18, 10])
def test_nearest_in_groups_equals_all_pairs(spark, part):
    r = np.random.default_rng(4)
    group = lambda k: None if k % 7 == 0 else "hot" if k % 2 else f"g{k % 3}"
    a = [(k, int(v), group(k)) for k, v in enumerate(r.integers(0, 60, 120))] + [(999, 5, "alone")]
    b = [(k, int(v), group(k + 1)) for k, v in enumerate(r.integers(0, 60, 50))]
    schema = "k int, v int, g string"
    got = ordered.nearest(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "v", "k", ["g"], part).collect()
    want = {k: min(((float(abs(v - v2)), k2) for k2, v2, g2 in b if g2 == g), default=(None, None)) for k, v, g in a}
    assert {x.k: (x.distance, x.control) for x in got} == want
    assert relational.nearest(spark.createDataFrame(a, schema).limit(0), spark.createDataFrame(b, schema), "v", "k", ["g"]).count() == 0


def test_folds_share_a_hot_level_evenly(spark):
    rows = spark.range(3_000).select("id", F.when(F.col("id") % 10 == 0, 1).otherwise(0).alias("level"))
    folds = models.hashed_folds(rows, ["id"], "level", 5, 42)
    assert folds.columns == ["id", "level", "fold"]
    n = {(x.level, x.fold): x["count"] for x in folds.groupBy("level", "fold").count().collect()}
    assert n == {**{(0, f): 540 for f in range(5)}, **{(1, f): 60 for f in range(5)}}
