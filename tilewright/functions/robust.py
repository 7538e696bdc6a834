"""Robust statistics as expressions and small plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Makes the median absolute deviation agree with the standard deviation of a normal distribution.
MAD_SCALE = 1.4826


def robust_z(x: Column, median: Column, mad: Column) -> Column:
    """Distance from the median in scaled deviations; null where the deviation is null or zero."""
    return (x - median) / F.nullif(mad, F.lit(0.0))


def ratio_to(x: Column, median: Column) -> Column:
    return x / F.nullif(median, F.lit(0.0))


def flags(*named: tuple[str, Column]) -> Column:
    """The names whose condition holds, joined by semicolons in the given order."""
    return F.array_join(F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in named)), lambda x: x.isNotNull()), ";")


def has_flag(flags_: Column, name: str) -> Column:
    return F.array_contains(F.split(flags_, ";"), name)


def tie_rank(value: str, partition: Sequence[str] = ()) -> Column:
    """Average rank from 1: equal values share the mean of their places."""
    by = Window.partitionBy(*partition).orderBy(value)
    tied = Window.partitionBy(*partition, value)
    return (2 * F.rank().over(by) + F.count(F.lit(1)).over(tied) - 1) / 2


def baseline(counts: DataFrame, slide: str = "slide_id", value: str = "n_detected") -> DataFrame:
    """One row per slide: n_fovs, mean, std (sample, 0 for one field), median and scaled MAD, the field itself included.

    Two aggregations on the slide; a slide has few hundred fields, so exact medians stay small.
    """
    first = counts.groupBy(slide).agg(F.count(value).alias("n_fovs"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.median(value).alias("median"))
    spread = counts.join(first.select(slide, "median"), slide).groupBy(slide).agg((F.median(F.abs(F.col(value) - F.col("median"))) * MAD_SCALE).alias("mad"))
    return first.join(spread, slide)


def scored(counts: DataFrame, slide: str = "slide_id", value: str = "n_detected", threshold: float = 2.0, small: int = 20) -> DataFrame:
    """Every field with its slide's baseline, ratio, robust z and flags."""
    rows = counts.join(baseline(counts, slide, value), slide)
    z, ratio = robust_z(F.col(value), F.col("median"), F.col("mad")), ratio_to(F.col(value), F.col("median"))
    rows = rows.withColumn("z", z).withColumn("ratio", ratio)
    none = (F.coalesce(F.col("median"), F.lit(0.0)) == 0) | (F.coalesce(F.col("mad"), F.lit(0.0)) == 0)
    return rows.withColumn("flags", flags(
        ("small_slide", F.col("n_fovs") < small), ("zero_or_undefined_baseline", none),
        ("mean_median_divergence", (F.col("median") != 0) & (F.abs(F.col("mean") - F.col("median")) > 0.25 * F.col("median"))),
        ("high_outlier", F.col("z") >= threshold), ("low_outlier", F.col("z") <= -threshold),
    ))


def upper_median(values: Column) -> Column:
    """The middle of the sorted array, the upper one of two."""
    s = F.sort_array(values)
    return F.element_at(s, (F.floor(F.size(s) / 2) + 1).cast("int"))


def places(df: DataFrame, value: str, buckets: int = 256) -> DataFrame:
    """(value, occurs, before): how often each value occurs, and how many rows have a smaller one; nulls are left out.

    No task sorts the whole column: approximate quantiles, at most ``buckets`` numbers, cut it into
    ranges, each is ranked by itself, and the ranges' totals (one row each) are added up.
    """
    h = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("occurs"))
    cuts = df.agg(F.percentile_approx(value, [i / buckets for i in range(1, buckets)], 10_000).alias("q")).head()["q"] or []
    edges = F.array(*map(F.lit, sorted(set(cuts)))) if cuts else F.array().cast("array<double>")
    h = h.withColumn("_b", F.size(F.filter(edges, lambda e: e <= F.col(value))))
    inner = Window.partitionBy("_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = h.groupBy("_b").agg(F.sum("occurs").alias("_n")).select("_b", F.coalesce(F.sum("_n").over(outer), F.lit(0)).alias("_base"))
    rows = h.withColumn("_in", F.coalesce(F.sum("occurs").over(inner), F.lit(0))).join(F.broadcast(base), "_b")  # a row per bucket on the right
    return rows.select(value, "occurs", (F.col("_base") + F.col("_in")).alias("before"))


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """``df`` with the tied average rank of a column over all rows."""
    r = places(df, value).select(F.col(value).alias("_v"), (F.col("before") + (F.col("occurs") + 1) / 2).alias(name))
    return df.join(r, F.col(value) == F.col("_v"), "left").drop("_v")


def spearman(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """One row: rho_<x>_<y> for each pair of columns, with tied ranks averaged; rows with a null in any column are left out."""
    cols = sorted({c for p in pairs for c in p})
    ranked = df.select(*cols).dropna()
    for c in cols:
        ranked = average_ranks(ranked, c, f"_r_{c}")
    return ranked.agg(*(F.corr(f"_r_{a}", f"_r_{b}").alias(f"rho_{a}_{b}") for a, b in pairs))


def partial(xy: Column, xz: Column, yz: Column) -> Column:
    """Correlation of x and y with z held; null where it is not defined."""
    room = F.sqrt((1 - xz * xz) * (1 - yz * yz))
    return F.when(room >= 1e-9, (xy - xz * yz) / room)
