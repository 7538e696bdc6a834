"""Exact order statistics of groups of any size.

Groups of at most SMALL rows, which are counted first, are sorted as an array each. In larger ones a place is
searched for by histograms: the values between the bounds that a place is known to lie within are counted in
BUCKETS buckets, the place's bucket gives the next bounds (its least and largest value), and so on until
they are equal or hold no more than SMALL rows. Only counts, bounds and what is left then are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import matched, written

SMALL, BUCKETS = 10_000, 4_096
#: A place in the sorted values, counted from 0 and perhaps between two, by the number of values.
Place = Callable[[Column], Column]


def share(q: float) -> Place:
    """The place of a percentile between the first value and the last, as SQL's percentile_cont has it."""
    return lambda n: F.lit(float(q)) * (n - 1)


def upper(n: Column) -> Column:
    """The middle, the upper one of two."""
    return F.floor(n / 2).cast("double")


def from_top(percent: float) -> Place:
    """The place of the last of the largest values that make so many hundredths of all, rounded half to even and one at least."""
    return lambda n: (n - top_count(n, percent)).cast("double")


def top_count(n: Column, percent: float) -> Column:
    return F.greatest(F.lit(1), F.bround(n * percent / 100)).cast("long")


def exact(rows: DataFrame, by: Sequence[str], value: str, places: Mapping[str, Place], small: int = SMALL, buckets: int = BUCKETS, weight: str | None = None) -> DataFrame:
    """One row for each group with a value: ``by``, n (its values), and a column for each of ``places``.

    ``weight``, whole numbers, says how often a row's value is there; without it each is there once.

    Between two values lies their weighted mean. Nulls are no values; null keys are a group; without ``by``
    all rows are one group, and a table without values gives no row.
    """
    times = F.lit(1) if weight is None else F.col(weight)
    # Written once: the values are read in every pass, and what they were made from is not made again.
    own = written(rows.select(*by, F.col(value).cast("double").alias("_v"), times.cast("long").alias("_t")).where(F.col("_v").isNotNull() & (F.col("_t") > 0)), "values")
    sizes = written(own.groupBy(*by).agg(F.sum("_t").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).where("n > 0"), "sizes")
    few = matched(own, sizes.where(F.col("n") <= small).select(*by, "n"), by) if by else own.crossJoin(F.broadcast(sizes.where(F.col("n") <= small).select("n")))  # one row on the right
    arrays = few.groupBy(*by).agg(F.max("n").alias("n"), _sorted().alias("_s")).where("n is not null")
    at = lambda k: F.get(F.col("_s"), k.cast("int"))
    out = arrays.select(*by, "n", *(between(p(F.col("n")), at).alias(c) for c, p in places.items()))
    large = sizes.where(F.col("n") > small)
    if large.isEmpty():
        return out
    found = _searched(own, by, large, places, small, buckets)
    got = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_m"))  # two for each place
    met = matched(large, got, by) if by else large.crossJoin(got)
    of = lambda k: F.element_at(F.col("_m"), k)
    return out.unionByName(met.select(*by, "n", *(between(p(F.col("n")), of).alias(c) for c, p in places.items())))


def _sorted() -> Column:
    """All values of a small group in order, each as often as it is there."""
    return F.sort_array(F.flatten(F.collect_list(F.array_repeat("_v", F.col("_t").cast("int")))))


def between(place: Column, at: Callable[[Column], Column]) -> Column:
    low, high = F.floor(place).cast("long"), F.ceil(place).cast("long")
    a, b = at(low), at(high)
    return F.when(low == high, a).otherwise((high - place) * a + (place - low) * b)


def _searched(own: DataFrame, by: Sequence[str], large: DataFrame, places: Mapping[str, Place], small: int, buckets: int) -> DataFrame:
    """(by, _rank, _v): the values at the whole places beside each of ``places`` in the large groups."""
    spots = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(p(F.col("n"))).cast("long"), F.ceil(p(F.col("n"))).cast("long")) for p in places.values()))))
    # Bounds of a rank: it lies among the _n values from _lo to _hi, which have _below smaller ones.
    bounds = large.select(*by, F.explode(spots).alias("_rank"), "_lo", "_hi", F.lit(0).cast("long").alias("_below"), "n").withColumnRenamed("n", "_n")
    done = []
    while True:
        bounds = written(bounds, "bounds")
        done.append(bounds.where("_lo = _hi").select(*by, "_rank", F.col("_lo").alias("_v")))
        wide = bounds.where("_lo < _hi")
        if wide.isEmpty():
            break
        # A row for each group: ranges of ranks that lie in one range are one.
        ranges = wide.groupBy(*by).agg(F.collect_set(F.struct("_lo", "_hi", "_n")).alias("_ranges"))
        met = matched(own, ranges, by) if by else own.crossJoin(F.broadcast(ranges))  # one row on the right
        inside = met.withColumn("_r", F.get(F.filter("_ranges", lambda x: (x["_lo"] <= F.col("_v")) & (F.col("_v") <= x["_hi"])), F.lit(0))).where("_r is not null").select(*by, "_v", "_t", "_r._lo", "_r._hi", "_r._n")
        short = inside.where(F.col("_n") <= small).groupBy(*by, "_lo").agg(_sorted().alias("_s"))
        ends = matched(wide.where(F.col("_n") <= small), short, [*by, "_lo"])
        done.append(written(ends.select(*by, "_rank", F.get("_s", (F.col("_rank") - F.col("_below")).cast("int")).alias("_v")), "ends"))
        # Halves are taken first, so that no difference goes beyond the largest number.
        at = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * buckets
        bucket = F.least(F.lit(buckets - 1), F.floor(at)).cast("int")
        hist = inside.where(F.col("_n") > small).groupBy(*by, "_lo", bucket.alias("_b_")).agg(F.sum("_t").alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        upto = hist.withColumn("_before", F.sum("_c").over(Window.partitionBy(*by, "_lo").orderBy("_b_")) - F.col("_c"))
        open_ = wide.where(F.col("_n") > small).select(*by, "_rank", "_lo", "_below")
        hit = matched(open_, upto, [*by, "_lo"]).where((F.col("_below") + F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_below") + F.col("_before") + F.col("_c")))
        bounds = hit.select(*by, "_rank", F.col("_low").alias("_lo"), F.col("_high").alias("_hi"), (F.col("_below") + F.col("_before")).alias("_below"), F.col("_c").alias("_n"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
