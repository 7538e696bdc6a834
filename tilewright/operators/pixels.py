"""Pixel statistics of small tiles: histograms over (tile, y, x, v), and neighbourhoods as array expressions.

What looks at a pixel's neighbours works on a tile's whole array of values (row by row) within its row,
so pixels are neither dealt out nor joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(px: DataFrame, tile: str) -> DataFrame:
    return px.groupBy(tile, "v").agg(F.count(F.lit(1)).alias("n"))


def otsu(px: DataFrame, tile: str) -> DataFrame:
    """(tile, threshold, eta, coverage): the first level of largest between-class variance, its share of the variance, and the share above it.

    Whole-number sums decide the level, so engines agree on it.
    """
    h = histogram(px, tile)
    all_, up_to = Window.partitionBy(tile), Window.partitionBy(tile).orderBy("v")
    run = h.select(
        tile, "v", F.sum("n").over(up_to).alias("w0"), F.sum(F.col("n") * F.col("v")).over(up_to).alias("s0"),
        F.sum("n").over(all_).alias("w"), F.sum(F.col("n") * F.col("v")).over(all_).alias("s"), F.sum(F.col("n") * F.col("v") * F.col("v")).over(all_).alias("q"),
    )
    c = F.col
    # Between-class variance times w^2: (w * s0 - w0 * s)^2 / (w0 * w1).
    gap = (c("w") * c("s0") - c("w0") * c("s")).cast("double")
    between = F.when(c("w0") < c("w"), gap * gap / (c("w0") * (c("w") - c("w0"))).cast("double")).otherwise(0.0)
    ranked = run.withColumn("b", between)
    top = ranked.groupBy(tile, "w", "s", "q").agg(F.min_by("v", F.struct(-c("b"), c("v"))).alias("threshold"), F.max("b").alias("b"), F.min_by("w0", F.struct(-c("b"), c("v"))).alias("w0"))
    spread = (c("w") * c("q") - c("s") * c("s")).cast("double")
    return top.select(tile, "threshold", F.when(spread > 0, c("b") / spread).otherwise(0.0).alias("eta"), ((c("w") - c("w0")) / c("w")).alias("coverage"))


def _places(height: int, width: int, dy: int = 0, dx: int = 0) -> Column:
    """Places (y * width + x) whose neighbour at the offset lies in the tile."""
    y, x = (lambda i: F.floor(i / width)), (lambda i: i % width)
    inside = lambda i: (y(i) + dy >= 0) & (y(i) + dy < height) & (x(i) + dx >= 0) & (x(i) + dx < width)
    return F.filter(F.sequence(F.lit(0), F.lit(height * width - 1)), inside)


def glcm_contrast(values: Column, height: int, width: int) -> Column:
    """Mean over the four offsets at distance one of the mean squared difference."""
    means = []
    for dy, dx in ((0, 1), (-1, 1), (-1, 0), (-1, -1)):
        means.append(_squares(values, _places(height, width, dy, dx), dy * width + dx) / ((height - abs(dy)) * (width - abs(dx))))
    return (means[0] + means[1] + means[2] + means[3]) / 4


def _squares(values: Column, places: Column, step: int) -> Column:
    def add(total: Column, i: Column) -> Column:
        gap = F.get(values, i) - F.get(values, i + step)
        return total + (gap * gap).cast("long")

    return F.aggregate(places, F.lit(0).cast("long"), add)


def cell_of(at: Column, size: int, cells: int) -> Column:
    """Which of ``cells`` parts a place lies in when the first size % cells parts are one longer."""
    wide, small = size % cells, size // cells
    edge = wide * (small + 1)
    return F.when(at < edge, F.floor(at / (small + 1))).otherwise(wide + F.floor((at - edge) / max(small, 1))).cast("int")


def tile_spread(px: DataFrame, tile: str, size: int = 8, cells: int = 3) -> DataFrame:
    """(tile, cv, patchiness) of the cells' mean values: population deviation over mean, and (max - median) over median; 0 without signal."""
    means = px.groupBy(tile, cell_of(F.col("y"), size, cells).alias("r"), cell_of(F.col("x"), size, cells).alias("c")).agg((F.sum("v") / F.count(F.lit(1))).alias("m"))
    a = means.groupBy(tile).agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("sd"), F.median("m").alias("mid"), F.max("m").alias("top"))
    return a.select(tile, F.when(F.abs("mean") < 1e-9, 0.0).otherwise(F.col("sd") / F.col("mean")).alias("cv"), F.when(F.abs("mid") < 1e-9, 0.0).otherwise((F.col("top") - F.col("mid")) / F.col("mid")).alias("patchiness"))


def quadrants(px: DataFrame, tile: str, height: int = 8, width: int = 8) -> DataFrame:
    """(tile, tl, tr, bl, br, spread): mean value of each quarter and the largest less the smallest."""
    name = F.when(F.col("y") < height // 2, F.when(F.col("x") < width // 2, "tl").otherwise("tr")).otherwise(F.when(F.col("x") < width // 2, "bl").otherwise("br"))
    m = px.withColumn("_q", name)
    mean = lambda q: (F.sum(F.when(F.col("_q") == q, F.col("v"))) / F.count(F.when(F.col("_q") == q, 1))).alias(q)
    out = m.groupBy(tile).agg(*map(mean, ("tl", "tr", "bl", "br")))
    return out.withColumn("spread", F.greatest("tl", "tr", "bl", "br") - F.least("tl", "tr", "bl", "br"))


def cuts_of(size: int, cells: int) -> list[int]:
    """Where ``size`` places are cut into parts of which the first size % cells are one longer."""
    return [k * (size // cells) + min(k, size % cells) for k in range(cells + 1)]


def cell_means(values: Column, width: int, ys: Sequence[int], xs: Sequence[int]) -> Column:
    """Mean value of each cell of a tile between the cuts, row by row, in the row itself: no pixel becomes a row."""

    def mean(top: int, bottom: int, left: int, right: int) -> Column:
        rows = F.sequence(F.lit(top), F.lit(bottom - 1))
        add = lambda s, v: s + v
        total = F.aggregate(rows, F.lit(0).cast("long"), lambda s, r: F.aggregate(F.slice(values, r * width + left + 1, F.lit(right - left)), s, add))
        return total / ((bottom - top) * (right - left))

    return F.array(*(mean(a, b, c, d) for a, b in zip(ys, ys[1:], strict=False) for c, d in zip(xs, xs[1:], strict=False)))


def quarter_means(values: Column, height: int, width: int) -> Column:
    """Struct tl, tr, bl, br, spread: mean value of each quarter and the largest less the smallest."""
    m = cell_means(values, width, [0, height // 2, height], [0, width // 2, width])
    named = [m[k].alias(n) for k, n in enumerate(("tl", "tr", "bl", "br"))]
    return F.struct(*named, (F.array_max(m) - F.array_min(m)).alias("spread"))


def spread_of(means: Column, n: int) -> Column:
    """Struct cv, patchiness of the mean values of ``n`` cells: population deviation over mean, and (max - median) over median; 0 without signal."""
    add = lambda s, v: s + v
    ordered = F.array_sort(means)
    mid = (ordered[(n - 1) // 2] + ordered[n // 2]) / 2
    mean = F.aggregate(means, F.lit(0.0), add) / n
    sd = F.sqrt(F.aggregate(F.transform(means, lambda v: (v - mean) * (v - mean)), F.lit(0.0), add) / n)
    return F.struct(F.when(F.abs(mean) < 1e-9, 0.0).otherwise(sd / mean).alias("cv"), F.when(F.abs(mid) < 1e-9, 0.0).otherwise((F.array_max(means) - mid) / mid).alias("patchiness"))


def _mirrored(values: Column, height: int, width: int, i: Column, dy: int, dx: int) -> Column:
    """The value at an offset of one at most, borders mirrored without repeating the edge."""
    mirror = lambda v, n: F.when(v < 0, -v).when(v >= n, 2 * n - 2 - v).otherwise(v)
    return F.get(values, (mirror(F.floor(i / width) + dy, height) * width + mirror(i % width + dx, width)).cast("int"))


def laplacian_variance(values: Column, height: int, width: int) -> Column:
    """Population variance of the four-neighbour Laplacian, from whole-number sums."""

    def at(i: Column) -> Column:
        near = [_mirrored(values, height, width, i, dy, dx) for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0))]
        return (near[0] + near[1] + near[2] + near[3] - 4 * F.get(values, i)).cast("long")

    long = lambda v: F.lit(v).cast("long")
    add = lambda a, x: F.struct((a["s"] + x).alias("s"), (a["q"] + x * x).alias("q"))
    n = height * width
    return F.aggregate(F.transform(_places(height, width), at), F.struct(long(0).alias("s"), long(0).alias("q")), add, lambda a: (n * a["q"] - a["s"] * a["s"]) / (n * n))


def tenengrad(values: Column, height: int, width: int) -> Column:
    """Mean of the squared gradient by the 3 x 3 Sobel masks, borders mirrored."""
    long = F.lit(0).cast("long")

    def at(i: Column) -> Column:
        v = lambda dy, dx: _mirrored(values, height, width, i, dy, dx)
        gx = v(-1, 1) + 2 * v(0, 1) + v(1, 1) - v(-1, -1) - 2 * v(0, -1) - v(1, -1)
        gy = v(1, -1) + 2 * v(1, 0) + v(1, 1) - v(-1, -1) - 2 * v(-1, 0) - v(-1, 1)
        return (gx * gx + gy * gy).cast("long")

    return F.aggregate(F.transform(_places(height, width), at), long, lambda a, x: a + x) / (height * width)


def touching(keys: Column, height: int, width: int) -> Column:
    """Distinct pairs (a, b), a < b, of different keys in neighbouring pixels (eight neighbours); a null key touches nothing."""
    parts = []
    for dy, dx in ((0, 1), (1, 0), (1, 1), (1, -1)):
        parts.append(_pairs(keys, _places(height, width, dy, dx), dy * width + dx))
    return F.array_distinct(F.flatten(F.array(*parts)))


def _pairs(keys: Column, places: Column, step: int) -> Column:
    def pair(i: Column) -> Column:
        a, b = F.get(keys, i), F.get(keys, i + step)
        return F.when(a != b, F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))

    return F.filter(F.transform(places, pair), lambda p: p.isNotNull())
