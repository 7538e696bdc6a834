"""Connected components of masks that are cut into tiles, of any size and shape, by contraction of a graph of runs.

A run is a stretch of set pixels in one row of one tile. Runs that touch, in the same row across a tile's border
or in the next row, are edges; alternate stars, towards the least of a run's neighbours, contract the graph
to one star a component in a number of rounds that grows with the logarithm of its length. No task
holds a scan or a component.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import written


def runs(tiles: DataFrame, scan: Sequence[str], mask: Column, height: int, width: int) -> DataFrame:
    """(scan, tx, y, x0, x1): the runs of each tile's rows, in coordinates of the scan; ``mask`` is an array of booleans, row by row, null not being set."""
    row = lambda r: F.transform(F.slice(F.col("_m"), r * width + 1, F.lit(width)), lambda v: F.coalesce(v, F.lit(False)))
    rows = tiles.select(*scan, "ty", "tx", mask.alias("_m")).select(*scan, "tx", F.col("ty"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(height - 1)), row)).alias("_r", "_v"))
    at = F.sequence(F.lit(0), F.lit(width - 1))
    here = lambda i: F.coalesce(F.get(F.col("_v"), i), F.lit(False))
    begins = F.filter(at, lambda i: here(i) & ~F.when(i == 0, False).otherwise(here(i - 1)))
    ends = F.filter(at, lambda i: here(i) & ~F.when(i == width - 1, False).otherwise(here(i + 1)))
    found = rows.where(F.exists("_v", lambda v: v)).select(*scan, "tx", (F.col("ty") * height + F.col("_r")).cast("long").alias("y"), F.explode(F.arrays_zip(begins.alias("a"), ends.alias("b"))).alias("p"))
    off = F.col("tx").cast("long") * width
    return found.select(*scan, "tx", "y", (off + F.col("p.a")).alias("x0"), (off + F.col("p.b")).alias("x1"))


def touching(found: DataFrame, scan: Sequence[str]) -> DataFrame:
    """(src, dst) for each pair of runs with pixels side by side or corner to corner; a run is named by (scan, y, x0).

    An equi-join by row and tile column: a run looks in the row below in its own column of tiles and the two
    beside it, and in its row in the next one, so it meets the runs of four rows of tiles at most.
    """
    name = F.struct(*scan, "y", "x0")
    looks = F.array(*(F.struct((F.col("y") + dy).alias("_y"), (F.col("tx") + dx).alias("_tx")) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))))
    a = found.select(*(F.col(s).alias(f"_{i}") for i, s in enumerate(scan)), name.alias("src"), F.col("x0").alias("_a0"), F.col("x1").alias("_a1"), F.explode(looks).alias("l")).select("*", "l._y", "l._tx").drop("l")
    b = found.withColumn("dst", name)
    on = (F.col("y") == F.col("_y")) & (F.col("tx") == F.col("_tx"))
    for i, s in enumerate(scan):
        on = on & F.col(s).eqNullSafe(F.col(f"_{i}"))
    return a.join(b, on).where((F.col("x0") <= F.col("_a1") + 1) & (F.col("_a0") <= F.col("x1") + 1)).select("src", "dst")


def contracted(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge: the least node of its component, nodes of any ordered type."""
    now = written(edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "edges")
    seen = None
    while True:
        # Every larger neighbour to the least one, then every smaller neighbour and the node itself to the least.
        both = now.unionByName(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = F.least(F.min("dst").over(Window.partitionBy("src")), F.col("src"))
        large = both.withColumn("low", low).where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct()
        small = large.withColumn("low", F.min("dst").over(Window.partitionBy("src")))
        now = written(small.select(F.when(F.col("dst") == F.col("low"), F.col("src")).otherwise(F.col("dst")).alias("src"), F.col("low").alias("dst")).where("src <> dst").distinct(), "edges")
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).head())
        if state == seen:
            return now.groupBy("src").agg(F.min("dst").alias("root")).select(F.col("src").alias("node"), "root")
        seen = state


def regions(tiles: DataFrame, scan: Sequence[str], mask: Column, height: int, width: int) -> DataFrame:
    """(scan, y, x, area, top, left, bottom, right) of each component of a cut mask; y and x are its first pixel's, in reading order of runs.

    Pixels that touch by a side or a corner belong together, within a tile and across its borders. A row is
    a tile; tiles that are missing are not set. An empty table or mask has no components.
    """
    found = written(runs(tiles, scan, mask, height, width), "runs")
    roots = contracted(touching(found, scan))
    own = found.withColumn("node", F.struct(*scan, "y", "x0"))
    named = own.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    per = named.groupBy("root").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area"), F.min("y").alias("top"), F.min("x0").alias("left"), F.max("y").alias("bottom"), F.max("x1").alias("right"))
    return per.select(*(F.col(f"root.{s}").alias(s) for s in scan), F.col("root.y").alias("y"), F.col("root.x0").alias("x"), "area", "top", "left", "bottom", "right")
