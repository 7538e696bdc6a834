"""Pixel statistics as relational plans, and kernels over encoded tiles, on the stand-in tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..kernels import images as kernels
from ..operators import components, images, mosaic, pixels
from ..registry import query, r6
from .standins import grids, sql, table
from .standins import pixels as tiles


@query("patch_histogram", sql("SELECT vec_id, v, count(*) AS n FROM pixels GROUP BY 1, 2", "pixels"))
def patch_histogram(spark, d):
    return pixels.histogram(tiles(spark, d), "vec_id")


_OTSU = """+ h AS (SELECT vec_id, v, count(*) AS n FROM pixels GROUP BY 1, 2), c AS (SELECT vec_id, v, sum(n) OVER up AS w0, sum(n * v) OVER up AS s0, sum(n) OVER al AS w, sum(n * v) OVER al AS s, sum(n * v * v) OVER al AS q FROM h WINDOW up AS (PARTITION BY vec_id ORDER BY v), al AS (PARTITION BY vec_id)),
 b AS (SELECT *, CASE WHEN w0 < w THEN CAST(w * s0 - w0 * s AS DOUBLE) * CAST(w * s0 - w0 * s AS DOUBLE) / CAST(w0 * (w - w0) AS DOUBLE) ELSE 0 END AS b FROM c), t AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY b DESC, v) AS k FROM b) """


@query("patch_otsu", sql(_OTSU + "SELECT vec_id, v AS threshold FROM t WHERE k = 1", "pixels"))
def patch_otsu(spark, d):
    return pixels.otsu(tiles(spark, d), "vec_id").select("vec_id", "threshold")


@query("patch_separability", sql(_OTSU + "SELECT vec_id, round_even(CASE WHEN w * q - s * s > 0 THEN b / CAST(w * q - s * s AS DOUBLE) ELSE 0 END, 6) AS eta FROM t WHERE k = 1", "pixels"))
def patch_separability(spark, d):
    return pixels.otsu(tiles(spark, d), "vec_id").select("vec_id", r6("eta").alias("eta"))


@query("patch_coverage", sql(_OTSU + "SELECT vec_id, CAST(w - w0 AS DOUBLE) / CAST(w AS DOUBLE) AS coverage FROM t WHERE k = 1", "pixels"))
def patch_coverage(spark, d):
    return pixels.otsu(tiles(spark, d), "vec_id").select("vec_id", "coverage")


@query("patch_glcm", sql("""+ o AS (SELECT * FROM (VALUES (0, 0, 1), (1, -1, 1), (2, -1, 0), (3, -1, -1)) t(o, dy, dx)), m AS (SELECT a.vec_id, o, CAST(sum((a.v - b.v) * (a.v - b.v)) AS DOUBLE) / count(*) AS m FROM pixels a, o, pixels b WHERE a.vec_id = b.vec_id AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY 1, 2)
 SELECT vec_id, round_even(sum(m) / 4, 5) AS contrast FROM m GROUP BY 1""", "pixels"))
def patch_glcm(spark, d):
    return grids(spark, d).select("vec_id", F.bround(pixels.glcm_contrast(F.col("vs"), 8, 8), 5).alias("contrast"))


@query("patch_tile_cv", sql("""+ c AS (SELECT vec_id, CASE WHEN y < 6 THEN y // 3 ELSE 2 END AS r, CASE WHEN x < 6 THEN x // 3 ELSE 2 END AS c, CAST(sum(v) AS DOUBLE) / count(*) AS m FROM pixels GROUP BY 1, 2, 3)
 SELECT vec_id, round_even(CASE WHEN abs(avg(m)) < 1e-9 THEN 0 ELSE stddev_pop(m) / avg(m) END, 5) AS cv, round_even(CASE WHEN abs(median(m)) < 1e-9 THEN 0 ELSE (max(m) - median(m)) / median(m) END, 5) AS patchiness FROM c GROUP BY 1""", "pixels"))
def patch_tile_cv(spark, d):
    cuts = pixels.cuts_of(8, 3)
    means = grids(spark, d).select("vec_id", pixels.cell_means(F.col("vs"), 8, cuts, cuts).alias("m"))
    return means.select("vec_id", pixels.spread_of(F.col("m"), 9).alias("s")).select("vec_id", F.bround("s.cv", 5).alias("cv"), F.bround("s.patchiness", 5).alias("patchiness"))


@query("patch_quadrants", sql("""+ q AS (SELECT vec_id, CAST(sum(v) FILTER (y < 4 AND x < 4) AS DOUBLE) / 16 AS tl, CAST(sum(v) FILTER (y < 4 AND x >= 4) AS DOUBLE) / 16 AS tr, CAST(sum(v) FILTER (y >= 4 AND x < 4) AS DOUBLE) / 16 AS bl, CAST(sum(v) FILTER (y >= 4 AND x >= 4) AS DOUBLE) / 16 AS br FROM pixels GROUP BY 1)
 SELECT *, greatest(tl, tr, bl, br) - least(tl, tr, bl, br) AS spread FROM q""", "pixels"))
def patch_quadrants(spark, d):
    return grids(spark, d).select("vec_id", pixels.quarter_means(F.col("vs"), 8, 8).alias("q")).select("vec_id", "q.*")


@query("patch_laplacian", sql("""+ n AS (SELECT a.vec_id, a.y, a.x, a.v, abs(a.y + dy) - CASE WHEN a.y + dy > 7 THEN 2 * (a.y + dy - 7) ELSE 0 END AS y2, abs(a.x + dx) - CASE WHEN a.x + dx > 7 THEN 2 * (a.x + dx - 7) ELSE 0 END AS x2 FROM pixels a, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) t(dy, dx)),
 l AS (SELECT n.vec_id, n.y, n.x, sum(b.v) - 4 * any_value(n.v) AS l FROM n JOIN pixels b ON n.vec_id = b.vec_id AND n.y2 = b.y AND n.x2 = b.x GROUP BY 1, 2, 3)
 SELECT vec_id, round_even(CAST(count(*) * sum(l * l) - sum(l) * sum(l) AS DOUBLE) / (count(*) * count(*)), 5) AS laplacian_variance FROM l GROUP BY 1""", "pixels"))
def patch_laplacian(spark, d):
    return grids(spark, d).select("vec_id", F.bround(pixels.laplacian_variance(F.col("vs"), 8, 8), 5).alias("laplacian_variance"))


@query("scan_filters", sql("""+ g AS (SELECT vec_id, CAST((vec_id // 4) * 8 + y AS INTEGER) AS gy, CAST((vec_id % 4) * 8 + x AS INTEGER) AS gx, v FROM pixels), e AS (SELECT max(gy) AS h FROM g),
 n AS (SELECT g.vec_id, gy, gx, v, dy, dx, abs(gy + dy) - CASE WHEN gy + dy > h THEN 2 * (gy + dy - h) ELSE 0 END AS y2, abs(gx + dx) - CASE WHEN gx + dx > 31 THEN 2 * (gx + dx - 31) ELSE 0 END AS x2 FROM g, e, (VALUES (-1), (0), (1)) a(dy), (VALUES (-1), (0), (1)) b(dx)),
 s AS (SELECT n.vec_id, n.gy, n.gx, sum(b.v) AS box, sum(CASE WHEN abs(dy) + abs(dx) = 1 THEN b.v ELSE 0 END) - 4 * any_value(n.v) AS l FROM n JOIN g b ON n.y2 = b.gy AND n.x2 = b.gx GROUP BY 1, 2, 3)
 SELECT vec_id, sum(box)::BIGINT AS box_total, max(box)::BIGINT AS box_top, sum(abs(l))::BIGINT AS edges, round_even(CAST(count(*) * sum(l * l) - sum(l) * sum(l) AS DOUBLE) / (count(*) * count(*)), 5) AS laplacian_variance FROM s GROUP BY 1""", "pixels"))
def scan_filters(spark, d):
    """All tiles as one scan, four tiles wide: box sums and the Laplacian of each tile with its neighbours' pixels around it."""
    tiles = grids(spark, d).where("vec_id is not null").select("vec_id", F.floor(F.col("vec_id") / 4).cast("int").alias("ty"), (F.col("vec_id") % 4).cast("int").alias("tx"), "vs")
    p = mosaic.padded(tiles, [], "vs", 8, 8, 1, ["vec_id"], across=4)
    f = p.select("vec_id", mosaic.box_sum(F.col("padded"), 8, 8, 1).alias("box"), mosaic.laplacian(F.col("padded"), 8, 8).alias("lap"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    n, s, q = F.size("lap"), total(F.col("lap")), total(F.transform("lap", lambda x: x.cast("long") * x))
    return f.select("vec_id", total(F.col("box")).alias("box_total"), F.array_max("box").cast("long").alias("box_top"), total(F.transform("lap", F.abs)).alias("edges"), F.bround((n * q - s * s) / (n * n), 5).alias("laplacian_variance"))


@query("scan_regions", sql("""+ m AS (SELECT CAST((vec_id // 4) * 8 + y AS BIGINT) AS y, CAST((vec_id % 4) * 8 + x AS BIGINT) AS x FROM pixels WHERE v > 155), n AS (SELECT a.y, a.x, b.y AS y2, b.x AS x2 FROM m a JOIN m b ON b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1),
 r AS (SELECT y, x, y AS ry, x AS rx FROM m UNION SELECT n.y2, n.x2, r.ry, r.rx FROM r JOIN n ON n.y = r.y AND n.x = r.x WHERE (n.y2, n.x2) > (r.ry, r.rx)),
 c AS (SELECT y, x, min({'y': ry, 'x': rx}) AS root FROM r GROUP BY 1, 2)
 SELECT root.y AS y, root.x AS x, count(*) AS area, min(y) AS top, min(x) AS left, max(y) AS bottom, max(x) AS right FROM c GROUP BY root""", "pixels").replace("WITH ", "WITH RECURSIVE ", 1))
def scan_regions(spark, d):
    """All tiles as one scan, four tiles wide: the components of its bright pixels across all borders of tiles."""
    tiles = grids(spark, d).select(F.floor(F.col("vec_id") / 4).cast("int").alias("ty"), (F.col("vec_id") % 4).cast("int").alias("tx"), F.transform("vs", lambda v: v > 155).alias("m"))
    return components.regions(tiles, [], F.col("m"), 8, 8)


@query("touching_pairs", sql("""+ m AS (SELECT vec_id, y, x, v // 32 AS k FROM pixels WHERE v > 96), p AS (SELECT DISTINCT a.vec_id, least(a.k, b.k) AS a, greatest(a.k, b.k) AS b FROM m a JOIN m b ON a.vec_id = b.vec_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND a.k <> b.k)
 SELECT vec_id, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b FROM p""", "pixels"))
def touching_pairs(spark, d):
    keys = F.transform("vs", lambda v: F.when(v > 96, F.floor(v / 32).cast("int")))
    return grids(spark, d).select("vec_id", F.explode(pixels.touching(keys, 8, 8)).alias("p")).select("vec_id", "p.a", "p.b")


_SOBEL = """+ n AS (SELECT a.vec_id, a.y, a.x, dy, dx, abs(a.y + dy) - CASE WHEN a.y + dy > 7 THEN 2 * (a.y + dy - 7) ELSE 0 END AS y2, abs(a.x + dx) - CASE WHEN a.x + dx > 7 THEN 2 * (a.x + dx - 7) ELSE 0 END AS x2 FROM pixels a, (SELECT unnest(range(-1, 2)) AS dy) t, (SELECT unnest(range(-1, 2)) AS dx) u),
 g AS (SELECT n.vec_id, n.y, n.x, sum(b.v * dx * (2 - abs(dy))) AS gx, sum(b.v * dy * (2 - abs(dx))) AS gy FROM n JOIN pixels b ON n.vec_id = b.vec_id AND n.y2 = b.y AND n.x2 = b.x GROUP BY 1, 2, 3)
 SELECT vec_id, round_even(CAST(sum(gx * gx + gy * gy) AS DOUBLE) / count(*), 4) AS tenengrad FROM g GROUP BY 1"""


@query("patch_tenengrad", sql(_SOBEL, "pixels"))
def patch_tenengrad(spark, d):
    """The squared gradient of a tile as an array expression."""
    return grids(spark, d).select("vec_id", F.bround(pixels.tenengrad(F.col("vs"), 8, 8), 4).alias("tenengrad"))


def _small(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(8, 8)


@query("kernel_tenengrad", sql(_SOBEL, "pixels"))
def kernel_tenengrad(spark, d):
    """The same by the image kernel."""
    got = images.signals(tile_bytes(spark, d), lambda x: {"tenengrad": kernels.tenengrad(x)}, ("tenengrad",), decode=_small)
    return got.select("vec_id", F.bround("tenengrad", 4).alias("tenengrad"))


_BLUR = """+ n AS (SELECT a.vec_id, a.y, a.x, dy.k AS ky, dx.k AS kx, abs(a.y + dy.o) - CASE WHEN a.y + dy.o > 7 THEN 2 * (a.y + dy.o - 7) ELSE 0 END AS y2, abs(a.x + dx.o) - CASE WHEN a.x + dx.o > 7 THEN 2 * (a.x + dx.o - 7) ELSE 0 END AS x2
  FROM pixels a, (VALUES (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)) dy(o, k), (VALUES (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)) dx(o, k)),
 soft AS (SELECT n.vec_id, n.y, n.x, CAST((sum(b.v * ky * kx) + 128) // 256 AS BIGINT) AS v FROM n JOIN pixels b ON n.vec_id = b.vec_id AND n.y2 = b.y AND n.x2 = b.x GROUP BY 1, 2, 3),
 h AS (SELECT vec_id, v, count(*) AS n FROM soft GROUP BY 1, 2), c AS (SELECT vec_id, v, sum(n) OVER up AS w0, sum(n * v) OVER up AS s0, sum(n) OVER al AS w, sum(n * v) OVER al AS s FROM h WINDOW up AS (PARTITION BY vec_id ORDER BY v), al AS (PARTITION BY vec_id)),
 b AS (SELECT *, CASE WHEN w0 < w THEN CAST(w * s0 - w0 * s AS DOUBLE) * CAST(w * s0 - w0 * s AS DOUBLE) / CAST(w0 * (w - w0) AS DOUBLE) ELSE 0 END AS b FROM c), t AS (SELECT vec_id, max(round_even(b, 6)) AS top FROM b GROUP BY 1)"""


@query("kernel_mask", sql(_BLUR + " SELECT vec_id, round_even(top / 4096, 3) AS between, CAST(sum(s.v) AS BIGINT) AS soft FROM t JOIN soft s USING (vec_id) GROUP BY 1, top", "pixels"))
def kernel_mask(spark, d):
    """Blurred tile and the largest between-class variance that the mask's level reaches, by the image kernel."""

    def kernel(x: np.ndarray) -> dict[str, float]:
        soft = kernels.softened(x).astype(np.int64)
        on = soft > kernels.otsu_level(soft.astype(np.uint8))
        n, low = on.size, int((~on).sum())
        gap = n * int(soft[~on].sum()) - low * int(soft.sum())
        return {"between": round(gap * gap / (low * (n - low)), 6) / 4096 if 0 < low < n else 0.0, "soft": float(soft.sum())}

    got = images.signals(tile_bytes(spark, d), kernel, ("between", "soft"), decode=_small)
    return got.select("vec_id", F.bround("between", 3).alias("between"), F.col("soft").cast("long").alias("soft"))


_RING = ", ".join(f"({k}, {float(np.round(-3 * np.sin(2 * np.pi * k / 24), 5))!r}::DOUBLE, {float(np.round(3 * np.cos(2 * np.pi * k / 24), 5))!r}::DOUBLE)" for k in range(24))


@query("kernel_lbp", sql(f"""+ o AS (SELECT k, dy, dx FROM (VALUES {_RING}) t(k, dy, dx)), p AS (SELECT a.vec_id, a.y, a.x, a.v, k, CAST(floor(a.y + dy) AS INTEGER) AS fy, CAST(floor(a.x + dx) AS INTEGER) AS fx, a.y + dy - floor(a.y + dy) AS wy, a.x + dx - floor(a.x + dx) AS wx FROM pixels a, o),
 q AS (SELECT p.*, coalesce(p00.v, 0)::DOUBLE AS a, coalesce(p01.v, 0)::DOUBLE AS b, coalesce(p10.v, 0)::DOUBLE AS c, coalesce(p11.v, 0)::DOUBLE AS e FROM p LEFT JOIN pixels p00 ON p00.vec_id = p.vec_id AND p00.y = fy AND p00.x = fx LEFT JOIN pixels p01 ON p01.vec_id = p.vec_id AND p01.y = fy AND p01.x = fx + 1 LEFT JOIN pixels p10 ON p10.vec_id = p.vec_id AND p10.y = fy + 1 AND p10.x = fx LEFT JOIN pixels p11 ON p11.vec_id = p.vec_id AND p11.y = fy + 1 AND p11.x = fx + 1),
 bits AS (SELECT vec_id, y, x, k, CAST((1 - wy) * ((1 - wx) * a + wx * b) + wy * ((1 - wx) * c + wx * e) >= v AS INTEGER) AS bit FROM q),
 turns AS (SELECT *, CASE WHEN k > 0 THEN abs(bit - lag(bit) OVER (PARTITION BY vec_id, y, x ORDER BY k)) ELSE 0 END AS turn FROM bits), codes AS (SELECT vec_id, y, x, CASE WHEN sum(turn) <= 2 THEN sum(bit) ELSE 25 END AS code FROM turns GROUP BY 1, 2, 3),
 n AS (SELECT vec_id, code, count(*) / 64::DOUBLE AS p FROM codes GROUP BY 1, 2) SELECT vec_id, round_even(-sum(p * log2(p)), 6) AS entropy FROM n GROUP BY 1""", "pixels"))
def kernel_lbp(spark, d):
    """Entropy of the tile's uniform patterns by the image kernel."""
    got = images.signals(tile_bytes(spark, d), lambda x: {"entropy": kernels.lbp_entropy(x)}, ("entropy",), decode=_small)
    return got.select("vec_id", F.bround("entropy", 6).alias("entropy"))


@query("kernel_grid", sql("""+ c AS (SELECT vec_id, CASE WHEN y < 6 THEN y // 3 ELSE 2 END AS r, CASE WHEN x < 6 THEN x // 3 ELSE 2 END AS c, CAST(sum(v) AS DOUBLE) / count(*) AS m FROM pixels GROUP BY 1, 2, 3)
 SELECT vec_id, round_even(CASE WHEN abs(avg(m)) < 1e-9 THEN 0 ELSE stddev_pop(m) / avg(m) END, 5) AS cv, round_even(CASE WHEN abs(median(m)) < 1e-9 THEN 0 ELSE (max(m) - median(m)) / median(m) END, 5) AS patchiness FROM c GROUP BY 1""", "pixels"))
def kernel_grid(spark, d):
    """Spread of the mean values of a tile's nine parts by the image kernel."""

    def kernel(x: np.ndarray) -> dict[str, float]:
        cells = kernels.tiles(x, 3, np.mean)
        return {"cv": kernels.variation(cells), "patchiness": kernels.patchiness(cells)}

    got = images.signals(tile_bytes(spark, d), kernel, ("cv", "patchiness"), decode=_small)
    return got.select("vec_id", F.bround("cv", 5).alias("cv"), F.bround("patchiness", 5).alias("patchiness"))


@query("corner_crops", sql("""+ k AS (SELECT vec_id, (vec_id % 7) / 7::DOUBLE AS cy, (vec_id % 5) / 5::DOUBLE AS cx FROM (SELECT DISTINCT vec_id FROM pixels)), b AS (SELECT vec_id, CAST(floor(cy * 64) AS INTEGER) AS y, CAST(floor(cx * 64) AS INTEGER) AS x, 38 AS side FROM k),
 box AS (SELECT vec_id, n, CASE WHEN n IN ('tl', 'tr') THEN y ELSE y - side END AS top, CASE WHEN n IN ('tl', 'bl') THEN x ELSE x - side END AS "left", side FROM b, (VALUES ('tl'), ('tr'), ('bl'), ('br')) t(n)),
 cut AS (SELECT vec_id, n, greatest(top, 0) AS y0, least(top + side, 64) AS y1, greatest("left", 0) AS x0, least("left" + side, 64) AS x1 FROM box UNION ALL SELECT vec_id, 'whole', 0, 64, 0, 64 FROM b),
 part AS (SELECT * FROM cut WHERE least(y1 - y0, x1 - x0) >= 8),
 s AS (SELECT c.vec_id, c.n, (y1 - y0) * (x1 - x0) AS area, sum(p.v * greatest(0, least(y1, 8 * p.y + 8) - greatest(y0, 8 * p.y)) * greatest(0, least(x1, 8 * p.x + 8) - greatest(x0, 8 * p.x))) AS total FROM part c JOIN pixels p USING (vec_id) GROUP BY ALL)
 SELECT vec_id, n AS crop, CAST(area AS BIGINT) AS area, round_even(CAST(total AS DOUBLE) / area, 6) AS mean FROM s""", "pixels"))
def corner_crops(spark, d):
    """One image to up to five: the whole and the crops that put a point into a corner, with their mean values."""

    def run(batches):
        for batch in batches:
            rows = []
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [(k, name, crop.size, float(crop.mean())) for name, crop in kernels.corner_crops(_grid(raw), ((k % 7) / 7, (k % 5) / 5))]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.float64()), strict=True)], names=["vec_id", "crop", "area", "mean"])

    return tile_bytes(spark, d).mapInArrow(run, "vec_id long, crop string, area long, mean double").withColumn("mean", r6("mean"))


def tile_bytes(spark, d):
    """Tiles of 8 x 8 as the raw bytes of their grey values, dealt to all cores: kernels cost far more than these bytes suggest."""
    return grids(spark, d).select("vec_id", F.unhex(F.array_join(F.transform("vs", lambda v: F.lpad(F.hex(v), 2, "0")), "")).alias("content")).repartition(spark.sparkContext.defaultParallelism)


def _grid(raw: bytes) -> np.ndarray:
    """An 8 x 8 tile, each pixel as a block of 8 x 8, so that kernels have room."""
    return np.kron(np.frombuffer(raw, np.uint8).reshape(8, 8), np.ones((8, 8), np.uint8))


@query("field_features")
def field_features(spark, d):
    return images.field_signals(tile_bytes(spark, d), decode=_grid, blur_shrink=4, lbp_step=2)


@query("focus_features")
def focus_features(spark, d):
    return images.focus_signals(tile_bytes(spark, d), decode=_grid)


@query("halo_signals")
def halo_signals(spark, d):
    return images.halo_signals(tile_bytes(spark, d), decode=_grid)


@query("halo_presence")
def halo_presence(spark, d):
    """Signals to decisions, the diffuse candidates checked against the two fields before, and the folded verdict."""
    s = images.halo_signals(tile_bytes(spark, d), decode=_grid).withColumn("slide_id", F.col("vec_id") % 10)
    c = F.col
    s = s.withColumn("present", scoring.halo_decision(c("contrast_ratio"), c("anisotropy"), c("radial_rho"), c("r2_over_r1")))
    near = F.collect_list(F.struct(c("diffuse_radius").alias("radius"), c("diffuse_centroid_x").alias("x"), c("diffuse_centroid_y").alias("y"))).over(Window.partitionBy("slide_id").orderBy("vec_id").rangeBetween(-20, -1))
    s = s.withColumn("near", near).withColumn("candidate", scoring.diffuse_candidate(c("contrast_ratio"), c("diffuse_radius")))
    trend = scoring.follows_neighbours(c("diffuse_radius"), c("diffuse_centroid_x"), c("diffuse_centroid_y"), c("near"))
    s = s.withColumn("diffuse_flag", c("candidate") & ~trend)
    return s.select("vec_id", "slide_id", "contrast_ratio", "present", r6(scoring.halo_confidence(c("contrast_ratio"), c("present"))).alias("confidence"), "candidate", "diffuse_flag", (c("present") | c("diffuse_flag")).alias("present_folded"))


@query("halo_decision", "WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity / 10 AS ratio, l_discount * 5 AS anis, l_tax * 12 AS rho, l_extendedprice / 200000 AS r2 FROM lineitem), k AS (SELECT *, ratio >= 3 AND (anis <= 0.35 OR (rho > 0.9 AND r2 < 0.44)) AS present FROM s) SELECT present, count(*) AS n, round_even(sum(CASE WHEN ratio >= 3 AND NOT present THEN 0 ELSE least(1, greatest(0, (ratio - 2.1::DOUBLE) / 3.9::DOUBLE)) END), 3) AS confidence, count(CASE WHEN ratio >= 2.3::DOUBLE AND ratio < 3 AND l_partkey >= 50 THEN 1 END) AS candidates FROM k GROUP BY 1")
def halo_decision(spark, d):
    """The decision layer on arbitrary signals, each branch of it met."""
    l = table(spark, d, "lineitem")  # noqa: E741
    s = l.select("l_partkey", (F.col("l_quantity") / 10).alias("ratio"), (F.col("l_discount") * 5).alias("anis"), (F.col("l_tax") * 12).alias("rho"), (F.col("l_extendedprice") / 200000).alias("r2"))
    s = s.withColumn("present", scoring.halo_decision(F.col("ratio"), F.col("anis"), F.col("rho"), F.col("r2")))
    cand = scoring.diffuse_candidate(F.col("ratio"), F.col("l_partkey"))
    return s.groupBy("present").agg(F.count(F.lit(1)).alias("n"), F.bround(F.sum(scoring.halo_confidence(F.col("ratio"), F.col("present"))), 3).alias("confidence"), F.count(F.when(cand, 1)).alias("candidates"))


@query("crenation")
def crenation(spark, d):
    """Outlined holes to fields: how many, the largest one's band power, and the median."""
    c = images.cells(tile_bytes(spark, d), decode=_grid, least=16)
    return c.groupBy("vec_id").agg(F.count("cell").alias("n_parts"), F.max("area").alias("largest"), F.max_by("band_power", F.struct("area", "cell")).alias("largest_power"), F.median("band_power").alias("median_power"))


@query("cell_metrics")
def cell_metrics(spark, d):
    """Fragments and merged parts by the upper quartile of areas, and how uneven the rest is."""
    c = images.cells(tile_bytes(spark, d), decode=_grid, least=16, kernel=kernels.parts, many=kernels.parts_of).where("vec_id is not null")
    q = F.percentile("area", F.lit(0.75)).over(Window.partitionBy("vec_id"))  # a join would cut out the cells of every tile twice
    part = c.withColumn("q", q).withColumn("kind", F.when(F.col("area") < 0.35 * F.col("q"), "fragment").when(F.col("area") > 1.6 * F.col("q"), "merged").otherwise("single"))
    single = F.col("kind") == "single"
    return part.groupBy("vec_id").agg(F.count(F.when(F.col("kind") == "fragment", 1)).alias("n_fragments"), F.count(F.when(F.col("kind") == "merged", 1)).alias("n_merged"), F.count(F.when(single, 1)).alias("n_single"), F.median(F.when(single, F.col("area"))).alias("median_area"), F.count(F.when(single & (F.col("solidity") < 0.75), 1)).alias("n_crenated"))


@query("cell_signals")
def cell_signals(spark, d):
    return images.signals(tile_bytes(spark, d), kernels.cell_signals, kernels.CELLS, decode=_grid, many=kernels.cell_signals_of)


@query("four_step")
def four_step(spark, d):
    return images.signals(tile_bytes(spark, d), kernels.four_step, kernels.FOUR_STEP, decode=_grid)
