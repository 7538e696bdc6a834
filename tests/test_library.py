"""The library against SQL, committed arithmetic and small cases."""

import io
import json
import re
import struct
import zipfile
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tilewright.functions import robust, scoring, text
from tilewright.kernels import contours
from tilewright.kernels import images as kernels
from tilewright.operators import filters, images, models, pixels, relational
from tilewright.queries import QUERIES, SQL
from tilewright.sources import fetch, files, sinks
from tilewright.streaming import passes

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return c


def plain(df):
    def one(v):
        if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
            return "null"
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        if isinstance(v, (int, np.integer)) or isinstance(v, (float, np.floating)) and float(v).is_integer():
            return str(int(v))
        return f"{v:.9g}" if isinstance(v, (float, np.floating)) else str(v)

    return sorted(tuple(map(one, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    got, want = QUERIES[name](spark, SMALL).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_boundaries_of_scores(spark):
    df = spark.createDataFrame([(0.35,), (0.34999,), (0.65,), (None,)], "s double")
    got = [r[0] for r in df.select(scoring.bucket(F.col("s"), (0.35, 0.45, 0.55, 0.65), scoring.DENSITY_LEVELS)).collect()]
    assert got == ["monolayer", "sparser", "very dense", None]
    f = spark.createDataFrame([(0.1, None), (0.1, 0.1), (0.2, 0.1)], "a double, b double")
    cols = {"a": F.col("a"), "b": F.col("b")}
    assert [r[0] for r in f.select(scoring.gate_fired(cols, {"a": 0.2, "b": 0.2})).collect()] == [False, True, False]
    assert [r[0] for r in f.select(scoring.gate_fired(cols, {"a": 9, "b": 9}, enabled=False)).collect()] == [False] * 3
    w = scoring.weighted(cols, {"a": 0.75, "b": 0.25, "c": 1.0}, {"a": (0, 1), "b": (0, 1), "c": (0, 1)})
    assert [round(r[0], 9) for r in f.select(w).collect()] == [0.1, 0.1, 0.175]
    assert f.select(scoring.unit_range(F.col("a"), 1, 1)).head()[0] == 0.0
    with pytest.raises(Exception, match="unknown level"):
        spark.createDataFrame([("odd",)], "l string").select(scoring.ordinal(F.col("l"), scoring.DENSITY_LEVELS)).collect()


def test_degenerate_baselines(spark):
    rows = spark.createDataFrame([(1, i, 5) for i in range(30)] + [(2, 1, 7)], "slide_id int, fov_id int, n_detected long")
    got = robust.scored(rows).collect()
    assert all(r.z is None and "zero_or_undefined_baseline" in r.flags for r in got)
    assert next(r for r in got if r.slide_id == 2).std == 0.0


def test_nearest_equals_all_pairs(spark):
    r = np.random.default_rng(1)
    a, b = [(int(k), int(v), int(v) % 2) for k, v in enumerate(r.integers(0, 40, 60))], [(int(k), int(v), int(k) % 2) for k, v in enumerate(r.integers(0, 40, 25))]
    got = relational.nearest(spark.createDataFrame(a, "k int, v int, g int"), spark.createDataFrame(b, "k int, v int, g int"), "v", "k", ["g"]).collect()
    want = {k: min((abs(v - v2), k2) for k2, v2, g2 in b if g2 == g) for k, v, g in a}
    assert {x.k: (x.distance, x.control) for x in got} == want
    with pytest.raises(ValueError, match="group"):
        relational.nearest(spark.createDataFrame(a, "k int, v int, g int"), spark.createDataFrame(b, "k int, v int, g int"), "v", "k", [])


def test_containing_equals_all_pairs(spark):
    r = np.random.default_rng(2)
    word = lambda n: "".join(r.choice(list("abé "), n))
    rows = [(k, word(r.integers(0, 9))) for k in range(80)] + [(80, None), (81, "abab")]
    needles = sorted({word(n) for n in (1, 2, 3, 3, 4, 5, 6)}) + ["", None, "ab", "abab", "ab"]
    got = relational.containing(spark.createDataFrame(rows, "k int, name string"), "name", spark.createDataFrame([(n,) for n in needles], "needle string"), "needle").collect()
    assert sorted((x.k, x.needle) for x in got) == sorted((k, n) for k, t in rows if t for n in {n for n in needles if n} if n in t)


def test_filters(spark):
    rows = spark.createDataFrame([("a", "1.5", None), ("b", "x", 1), ("c", "NaN", 2), (None, "-2", 3), ("d", " inf", 4)], "slide_id string, v string, n int")
    assert [x.v for x in filters.numeric(rows, ["v"]).collect()] == [1.5, -2.0]
    assert filters.selected(rows, ["a", "zz"], strict=False).count() == 1
    with pytest.raises(ValueError, match="unknown: zz"):
        filters.selected(rows, ["a", "zz"])
    assert filters.selected(rows, [f"k{i}" for i in range(1500)] + ["a"], strict=False).count() == 1
    assert filters.excluded(rows, ["a"]).count() == 4 and filters.excluded(rows, []).count() == 5
    below, rest = filters.partition_by_cutoff(rows, "n", 2)
    assert (below.count(), rest.count(), filters.missing(rows, "n").count()) == (1, 3, 1)
    assert filters.in_catalog(rows).count() == 5 and filters.without_errors(rows.withColumn("error", F.when(F.col("n") > 2, "e"))).count() == 3
    assert filters.disagreements(rows, "n", F.lit(2), 1).count() == 3
    assert filters.usable_negatives(rows, F.col("n") > 3, F.concat_ws(";", "slide_id", F.lit("x")), ["b"]).count() == 2


def test_must_match_names_the_key(spark):
    a, b = spark.range(3).withColumnRenamed("id", "k"), spark.range(2).withColumnRenamed("id", "k")
    with pytest.raises(Exception, match="no partner for 2"):
        relational.must_match(a, b, ["k"]).collect()


def png(img, filters):
    h, w = img.shape[:2]
    n = 1 if img.ndim == 2 else 3
    raw, rows, prev = b"", (img if n == 1 else img[:, :, ::-1]).reshape(h, w * n).astype(int), np.zeros(w * n, int)
    for y in range(h):
        f, x = filters[y % len(filters)], rows[y]
        a, c = np.append([0] * n, x[:-n]), np.append([0] * n, prev[:-n])
        pred = {0: 0 * x, 1: a, 2: prev, 3: (a + prev) // 2}.get(f)
        if f == 4:
            p = a + prev - c
            d = np.abs(np.stack([p - a, p - prev, p - c]))
            pred = np.where((d[0] <= d[1]) & (d[0] <= d[2]), a, np.where(d[1] <= d[2], prev, c))
        raw += bytes([f]) + ((x - pred) & 255).astype(np.uint8).tobytes()
        prev = x
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0 if n == 1 else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_png_and_bmp_round_trip():
    r = np.random.default_rng(2)
    for shape in ((7, 5), (6, 9, 3)):
        img = r.integers(0, 256, shape).astype(np.uint8)
        assert (kernels.decode(png(img, [0, 1, 2, 3, 4])) == img).all()
    img = r.integers(0, 256, (3, 5, 3)).astype(np.uint8)
    pad = np.zeros((3, 1), np.uint8)
    body = np.concatenate([img[::-1].reshape(3, 15), pad], 1).tobytes()
    assert (kernels.decode(b"BM" + struct.pack("<IHHI", 0, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 5, 3, 1, 24, 0, 0, 0, 0, 0, 0) + body) == img).all()
    with pytest.raises(ValueError, match="not a PNG"):
        kernels.decode(b"GIF89a")


def disc(size=120, y=60, x=60, r=18, low=30, high=220):
    yy, xx = np.mgrid[:size, :size]
    return (low + (high - low) * np.exp(-((yy - y) ** 2 + (xx - x) ** 2) / (2 * r * r))).astype(np.uint8)


def test_kernels_on_plain_images():
    flat, halves = np.full((40, 40), 90, np.uint8), np.repeat([[20] * 20 + [200] * 20], 40, 0).astype(np.uint8)
    checks = ((np.indices((40, 40)).sum(0) % 2) * 255).astype(np.uint8)
    assert kernels.separability(flat) == 0.0 and kernels.separability(halves, 0) == pytest.approx(1.0)
    assert kernels.otsu_mask(halves, 0)[0].mean() == 0.5
    assert kernels.glcm_contrast(flat) == 0.0 and kernels.glcm_contrast(checks) == pytest.approx(255**2 / 2)
    assert kernels.edge_density(flat) == 0.0 and 0 < kernels.edge_density(halves) < 0.1
    assert kernels.lbp_entropy(flat) < kernels.lbp_entropy(checks) + 5
    assert kernels.laplacian_variance(flat) == 0.0 == kernels.tenengrad(flat)
    soft = np.rint(kernels.gaussian(checks, 9)).astype(np.uint8)
    assert kernels.laplacian_variance(soft) < kernels.laplacian_variance(checks)
    noise = np.random.default_rng(1).integers(0, 256, (40, 40)).astype(np.uint8)  # the measure takes the mean off, so a pattern of one frequency would not do
    assert kernels.high_frequency_ratio(np.rint(kernels.gaussian(noise, 9)).astype(np.uint8)) < kernels.high_frequency_ratio(noise)
    assert kernels.edge_width(flat) is None
    f = kernels.field_features(disc(), 2, 4)
    assert set(f) == set(images.FIELD) and all(np.isfinite(v) for v in f.values())
    assert set(kernels.focus_features(disc())) == set(images.FOCUS)
    assert [len(x) for x in np.array_split(np.arange(8), 3)] == [3, 3, 2]
    assert kernels.gaussian(disc(), 41).mean() == pytest.approx(disc().mean(), rel=0.05)
    assert kernels.area_resize(np.arange(16.0).reshape(4, 4), 2, 2).tolist() == [[2.5, 4.5], [10.5, 12.5]]


def test_lbp_equals_a_plain_loop():
    img = np.random.default_rng(3).integers(0, 255, (11, 9)).astype(np.uint8)
    angle = 2 * np.pi * np.arange(24) / 24
    offs = list(zip(np.round(-3 * np.sin(angle), 5), np.round(3 * np.cos(angle), 5), strict=True))
    px = lambda y, x: float(img[y, x]) if 0 <= y < 11 and 0 <= x < 9 else 0.0
    for step in (1, 3):
        got = kernels.lbp_codes(img, step=step)
        for i, y in enumerate(range(0, 11, step)):
            for j, x in enumerate(range(0, 9, step)):
                bits = []
                for dy, dx in offs:
                    fy, fx = int(np.floor(y + dy)), int(np.floor(x + dx))
                    wy, wx = y + dy - fy, x + dx - fx
                    v = (1 - wy) * ((1 - wx) * px(fy, fx) + wx * px(fy, fx + 1)) + wy * ((1 - wx) * px(fy + 1, fx) + wx * px(fy + 1, fx + 1))
                    bits.append(v >= px(y, x))
                turns = sum(a != b for a, b in zip(bits, bits[1:], strict=False))
                assert got[i, j] == (sum(bits) if turns <= 2 else 25)


def test_components_and_outlines():
    m = np.zeros((30, 30), bool)
    m[2:8, 2:8] = m[8:10, 8:20] = True
    m[20:25, 20:25] = True
    label, n = kernels.components(m)
    assert n == 2 and label[2, 2] == label[9, 19] and label[0, 0] == 0
    assert kernels.outline(m & (label == label[22, 22])) == {"area": 16.0, "length": 16.0, "cy": 22.0, "cx": 22.0, "solidity": 1.0}
    assert kernels.touching(np.array([[1, 0, 2], [0, 3, 0]])) == [(1, 3), (2, 3)]
    snake = np.zeros((41, 41), bool)
    snake[::2] = True
    snake[1::4, -1] = snake[3::4, 0] = True
    assert kernels.components(snake)[1] == 1


def walked(part):
    """The outer outline of a part, pixel after pixel: the next set neighbour, looked for from where the last one was come from."""
    steps = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]
    p = np.pad(part, 1)
    start = tuple(int(v) for v in np.argwhere(p)[0])
    at, way, out = start, 6, []
    first = None
    while True:
        for k in range(8):
            d = (way + k) % 8
            to = (at[0] + steps[d][0], at[1] + steps[d][1])
            if p[to]:
                break
        else:
            return [(at[0] - 1, at[1] - 1)]
        if first is None:
            first = (at, to)
        elif (at, to) == first:
            return out
        out.append((at[0] - 1, at[1] - 1))
        at, way = to, (d + 5) % 8


def ring_measures(ring):
    y, x = np.array(ring, float).T
    y2, x2 = np.roll(y, -1), np.roll(x, -1)
    cross = x * y2 - x2 * y
    area = cross.sum() / 2
    length = np.hypot(y2 - y, x2 - x).sum()
    centre = (((y + y2) * cross).sum() / (6 * area), ((x + x2) * cross).sum() / (6 * area)) if abs(area) > 1e-9 else None
    return abs(area), length, centre


def test_outlines_equal_walked_ones():
    r = np.random.default_rng(11)
    for k in range(150):
        m = r.random((14, 17)) < r.uniform(0.25, 0.75)
        if not m.any():
            continue
        part = kernels.largest(m)
        got = kernels.outline(part)
        ring = walked(kernels.filled(part))
        area, length, centre = ring_measures(ring)
        assert got["area"] == pytest.approx(area) and got["length"] == pytest.approx(length), k
        if centre:
            assert (got["cy"], got["cx"]) == pytest.approx(centre)
        # The hull through all pixels by brute force: no pixel lies outside any of its edges.
        y, x = np.nonzero(part)
        ring = contours.hull(np.stack([x, y], 1))
        if len(ring) > 2:
            e = np.roll(ring, -1, 0) - ring
            side = e[:, :1] * (y - ring[:, 1:]) - e[:, 1:] * (x - ring[:, :1])
            assert (side <= 1e-9).all() or (side >= -1e-9).all()


def test_holes_are_those_of_plain_rings():
    m = np.zeros((60, 60), bool)
    m[5:40, 5:40] = True
    m[10:30, 12:30] = False  # 20 x 18 clear pixels: an outline of 21 x 19 through the pixels around them, its four corners cut
    m[45:55, 45:55] = True
    m[48:50, 48:50] = False
    rows = kernels.holes(m, 50)
    assert [(x["area"], x["cy"], x["cx"], x["solidity"]) for x in rows] == [(21 * 19.0 - 2, 19.5, 20.5, 1.0)]
    assert len(kernels.holes(m, 1)) == 2 and kernels.holes(m, 50, 0.05) == [] and kernels.holes(~np.pad(np.zeros((4, 4), bool), 20), 1) == []
    yy, xx = np.mgrid[:200, :200]
    angle, far = np.arctan2(yy - 100, xx - 100), np.hypot(yy - 100, xx - 100)
    for waves, high in ((12, True), (3, False)):
        ring = far > 60 + 6 * np.cos(waves * angle)
        row = kernels.holes(ring, 50)[0]
        assert (row["band_power"] > 0.7) == high and row["area"] == pytest.approx(np.pi * (60**2 + 18), rel=0.03)
    rot = kernels.holes(np.rot90(far > 60 + 6 * np.cos(12 * angle)), 50)[0]
    assert rot["area"] == pytest.approx(kernels.holes(far > 60 + 6 * np.cos(12 * angle), 50)[0]["area"])


def tiff(img, compress=1, bits=8, order="<", predictor=1, tile=None, ink=None, rows=4):
    h, w = img.shape[:2]
    n = 1 if img.ndim == 2 else 3
    rgb = img.reshape(h, w, n)[:, :, ::-1].astype(np.uint16)
    rgb = rgb * 257 if bits == 16 else rgb
    pack = {1: bytes, 8: zlib.compress, 5: lzw, 32773: packbits}[compress]

    def body(px):
        if predictor == 2:
            px = np.diff(px.astype(np.int64), axis=1, prepend=0) % (1 << bits)
        return pack(px.astype(np.uint8 if bits == 8 else order + "u2").tobytes())

    if tile:
        parts = [body(np.pad(rgb[y : y + tile, x : x + tile], ((0, max(0, y + tile - h)), (0, max(0, x + tile - w)), (0, 0)))) for y in range(0, h, tile) for x in range(0, w, tile)]
    else:
        parts = [body(rgb[y : y + rows]) for y in range(0, h, rows)]
    data, at = b"", 8
    offsets = []
    for p in parts:
        offsets.append(at + len(data))
        data += p
    end = at + len(data)
    offs, sizes = struct.pack(f"{order}{len(parts)}I", *offsets), struct.pack(f"{order}{len(parts)}I", *map(len, parts))
    entries = [(256, 3, [w]), (257, 3, [h]), (258, 3, [bits]), (259, 3, [compress]), (262, 3, [ink if ink is not None else 1 if n == 1 else 2]), (277, 3, [n]), (317, 3, [predictor])]
    entries += [(322, 3, [tile]), (323, 3, [tile])] if tile else [(278, 3, [rows])]
    o, s = (324, 325) if tile else (273, 279)
    out = []
    for t, k, v in entries:
        out.append(struct.pack(order + "HHI", t, k, 1) + struct.pack(order + "HH", v[0], 0))
    where = end
    for t, raw in ((o, offs), (s, sizes)):
        out.append(struct.pack(order + "HHI", t, 4, len(parts)) + (raw if len(raw) == 4 else struct.pack(order + "I", where)))
        where += len(raw)
    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", where)
    return head + data + offs + sizes + struct.pack(order + "H", len(out)) + b"".join(sorted(out, key=lambda e: struct.unpack(order + "H", e[:2])))


def packbits(b):
    out, i = bytearray(), 0
    while i < len(b):
        j = i
        while j < len(b) and b[j] == b[i] and j - i < 128:
            j += 1
        if j - i > 1:
            out += bytes([257 - (j - i), b[i]])
        else:
            out += bytes([0, b[i]])
        i = j
    return bytes(out)


def lzw(b):
    table, bits, width, last = {bytes([i]): i for i in range(256)}, [], 9, b""
    put = lambda c: bits.append(format(c, f"0{width}b"))
    put(256)
    n = 258
    for i in range(len(b)):
        c = b[i : i + 1]
        if last + c in table:
            last += c
            continue
        put(table[last])
        table[last + c] = n
        n += 1
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
        last = c
        if n >= 4094:
            put(table[last])
            last = b""
            put(256)
            table, n, width = {bytes([i]): i for i in range(256)}, 258, 9
    if last:
        put(table[last])
        n += 1
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
    put(257)
    s = "".join(bits)
    s += "0" * (-len(s) % 8)
    return bytes(int(s[i : i + 8], 2) for i in range(0, len(s), 8))


def test_tiff_round_trips():
    r = np.random.default_rng(12)
    smooth = np.clip(np.cumsum(r.integers(-3, 4, (67, 90)), 1) + 128, 0, 255).astype(np.uint8)
    color = np.stack([smooth, smooth[::-1], r.integers(0, 256, smooth.shape).astype(np.uint8)], -1)
    for img in (smooth, color):
        for how in ({}, {"compress": 5}, {"compress": 8, "predictor": 2}, {"compress": 32773}, {"bits": 16, "order": ">"}, {"bits": 16, "predictor": 2, "compress": 8}, {"tile": 32}, {"tile": 16, "compress": 5, "predictor": 2, "order": ">"}, {"rows": 200}):
            assert (kernels.decode(tiff(img, **how)) == img).all(), how
    assert (kernels.decode(tiff(smooth, ink=0)) == 255 - smooth).all()
    with pytest.raises(ValueError, match="compression"):
        kernels.decode(tiff(smooth).replace(struct.pack("<HHIHH", 259, 3, 1, 1, 0), struct.pack("<HHIHH", 259, 3, 1, 4, 0)))


def jpeg(img, step=1, restart=0, sub=1):
    """A plain encoder: one scale for all coefficients, codes of eight bits for all symbols; colour as luma and two chroma planes, the latter thinned by ``sub``."""
    k, x = np.arange(8)[:, None], np.arange(8)[None]
    basis = np.cos((2 * x + 1) * k * np.pi / 16) / 2
    basis[0] /= np.sqrt(2)
    zig = [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63]
    h, w = img.shape[:2]
    if img.ndim == 2:
        planes = [(img.astype(float), 1)]
    else:
        b, g, r = np.moveaxis(img.astype(float), 2, 0)
        y = 0.114 * b + 0.587 * g + 0.299 * r
        planes = [(y, sub), ((b - y) / 1.772 + 128, 1), ((r - y) / 1.402 + 128, 1)]
    unit = 8 * (sub if img.ndim == 3 else 1)
    H, W = -(-h // unit) * unit, -(-w // unit) * unit
    coded = []
    for p, f in planes:
        p = np.pad(p, ((0, H - h), (0, W - w)), mode="edge")
        if img.ndim == 3 and f == 1 and sub == 2:
            p = p.reshape(H // 2, 2, W // 2, 2).mean((1, 3))
        coded.append((np.rint(np.einsum("ky,rycx,lx->rckl", basis, (p - 128).reshape(p.shape[0] // 8, 8, p.shape[1] // 8, 8), basis) / step).astype(int), f))
    bits, out, last, done = [], b"", [0] * len(planes), 0

    def number(v):
        n = abs(v).bit_length()
        return n, format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""

    def flush():
        s = "".join(bits)
        s += "1" * (-len(s) % 8)
        bits.clear()
        return bytes(int(s[i : i + 8], 2) for i in range(0, len(s), 8)).replace(b"\xff", b"\xff\x00")

    symbols = sorted({0, 0xF0} | {r << 4 | n for r in range(16) for n in range(1, 11)} | set(range(12)))
    code = {s: format(i, "08b") for i, s in enumerate(symbols)}
    for my in range(H // unit):
        for mx in range(W // unit):
            if restart and done and done % restart == 0:
                out += flush() + bytes([0xFF, 0xD0 + (done // restart - 1) % 8])
                last = [0] * len(planes)
            for i, (c, f) in enumerate(coded):
                for y in range(f):
                    for x in range(f):
                        z = c[my * f + y, mx * f + x].ravel()[zig]
                        n, t = number(int(z[0]) - last[i])
                        last[i] = int(z[0])
                        bits.append(code[n] + t)
                        run = 0
                        top = max(np.flatnonzero(z), default=0)
                        for v in z[1 : top + 1]:
                            if not v:
                                run += 1
                                continue
                            while run > 15:
                                bits.append(code[0xF0])
                                run -= 16
                            n, t = number(int(v))
                            bits.append(code[run << 4 | n] + t)
                            run = 0
                        if top < 63:
                            bits.append(code[0])
            done += 1
    out += flush()
    part = lambda k, b: bytes([0xFF, k]) + struct.pack(">H", len(b) + 2) + b
    n = len(planes)
    frame = struct.pack(">BHHB", 8, h, w, n) + b"".join(bytes([i + 1, planes[i][1] << 4 | planes[i][1], 0]) for i in range(n))
    table = bytes(16 * [0])[:7] + bytes([len(symbols)]) + bytes(8) + bytes(symbols)
    scan = bytes([n]) + b"".join(bytes([i + 1, 0]) for i in range(n)) + bytes([0, 63, 0])
    return b"\xff\xd8" + part(0xDB, bytes([0]) + bytes([step] * 64)) + part(0xC0, frame) + part(0xC4, bytes([0]) + table) + part(0xC4, bytes([16]) + table) + (part(0xDD, struct.pack(">H", restart)) if restart else b"") + part(0xDA, scan) + out + b"\xff\xd9"


def test_jpeg_round_trips_within_rounding():
    r = np.random.default_rng(13)
    smooth = np.clip(kernels.gaussian(r.integers(0, 256, (45, 70)), 9), 0, 255).astype(np.uint8)
    for how in ({}, {"restart": 3}, {"step": 2}):
        assert np.abs(kernels.decode(jpeg(smooth, **how)).astype(int) - smooth).max() <= 1 + 2 * how.get("step", 1)
    noise = r.integers(0, 256, (16, 16)).astype(np.uint8)
    assert np.abs(kernels.decode(jpeg(noise)).astype(int) - noise).max() <= 3
    color = np.stack([smooth, smooth[::-1], smooth[:, ::-1]], -1)
    assert np.abs(kernels.decode(jpeg(color)).astype(int) - color).max() <= 5
    assert np.abs(kernels.decode(jpeg(color, sub=2, restart=2)).astype(int) - color).mean() <= 8
    with pytest.raises(ValueError):
        kernels.decode(b"\xff\xd8\xff\xd9")


def test_blur_gradients_and_spectra_equal_plain_loops():
    img = np.random.default_rng(14).integers(0, 256, (19, 23)).astype(np.uint8)
    p = np.pad(img.astype(int), 2, mode="reflect")
    k = np.array([1, 4, 6, 4, 1])
    want = np.array([[(int((p[y : y + 5, x : x + 5] * np.outer(k, k)).sum()) + 128) // 256 for x in range(23)] for y in range(19)])
    assert (kernels.softened(img) == want).all()
    p = np.pad(img.astype(int), 1, mode="reflect")
    sx = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]])
    dx, dy = kernels.sobel(img)
    assert all(dx[y, x] == (p[y : y + 3, x : x + 3] * sx).sum() and dy[y, x] == (p[y : y + 3, x : x + 3] * sx.T).sum() for y in range(19) for x in range(23))
    g = (img - img.mean()) * np.outer(np.hanning(19), np.hanning(23))
    power = np.abs(np.fft.fftshift(np.fft.fft2(g))) ** 2
    yy, xx = np.mgrid[:19, :23]
    far = np.hypot(yy - 9, xx - 11) >= 0.25 * 9
    assert kernels.high_frequency_ratio(img) == pytest.approx(power[far].sum() / power.sum(), rel=1e-4)
    wide = np.pad(img, 2, mode="edge")
    assert (kernels._extreme(img, np.maximum) == np.lib.stride_tricks.sliding_window_view(wide, (5, 5)).max((2, 3))).all()
    ring, angle = np.hypot(yy - 9, xx - 11), np.arctan2(yy - 9, xx - 11)
    on = (ring >= 3) & (ring <= 7)
    assert kernels.orientation(img.astype(float)) == pytest.approx(tuple(abs((power[on] * np.exp(1j * n * angle[on])).sum()) / power[on].sum() for n in (2, 4)), rel=1e-6)
    assert kernels.grey(np.stack([img] * 3, -1)).tolist() == img.tolist()
    mask = np.random.default_rng(15).random((40, 31)) < 0.9
    wide = np.pad(mask, 1)
    cy, cx = np.nonzero(~wide)
    want = np.array([[0 if not mask[y, x] else np.hypot(cy - y - 1, cx - x - 1).min() for x in range(31)] for y in range(40)])
    assert np.allclose(kernels.distance(mask), want)


def test_canny_equals_a_plain_walk():
    r = np.random.default_rng(16)
    for k in range(6):
        img = np.clip(kernels.gaussian(r.integers(0, 256, (24, 30)), 3) * 2 - 128, 0, 255).astype(np.uint8)
        dx, dy = (d.astype(int) for d in kernels.sobel(img, "edge"))
        m = np.pad(np.abs(dx) + np.abs(dy), 1)
        top = np.zeros(img.shape, bool)
        for y in range(24):
            for x in range(30):
                v, ax, ay = m[y + 1, x + 1], abs(dx[y, x]), abs(dy[y, x])
                if v <= 50:
                    continue
                if ay < ax * np.tan(np.pi / 8):
                    top[y, x] = v > m[y + 1, x] and v >= m[y + 1, x + 2]
                elif ay > ax * np.tan(3 * np.pi / 8):
                    top[y, x] = v > m[y, x + 1] and v >= m[y + 2, x + 1]
                else:
                    s = -1 if (dx[y, x] < 0) != (dy[y, x] < 0) else 1
                    top[y, x] = v > m[y, x + 1 - s] and v > m[y + 2, x + 1 + s]
        on = top & (m[1:-1, 1:-1] > 150)
        while True:
            more = top & kernels.dilate(on)
            if (more == on).all():
                break
            on = more
        assert (kernels.canny(img) == on).all(), k


def test_cells_keep_failures_as_rows(spark):
    m = np.zeros((60, 60), np.uint8)
    m[8:50, 8:50] = 200
    m[20:36, 20:36] = 0
    df = spark.createDataFrame([("good", bytearray(png(m, [0]))), ("bad", bytearray(b"xx")), ("none", None), ("flat", bytearray(png(m * 0, [0])))], "name string, content binary")
    rows = images.cells(df, least=20).collect()
    assert sorted((r.name, r.cell, r.error is None) for r in rows) == [("bad", None, False), ("good", 1, True), ("none", None, False)]
    assert images.cells(df, kernel=kernels.parts).where("error is not null").count() == 2


def test_halo_and_line():
    halo = kernels.halo_signals(disc(size=200, y=100, x=100, r=25, low=10))
    assert halo["contrast_ratio"] >= 3 and halo["anisotropy"] <= 0.35 and halo["solidity"] > 0.9
    line = np.full((200, 200), 5, np.uint8)
    line[95:105] = 255
    assert kernels.halo_signals(line)["anisotropy"] > 0.35
    assert kernels.halo_signals(np.full((50, 50), 40, np.uint8))["contrast_ratio"] == pytest.approx(1.0)


def test_masks_cells_and_crops():
    m = np.zeros((40, 40), bool)
    m[5:25, 5:25] = True
    m[30, 30] = True
    assert (kernels.clean(m) == (m & (np.arange(40) < 26)[:, None])).all()
    d = kernels.distance(m)
    assert d[5, 5] == 1 and d[14, 14] == 10 and d[0, 0] == 0
    yy, xx = np.nonzero(~np.pad(m, 1))
    assert d[15, 9] == np.hypot(yy - 16, xx - 10).min()
    dent = m.copy()
    dent[30, 30] = False
    dent[5:15, 12:18] = False
    assert len(kernels.convexity_depths(dent)) == 1 and 9 <= kernels.convexity_depths(dent)[0] <= 11
    img = np.zeros((90, 90))
    y, x = np.mgrid[:90, :90]
    for cx in (25, 44, 63):
        img[(y - 45) ** 2 + (x - cx) ** 2 <= 100] = 200
    got = kernels.cell_signals(img.astype(np.uint8))
    assert got["n_cells"] == 3 and got["n_inline"] == 1 and got["rouleaux_fraction"] == pytest.approx(1 / 3)
    assert kernels.cell_signals(np.zeros((30, 30), np.uint8))["n_cells"] == 0
    assert [n for n, _ in kernels.corner_crops(disc(), (0.5, 0.5))] == ["whole", "tl", "tr", "bl", "br"]
    assert set(kernels.four_step(disc())) == set(kernels.FOUR_STEP) and kernels.shrunken_lbp_entropy(disc()) >= 0


def test_signals_keep_failures_as_rows(spark):
    df = spark.createDataFrame([("good", bytearray(png(disc(40, 20, 20, 6), [0]))), ("bad", bytearray(b"xx")), ("none", None)], "name string, content binary")
    rows = {r.name: r for r in images.halo_signals(df).collect()}
    assert rows["good"].error is None and rows["good"].contrast_ratio > 1
    assert rows["bad"].error and rows["bad"].contrast_ratio is None and rows["none"].error


def test_relational_pixels_equal_kernels(spark):
    img = np.random.default_rng(4).integers(0, 256, (8, 8)).astype(np.uint8)
    px = spark.createDataFrame([(1, y, x, int(img[y, x])) for y in range(8) for x in range(8)], "t int, y int, x int, v int")
    o = pixels.otsu(px, "t").head()
    assert (o.threshold, o.coverage) == (kernels.otsu_level(img), float((img > kernels.otsu_level(img)).mean()))
    assert o.eta == pytest.approx(kernels.separability(img, 0))
    wide = np.random.default_rng(5).integers(0, 256, (5, 9)).astype(np.uint8)
    for x in (img, wide):
        grid, v = spark.createDataFrame([(x.ravel().tolist(),)], "vs array<int>"), F.col("vs")
        row = grid.select(pixels.glcm_contrast(v, *x.shape), pixels.laplacian_variance(v, *x.shape), pixels.tenengrad(v, *x.shape)).head()
        assert tuple(row) == pytest.approx((kernels.glcm_contrast(x), kernels.laplacian_variance(x), kernels.tenengrad(x)))
        pairs = grid.select(F.explode(pixels.touching(F.transform(v, lambda x: F.when(x > 90, F.floor(x / 40).cast("int"))), *x.shape)).alias("p")).select("p.*").collect()
        keys = np.where(x > 90, x // 40, 0).astype(int)
        assert sorted(map(tuple, pairs)) == kernels.touching(keys)
    cells = kernels.tiles(img, 3, np.mean)
    t = pixels.tile_spread(px, "t").head()
    assert (t.cv, t.patchiness) == pytest.approx((kernels.variation(cells), kernels.patchiness(cells)))


def test_calibration_recovers_weights(spark):
    r = np.random.default_rng(5)
    x = r.random((600, 3))
    y = np.clip(np.floor(5 * (0.7 * x[:, 0] + 0.3 * x[:, 1])), 0, 4).astype(int)
    rows = spark.createDataFrame([(i, *map(float, v), int(l)) for i, (v, l) in enumerate(zip(np.c_[x[:, :2], 1 - x[:, 0]], y, strict=True))], "k int, a double, b double, c double, level int")
    m = models.fit_axis(rows, ["a", "b", "c"], "level", scoring.DENSITY_LEVELS)
    assert m.dropped == ["c"] and m.weights["a"] == pytest.approx(0.7, abs=0.05) and m.thresholds == sorted(m.thresholds)
    again = models.AxisModel.from_json(m.to_json())
    assert again == m and models.AxisModel.from_json(json.dumps({k: v for k, v in json.loads(m.to_json()).items() if "lbp" not in k})).lbp_step == 1
    out = models.cross_validate(models.hashed_folds(rows, ["k"], "level", 3, 1), ["a", "b"], "level", scoring.DENSITY_LEVELS, range(3))
    assert out.count() == 600 and out.where("abs(predicted - level) <= 1").count() > 570
    ci = models.bootstrap_medians(rows, "a", "level", 50).collect()
    assert all(c.low <= c.high for c in ci)
    assert models.ridge(np.array([[4.0, 2.0], [2.0, 3.0]]), np.array([1.0, 2.0]), 0.0) == pytest.approx(np.linalg.solve([[4, 2], [2, 3]], [1, 2])[1:])


def test_scoring_model_goes_through_its_file(spark):
    axis = lambda top: models.AxisModel({"a": 1.0}, {"a": (0.0, top), "otsu_separability": (0.2, 1.0)}, [0.5], ["low", "high"])
    density = axis(1.0)
    assert not models.derive_gate(density).enabled and models.derive_gate(density).floors == {"otsu_separability": 0.2}
    whole = models.AxisModel({}, {n: (k / 10, 1.0) for k, n in enumerate(models.EMPTY_FIELD_FEATURES, 1)}, [], ["x"])
    assert models.derive_gate(whole).enabled and models.derive_gate(whole).floors["edge_density_unmasked"] == 0.4
    model = models.ScoringModel(density, axis(2.0), models.Gate(True, {"otsu_separability": 0.2}), lift_overlap=models.Override(True, "saturation_score", 0.9))
    again = models.ScoringModel.from_json(model.to_json())
    assert again == model and again.ranges()["a"] == (0.0, 2.0)
    rows = spark.createDataFrame([(0.6, 0.5, 0.1), (0.6, 0.1, 0.1), (0.6, 0.5, 0.95)], "a double, otsu_separability double, saturation_score double")
    got = [r[0] for r in rows.select(model.score({c: F.col(c) for c in rows.columns})).collect()]
    assert [(r.density_label, r.overlap_label, r.overlap_raw_label, r.gated) for r in got] == [("high", "low", "low", False), ("low", "low", "low", True), ("high", "high", "low", False)]
    assert models.drift(None, density)[0] == ("weight", "a", None, 1.0, None)


def test_fetch_tries_again(spark, tmp_path):
    calls, waits = [], []

    def shaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise TimeoutError("again")
        return x * 2

    assert fetch.retrying(shaky, 4, sleep=waits.append) == 8 and len(waits) == 2 and 1 <= waits[0] < 1.5 and 2 <= waits[1] < 2.5
    with pytest.raises(PermissionError):
        fetch.retrying(lambda: (_ for _ in ()).throw(PermissionError()), sleep=waits.append)
    with pytest.raises(FileNotFoundError):
        fetch.retrying(lambda: (_ for _ in ()).throw(FileNotFoundError()), attempts=2, sleep=waits.append)
    assert len(waits) == 3
    (tmp_path / "a").write_bytes(b"abc")
    rows = spark.createDataFrame([(1, str(tmp_path / "a")), (2, str(tmp_path / "no"))], "k int, path string")
    got = {r.k: (r.content and bytes(r.content), r.error is None) for r in fetch.fetch(rows, attempts=2, delay=0.01).collect()}
    assert got == {1: b"abc", 2: None} or got == {1: (b"abc", True), 2: (None, False)}


def test_monotone_fit():
    assert models.monotone([1, 3, 2, 4], [1, 1, 3, 1]).tolist() == [1, 2.25, 2.25, 4]
    assert models.monotone([3, 2, 1], [1, 1, 1]).tolist() == [2, 2, 2]
    assert models.binomial_tail(2, 3) == 0.5 and models.binomial_tail(0, 0) is None


def test_names_and_places(spark):
    row = spark.range(1).select(
        text.uri_parts(F.lit("gs://b/x/y.tar.gz")).alias("u"), text.uri_parts(F.lit("/a/b")).alias("l"), text.clean(F.lit(" a b ")).alias("c"),
        text.channel_blob(F.lit("box1"), F.lit("S"), F.lit(7), "dpc").alias("n"), text.blob_class(F.lit("dpc-012-x.png")).alias("k"), text.blob_number(F.lit("dpc-012-x.png")).alias("i"), text.raster(F.lit(19), F.lit(18), F.lit(20)).alias("r"),
    ).head()
    assert (row.u.bucket, row.u.blob, row.u.name, row.u.stem, row.u.suffix) == ("b", "x/y.tar.gz", "y.tar.gz", "y.tar", ".gz")
    assert (row.l.bucket, row.l.name, row.l.stem, row.l.suffix) == (None, "b", "b", "")
    assert (row.c, row.n, row.k, row.i) == ("a b", "box1/S/dpc-007-S.png", "dpc", 12)
    assert tuple(row.r) == (0, 18)


def test_sources(spark, tmp_path):
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "b.PNG").write_bytes(png(disc(20, 10, 10, 4), [0]))
    (tmp_path / "img" / "a.txt").write_text("x")
    assert [r.name for r in files.image_list(spark, str(tmp_path / "img")).collect()] == ["b.PNG"]
    (tmp_path / "Scan.txt").write_text("[head]\nRowCount=18\nColumnCount = 20\n\nImageIndexWidth=3\n")
    assert files.scan_metadata(spark, str(tmp_path / "Scan.txt")).head()["values"] == {"RowCount": "18", "ColumnCount": "20", "ImageIndexWidth": "3"}
    (tmp_path / "spots.csv").write_text("sample_id,fov_id,x,y,log_radius,score,positive\ns,1,0,0,1,1,1\ns,1,0,0,1,1,0\ns,2,0,0,1,1,1\n")
    assert {(r.fov_id, r.n_detected) for r in files.spot_counts(spark, str(tmp_path / "spots.csv")).collect()} == {(1, 2), (2, 1)}
    (tmp_path / "c.csv").write_text("# a remark\nslide,fov\nx,1\n")
    assert files.commented_csv(spark, str(tmp_path / "c.csv"), "slide string, fov int").collect() == [("x", 1)]
    (tmp_path / "i.json").write_text(json.dumps({"slides": {"S1": {"box": "b", "dpc_fov_ids": [1, 2]}}}))
    assert files.slide_index(spark, str(tmp_path / "i.json")).head()[:3] == ("S1", "b", [1, 2])
    blobs = spark.createDataFrame([("S", "dpc-001-S.png"), ("S", "fluorescent-002-S.png"), ("S", "seg/x.png"), ("S", "notes.txt")], "slide_id string, name string")
    got = files.classify(blobs).head()
    assert (got.n_dpc, got.n_fluorescent, got.n_nested, got.n_other, len(got.dpc_missing)) == (1, 1, 1, 1, 323)
    samples = spark.createDataFrame([("LB-1-20240101-120000-7",), ("LB-1-20240101-120000-8",), ("LB-1-20240101-120000-9",)], "sample_id string")
    folders = spark.createDataFrame([("x20240101-120000-7_Blue",), ("x20240101-120000-9_Blue",), ("y20240101-120000-9_Blue",), ("x20240101-120000-8_Red",)], "folder string")
    assert {r.sample_id[-1]: r.problem for r in files.resolve_folder(samples, folders).collect()} == {"7": None, "8": "not found", "9": "ambiguous"}
    merged = files.merge_labels([("a", spark.createDataFrame([("f", " ")], "k string, overlap string")), ("b", spark.createDataFrame([("g",)], "k string"))], {"overlap": "no rouleaux"})
    assert [r.overlap for r in merged.collect()] == ["no rouleaux"] * 2


def test_workbook(spark, tmp_path):
    m, r = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{m}" xmlns:r="{r}"><sheets><sheet name="Slides" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{m}"><si><t>Slide</t></si><si><r><t>S</t></r><r><t>1</t></r><rPh><t>no</t></rPh></si><si><t> Annotatable ⚠</t></si></sst>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{m}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="C2" t="s"><v>2</v></c></row><row r="3"><c r="A3" t="s"><v>1</v></c><c r="C3"><v>5</v></c></row></sheetData></worksheet>')
    (tmp_path / "w.xlsx").write_bytes(out.getvalue())
    rows = files.workbook(spark, str(tmp_path / "w.xlsx"), "Slides", "Slide", {"A": "slide_id", "C": "quality"})
    assert [tuple(x) for x in rows.collect()] == [(2, "S1", " Annotatable ⚠"), (3, "S1", "5")]
    got = files.catalog(rows).collect()
    assert len(got) == 1 and got[0].warned and got[0]["rank"] == 4


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, i, "boom" if i < 5 else "") for i in range(10)] + [(2, i, " " if i else "boom") for i in range(10)], "slide_id int, fov_id int, error string")
    done, failed = sinks.split_failed(rows)
    assert [r.slide_id for r in failed.collect()] == [1] and done.count() == 10
    path = str(tmp_path / "out")
    sinks.write_slides(done, path)
    sinks.write_slides(rows.where("slide_id = 1"), path)
    assert spark.read.parquet(path).count() == 20
    want = spark.createDataFrame([(1, 10), (2, 9), (3, 1)], "slide_id int, n_expected long")
    assert sorted(r.slide_id for r in sinks.unfinished(want, spark.read.parquet(path)).collect()) == [2, 3]
    assert sinks.mirror(want, str(tmp_path / "a"), str(tmp_path / "b")) is None and sinks.mirror(want, str(tmp_path / "a"), "nowhere://x")
    assert sinks.markdown(want.orderBy("slide_id").limit(1), "T") == "## T\n\n| slide_id | n_expected |\n| - | - |\n| 1 | 10 |\n"
    sinks.append_log(want, str(tmp_path / "log"))
    sinks.append_log(want, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 6


def test_resumable_pass_and_neighbours(spark, tmp_path):
    src, schema = str(tmp_path / "src"), "slide_id long, fov_id long, value double"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    put([(1, 1, 5.0), (1, 2, 6.0), (2, 1, 1.0)])
    go = lambda: passes.resumable(spark, src, schema, lambda s: s.withColumn("twice", F.col("value") * 2), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert go() == 3 and go() == 0
    q = passes.stateful_neighbours(spark.readStream.schema(schema).parquet(src)).writeStream.format("memory").queryName("near").option("checkpointLocation", str(tmp_path / "cp2")).outputMode("append").start()
    q.processAllAvailable()
    put([(1, 5, 9.0), (1, 7, 4.0)])
    q.processAllAvailable()
    q.stop()
    assert go() == 2
    got = {(r.slide_id, r.fov_id): (r.before, r.rise) for r in spark.table("near").collect()}
    assert got == {(1, 1): ("", 0.0), (1, 2): ("1", 1.0), (2, 1): ("", 0.0), (1, 5): ("1,2", 3.0), (1, 7): ("2,5", -5.0)}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_nothing_outside_names_the_text_package():
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    for p in (root / "tilewright").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"import.*\bllm\b|from.*\bllm\b", p.read_text()), p


def test_published_scores_are_reproduced(spark):
    """Eight fields with published scores, labels and gates, scored again from their features and the model."""
    from pathlib import Path

    g = json.loads((Path(__file__).parent / "fixtures" / "scored_fields.json").read_text())
    cols = [*g["features"], "want_density", "want_overlap", "density_label", "overlap_label", "raw_label", "want_gated"]
    rows = spark.createDataFrame(g["rows"], ", ".join(f"{c} {'boolean' if c == 'want_gated' else 'string' if c.endswith('label') else 'double'}" for c in cols))
    f = {n: F.col(n) for n in g["features"]}
    gated = scoring.gate_fired(f, g["floors"])
    for axis, bottom in (("density", scoring.DENSITY_LEVELS[0]), ("overlap", scoring.OVERLAP_LEVELS[0])):
        m = models.AxisModel.from_json(json.dumps({**g["axes"][axis], "dropped": [], "lbp_step": 16, "blur_downsample": 4}))
        assert m.labels == list(scoring.DENSITY_LEVELS if axis == "density" else scoring.OVERLAP_LEVELS)
        score = m.score(f)
        raw = m.label(score)
        got = rows.select(F.abs(score - F.col(f"want_{axis}")).alias("d"), (scoring.override(raw, F.lit(0.0), None, "", gated, bottom) == F.col(f"{axis}_label")).alias("same"), (gated == F.col("want_gated")).alias("gate"), raw.alias("raw"), "raw_label").collect()
        assert len(got) == 8 and all(r.d < 1e-12 and r.same and r.gate for r in got)
        assert axis == "overlap" or all(r.raw == r.raw_label for r in got)
    assert sum(r[-1] for r in g["rows"]) > 0
