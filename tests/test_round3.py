"""Work whose cost once grew faster than its input, or whose results differed on odd tables."""

import hashlib
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest

from tilewright.kernels import contours, images
from tilewright.operators import images as tables
from tilewright.operators import models, mosaic, quantiles, relational, resampling
from tilewright.plans import image_queries
from tilewright.sources import sinks
from tilewright.streaming import neighbours


def no_call(*args, **kwargs):
    raise AssertionError("rows are repeated for replicates")


def test_bootstrap_adds_up_blocks_and_repeats_no_row(spark, monkeypatch):
    monkeypatch.setattr(resampling, "weighted", no_call)
    monkeypatch.setattr(quantiles, "exact", no_call)
    r = np.random.default_rng(5)
    rows = [(i, None if i % 3 == 0 else f"l{i % 3}", None if i % 17 == 0 else float(r.integers(0, 30))) for i in range(400)] + [(900, "one", 4.0)]
    df = spark.createDataFrame(rows, "k int, level string, s double").repartition(5)
    got = {t.level: (t.low, t.high) for t in resampling.bootstrap_medians(df, "s", "level", ["k"], 20, 5, 8).collect()}
    cuts = np.array(resampling.CUTS)
    for level in (None, "l1", "l2", "one"):
        meds = []
        for b in range(20):
            u = lambda k: int(hashlib.md5(f"{k}/{b // 8}/5".encode()).hexdigest()[4 * (b % 8) : 4 * (b % 8) + 4], 16)  # noqa: B023, E731
            drawn = [s for k, lv, s in rows if lv == level and s is not None for _ in range((cuts <= u(k)).sum())]
            if drawn:
                meds.append(np.median(drawn))
        assert got[level] == pytest.approx((np.quantile(meds, 0.05), np.quantile(meds, 0.95)))


def test_hashed_bootstrap_broadcasts_no_draws(spark, monkeypatch):
    seen = []
    kept = resampling.weighted_medians
    monkeypatch.setattr(resampling, "weighted_medians", lambda rows, *a, **k: seen.append(rows) or kept(rows, *a, **k))
    r = np.random.default_rng(6)
    rows = [(i, i % 2, float(r.integers(0, 50))) for i in range(5_000)]
    got = {t.level: (t.low, t.high) for t in models.hashed_bootstrap_medians(spark.createDataFrame(rows, "k int, level int, s double"), "s", "level", ["k"], 4, 3).collect()}
    assert "BroadcastExchange" not in seen[0]._jdf.queryExecution().executedPlan().toString()
    for level in (0, 1):
        own = [s for _, lv, s in rows if lv == level]
        meds = [np.median([own[int(hashlib.md5(f"{b}/{j}/3".encode()).hexdigest()[:12], 16) % len(own)] for j in range(len(own))]) for b in range(4)]
        assert got[level] == pytest.approx((np.quantile(meds, 0.05), np.quantile(meds, 0.95)))


@pytest.mark.parametrize("most", [100, 0])
def test_pieces_of_names_are_never_broadcast(spark, monkeypatch, most):
    monkeypatch.setattr(relational, "MOST_NEEDLES", most)
    rows = [(i, f"name {i} of all") for i in range(300)]
    got = relational.containing(spark.createDataFrame(rows, "k int, name string"), "name", spark.createDataFrame([(str(i),) for i in range(20)], "needle string"), "needle")
    plan = got._jdf.queryExecution().executedPlan().toString()
    sent = plan[plan.index("BroadcastExchange") :] if "BroadcastExchange" in plan else ""
    assert "Generate" not in sent and bool(sent) == (most > 0)
    assert got.count() == sum(str(n) in name for n in range(20) for _, name in rows)


def test_a_scan_without_all_tiles_of_its_last_row_has_zeros_there(spark):
    r = np.random.default_rng(8)
    scan = r.integers(1, 256, (9, 12))
    gone = {(1, 2), (2, 1), (2, 3)}
    tiles = [("s", y, x, scan[3 * y : 3 * y + 3, 3 * x : 3 * x + 3].ravel().tolist()) for y in range(3) for x in range(4) if (y, x) not in gone]
    for y, x in gone:
        scan[3 * y : 3 * y + 3, 3 * x : 3 * x + 3] = 0
    wide = np.pad(scan, 1, mode="reflect")
    got = mosaic.padded(spark.createDataFrame(tiles, "scan string, ty int, tx int, vs array<int>"), ["scan"], "vs", 3, 3, 1, across=4).collect()
    assert len(got) == 9
    for t in got:
        assert t.padded == wide[3 * t.ty : 3 * t.ty + 5, 3 * t.tx : 3 * t.tx + 5].ravel().tolist()


def test_values_are_made_once_for_all_passes(spark):
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = spark.range(3_000).selectExpr("id % 2 as g", "cast(id * 7919 % 3001 as double) as v").mapInArrow(run, "g long, v double")
    got = {r.g: r.m for r in quantiles.exact(rows, ["g"], "v", {"m": quantiles.share(0.5)}, 50, 8).collect()}
    want = {g: np.median([k * 7919 % 3001 for k in range(3_000) if k % 2 == g]) for g in (0, 1)}
    assert got == want and made.value == 3_000


def test_groups_fitted_together_are_those_fitted_alone(spark):
    r = np.random.default_rng(4)
    rows = [(i % 3, float(a), float(b), int(2 * a + b)) for i, (a, b) in enumerate(r.random((300, 2)))]
    df = spark.createDataFrame(rows, "part int, a double, b double, level int")
    got = models.fit_weights_by(df, ("a", "b"), "level", "part")
    for part in range(3):
        weights, lims, _ = models.fit_weights(df.where(f"part = {part}"), ("a", "b"), "level")
        assert got[part][0] == pytest.approx(weights) and got[part][1] == {**got[part][1], **lims}


def test_shares_of_replicates_equal_windows_and_joins(spark, monkeypatch):
    r = np.random.default_rng(7)
    df = spark.createDataFrame([(i, *map(float, r.integers(0, 12, 3))) for i in range(60)], "k int, y double, m double, p double")
    ask = lambda: ([tuple(t) for t in resampling.paired_bootstrap(df, ["k"], ["m", "p"], "y", "m", 50, 9).orderBy("statistic").collect()], tuple(resampling.permutation_p(df, ["k"], ["m", "p"], "y", 50, 4).head()))
    monkeypatch.setattr(resampling, "MOST_HELD", 0)
    windows, joins = ask()
    monkeypatch.undo()
    monkeypatch.setattr(resampling, "_rank", no_call)
    monkeypatch.setattr(resampling, "weighted", no_call)
    held, given = ask()
    assert [t[0] for t in held] == [t[0] for t in windows] and given == pytest.approx(joins)
    for a, b in zip(held, windows, strict=True):
        assert a[1:] == pytest.approx(b[1:], abs=1e-9)


def test_state_is_read_and_written_once_for_a_bucket_and_batch():
    calls = []

    class State:
        def __init__(self):
            self.rows = None

        def exists(self):
            calls.append("exists")
            return self.rows is not None

        def get(self):
            calls.append("get")
            return self.rows

        def update(self, rows):
            calls.append("update")
            self.rows = rows

    class Handle:
        def getValueState(self, name, schema):
            return State()

        def registerTimer(self, at):
            calls.append(at)

    n = neighbours.Neighbours()
    n.init(Handle())
    rows = [(s, k, 1_000 * k, float(k)) for k in range(100) for s in (1, 2)]
    n.handleInputRows(("b",), iter([pd.DataFrame(rows, columns=["slide_id", "fov_id", "us", "value"])]), None)
    assert calls == ["exists", "update", 0]
    out = next(n.handleExpiredTimer(("b",), SimpleNamespace(getCurrentWatermarkInMs=lambda: 49), SimpleNamespace(getExpiryTimeInMs=lambda: 0)))
    assert len(out) == 100 and out["before"].tolist()[:3] == ["", "0", "0,1"] and calls[-1] == 50 and len(calls) < 12


@pytest.mark.parametrize("form", ["parquet", "csv"])
def test_folders_do_not_grow_with_the_slides(spark, tmp_path, monkeypatch, form):
    monkeypatch.setattr(sinks, "PARTS", 4)
    path, schema = str(tmp_path / "out"), "slide_id long, fov_id int, note string"
    rows = [(s, f, [None, "x", 'a "b",\nc'][f]) for s in [*range(30), None] for f in range(3)]
    sinks.write_slides(spark.createDataFrame(rows, schema), path, form=form)
    again = [(s, 7, "new") for s in (2, 3, None, 99)]
    sinks.write_slides(spark.createDataFrame(again, schema), path, form=form)
    folders = [f.name for f in (tmp_path / "out").iterdir() if f.is_dir()]
    assert 0 < len(folders) <= 4
    reader = spark.read.schema(f"{schema}, slide_part int").options(**({"header": "true", "multiLine": "true"} if form == "csv" else {}))
    got = reader.format(form).load(path).select("slide_id", "fov_id", "note").collect()
    assert sorted(map(tuple, got), key=str) == sorted([r for r in rows if r[0] not in (2, 3, None)] + again, key=str)


@pytest.mark.parametrize("shape", [(64, 64), (50, 71), (7, 9), (5, 3), (1, 1)])
def test_contrasts_of_tiles_from_running_sums(shape):
    g = np.random.default_rng(9).integers(0, 32, shape).astype(np.uint8)
    assert (images.tile_contrasts(g, 7) == images.tiles(g, 7, images.glcm_contrast)).all()


def test_cells_of_a_tile_are_cut_out_once(spark, monkeypatch):
    made, grid = spark.sparkContext.accumulator(0), image_queries._grid

    def decode(raw):
        made.add(1)
        return grid(raw)

    monkeypatch.setattr(image_queries, "_grid", decode)
    got = {r.vec_id: tuple(r)[1:] for r in image_queries.cell_metrics(spark, "/root/testdata/sf0.001").collect()}
    assert made.value == image_queries.tile_bytes(spark, "/root/testdata/sf0.001").count()
    for r in image_queries.tile_bytes(spark, "/root/testdata/sf0.001").orderBy("vec_id").limit(40).collect():
        found = images.parts(grid(r.content), 16)
        if not found:
            assert r.vec_id not in got
            continue
        area = np.array([c["area"] for c in found])
        q = np.percentile(area, 75)
        small, large = area < 0.35 * q, area > 1.6 * q
        one = ~small & ~large
        crenated = sum(c["solidity"] < 0.75 for c, own in zip(found, one, strict=True) if own)
        assert got[r.vec_id] == (small.sum(), large.sum(), one.sum(), np.median(area[one]) if one.any() else None, crenated)


@pytest.mark.parametrize("shape", [(64, 64), (90, 47), (12, 70)])
def test_images_side_by_side_are_those_alone(shape):
    r = np.random.default_rng(3)
    stack = []
    for k in range(6):
        x = np.full(shape, 40, np.uint8)
        for cy, cx, size in zip(r.integers(0, shape[0], 9), r.integers(0, shape[1], 9), r.integers(3, 12, 9), strict=True):
            yy, xx = np.ogrid[: shape[0], : shape[1]]
            x[(yy - cy) ** 2 + (xx - cx) ** 2 <= size**2] = r.integers(90, 250)
        stack += [x, np.full(shape, 7 * k, np.uint8)]
    stack = np.stack(stack)
    alone = [images.split_cells(x) for x in stack]
    assert (images.split_stack(stack) == np.stack(alone)).all() and not alone[1].any()
    assert images.parts_of(stack, 5) == [images.parts(x, 5) for x in stack]
    assert images.cell_signals_of(stack) == [images.cell_signals(x) for x in stack]
    assert np.allclose(images.gaussians(stack, 40), [images.gaussian(x, sigma=40) for x in stack], rtol=0, atol=1e-9)
    for label in alone:
        for k in range(1, label.max() + 1):
            y, x = np.nonzero(label == k)
            corners = np.unique(np.concatenate([np.stack([x + i, y + j], 1) for i in (0, 1) for j in (0, 1)]), axis=0)
            assert images.pixel_solidity(y, x) == len(y) / contours.ring_area(contours.hull(corners))


def test_images_side_by_side_fail_alone(spark, monkeypatch):
    monkeypatch.setattr(tables, "ROWS", 3)
    decode = lambda raw: np.frombuffer(raw, np.uint8).reshape(-1, 2)

    def kernel(x, least):
        if x[0, 0] == 9:
            raise ValueError("nine")
        return [{"cell": k, "area": float(x.sum())} for k in range(x[0, 0] % 4)]

    raw = [None if i % 13 == 5 else bytes([i % 11, i] * (1 + i % 17 // 9)) for i in range(60)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "k int, content binary").coalesce(1)
    alone = tables.cells(df, decode=decode, kernel=kernel).collect()
    assert tables.cells(df, decode=decode, kernel=kernel, many=lambda stack, least: [kernel(x, least) for x in stack]).collect() == alone
    assert [(r.k, r.error is None) for r in alone] == [(i, x is not None and x[0] != 9) for i, x in enumerate(raw) for _ in range(1 if x is None or x[0] == 9 else x[0] % 4)]
