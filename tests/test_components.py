"""Components of cut masks against a flood fill of the uncut ones: noise, a spiral over all tiles, combs, gaps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import components


def flood(mask):
    """{(y, x of the first pixel): (area, top, left, bottom, right)}"""
    seen, out = set(), {}
    for y, x in zip(*np.nonzero(mask), strict=True):
        if (y, x) in seen:
            continue
        todo, own = [(y, x)], []
        seen.add((y, x))
        while todo:
            a, b = todo.pop()
            own.append((a, b))
            for p in [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                if 0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1] and mask[p] and p not in seen:
                    seen.add(p)
                    todo.append(p)
        ys, xs = zip(*own, strict=True)
        out[min(own)] = (len(own), min(ys), min(xs), max(ys), max(xs))
    return {tuple(map(int, k)): tuple(map(int, v)) for k, v in out.items()}


def spiral(n):
    m, y, x, dy, dx = np.zeros((n, n), bool), 0, 0, 0, 1
    for _ in range(n * n):
        m[y, x] = True
        ahead = lambda k: (y + k * dy, x + k * dx)
        inside = lambda p: 0 <= p[0] < n and 0 <= p[1] < n
        if not inside(ahead(1)) or inside(ahead(2)) and m[ahead(2)]:
            dy, dx = dx, -dy
            if m[ahead(1)] or inside(ahead(2)) and m[ahead(2)]:
                break
        y, x = ahead(1)
    return m


def comb(n):
    m = np.zeros((n, n), bool)
    m[:, ::2] = True
    m[-1] = True
    return m


def got(spark, masks, height, width, drop=()):
    rows = [(s, ty, tx, m[ty * height : (ty + 1) * height, tx * width : (tx + 1) * width].ravel().tolist()) for s, m in masks.items() for ty in range(m.shape[0] // height) for tx in range(m.shape[1] // width) if (ty, tx) not in drop]
    df = spark.createDataFrame(rows, "scan string, ty int, tx int, m array<boolean>").repartition(3)
    return {(r.scan, r.y, r.x): tuple(r)[3:] for r in components.regions(df, ["scan"], F.col("m"), height, width).collect()}


@pytest.mark.parametrize(("height", "width"), [(4, 6), (8, 3), (24, 24)])
def test_cut_masks_have_the_components_of_uncut_ones(spark, height, width):
    r = np.random.default_rng(1)
    masks = {"sparse": r.random((24, 24)) < 0.25, "dense": r.random((24, 48)) < 0.45, "spiral": spiral(24), "comb": comb(24), "none": np.zeros((24, 24), bool), None: np.ones((24, 24), bool)}
    want = {(s, *k): v for s, m in masks.items() for k, v in flood(m).items()}
    assert len([k for k in want if k[0] == "spiral"]) == len([k for k in want if k[0] == "comb"]) == 1
    assert got(spark, masks, height, width) == want


def test_missing_tiles_are_not_set(spark):
    m = np.ones((12, 12), bool)
    gone = m.copy()
    gone[4:8, :] = False
    assert got(spark, {"a": m}, 4, 4, {(1, 0), (1, 1), (1, 2)}) == {("a", *k): v for k, v in flood(gone).items()}


def test_a_long_path_takes_few_rounds(spark, monkeypatch):
    rounds = []
    kept = components.written
    monkeypatch.setattr(components, "written", lambda rows, tag="ordered": (rounds.append(tag), kept(rows, tag))[1])
    n = 600
    order = np.random.default_rng(2).permutation(n).tolist()
    edges = spark.createDataFrame(list(zip(order, order[1:], strict=False)), "src int, dst int")
    roots = {r.node: r.root for r in components.contracted(edges).collect()}
    assert roots == {k: 0 for k in range(1, n)}
    assert len(rounds) < 30
