"""Cross-validation of all folds at once against fits one by one, and resampling against numpy on the same draws."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tilewright.functions import scoring
from tilewright.operators import models, quantiles, resampling


def plain_fit(x, y, levels):
    """(score of rows, cuts) of one training set; features as columns with nans for what is not there."""
    low, high = np.nanquantile(x, 0.02, axis=0), np.nanquantile(x, 0.98, axis=0)
    high = np.where(high > low, high, low + 1e-6)
    unit = lambda v: np.clip((v - low) / (high - low), 0, 1)
    u = np.c_[np.ones(len(x)), unit(x)]
    keep = list(range(x.shape[1]))
    while keep:
        at = [0, *(k + 1 for k in keep)]
        a = np.array([[np.nansum(u[:, i] * u[:, j]) for j in at] for i in at])
        b = np.array([np.nansum(u[:, i] * y) for i in at])
        w = np.linalg.solve(a + np.diag([0.0] + [10.0] * len(keep)), b)[1:]
        if (w >= 0).all():
            break
        keep = [k for k, v in zip(keep, w, strict=True) if v >= 0]
    w = w / w.sum()

    def score(v):
        z = unit(v)[:, keep]
        there = ~np.isnan(z)
        share = (there * w).sum(1)
        return np.where(share > 0, np.nansum(z * w, axis=1) / np.where(share > 0, share, 1), 0.0)

    s = score(x)
    have = sorted(set(y.tolist()))
    fit = dict(zip(have, models.monotone([np.median(s[y == k]) for k in have], [(y == k).sum() for k in have]), strict=True))
    full = [fit[max((h for h in have if h <= k), default=have[0])] for k in range(levels)]
    return score, [(a + b) / 2 for a, b in zip(full, full[1:], strict=False)]


@pytest.mark.parametrize("small", [quantiles.SMALL, 40])
def test_all_folds_at_once_are_those_fitted_one_by_one(spark, small, monkeypatch):
    r = np.random.default_rng(3)
    x = r.random((500, 4))
    y = np.clip(np.floor(5 * (0.6 * x[:, 0] + 0.4 * x[:, 1] + 0.1 * r.random(500))), 0, 4)
    x[:, 3] = 1 - x[:, 0] + 0.2 * r.random(500)  # a feature with a negative weight
    x[::11, 1] = np.nan
    names = ["a", "b", "c", "d"]
    rows = [(i, int(y[i]), i % 7, *(None if np.isnan(v) else float(v) for v in x[i])) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, level int, fold int, a double, b double, c double, d double")
    kept = quantiles.exact
    monkeypatch.setattr(quantiles, "exact", lambda *a, **k: kept(*a, **{"small": small, "buckets": 16, **k}))
    got = {t.k: t for t in models.cross_validate(df, names, "level", scoring.DENSITY_LEVELS, range(7)).collect()}
    assert len(got) == 500
    for f in range(7):
        held = np.arange(500) % 7 == f
        score, cuts = plain_fit(x[~held], y[~held].astype(int), 5)
        for k, s in zip(np.flatnonzero(held).tolist(), score(x[held]), strict=True):
            assert got[k].score == pytest.approx(s, abs=1e-9)
            assert got[k].predicted == sum(got[k].score >= t for t in cuts) or min(abs(s - t) for t in cuts) < 1e-9


def drawn(key, b, seed):
    u = int(hashlib.md5(f"{key}/{b // 8}/{seed}".encode()).hexdigest()[4 * (b % 8) : 4 * (b % 8) + 4], 16)
    return sum(u >= c for c in resampling.CUTS)


def test_weights_are_poisson_and_follow_the_digest(spark):
    df = spark.range(300).withColumnRenamed("id", "k")
    rows = resampling.weighted(df, ["k"], 20, 7).collect()
    got = {(r.k, r._b): r._w for r in rows}
    assert got == {(k, b): w for k in range(300) for b in range(20) if (w := drawn(k, b, 7))}
    all_ = np.array([drawn(k, b, 7) for k in range(300) for b in range(200)])
    assert abs(all_.mean() - 1) < 0.02 and abs(all_.var() - 1) < 0.05


@pytest.mark.parametrize("small", [10_000, 25])
def test_bootstrap_of_medians_equals_numpy(spark, small):
    r = np.random.default_rng(1)
    rows = [(i, int(i % 5 == 0), float(r.integers(0, 40))) for i in range(200)]
    got = {t.level: (t.low, t.high) for t in resampling.bootstrap_medians(spark.createDataFrame(rows, "k int, level int, s double"), "s", "level", ["k"], 40, 5, small).collect()}
    for level in (0, 1):
        own = [(k, s) for k, lv, s in rows if lv == level]
        meds = [np.median(np.repeat([s for _, s in own], [drawn(k, b, 5) for k, _ in own])) for b in range(40)]
        assert got[level] == pytest.approx((np.quantile(meds, 0.05), np.quantile(meds, 0.95)))


def rho(x, y, w):
    a, b = (pd.Series(np.repeat(v, w)).rank().to_numpy() for v in (x, y))
    return np.corrcoef(a, b)[0, 1] if a.std() * b.std() > 0 else 0.0


def test_paired_bootstrap_and_permutation_equal_numpy(spark):
    r = np.random.default_rng(2)
    n = 40
    y = r.integers(0, 15, n).astype(float)
    x = {"m": y + r.integers(0, 10, n), "p": r.integers(0, 6, n).astype(float), "q": -y + r.integers(0, 20, n)}
    df = spark.createDataFrame([(i, float(y[i]), *(float(v[i]) for v in x.values())) for i in range(n)] + [(99, None, 1.0, 1.0, 1.0)], "k int, y double, m double, p double, q double")
    got = {t.statistic: t for t in resampling.paired_bootstrap(df, ["k"], list(x), "y", "m", 30, 9).collect()}
    reps = {s: [rho(v, y, [drawn(k, b, 9) for k in range(n)]) for b in range(30)] for s, v in x.items()}
    for s, v in x.items():
        delta = np.abs(reps[s]) - np.abs(reps["m"])
        want = (rho(v, y, [1] * n), *np.quantile(reps[s], (0.05, 0.95)), *np.quantile(delta, (0.05, 0.95)))
        t = got[s]
        assert (t.rho, t.low, t.high, t.delta_low, t.delta_high) == pytest.approx(want, abs=1e-9)
        assert t.differs == (want[3] > 0 or want[4] < 0)
    p = resampling.permutation_p(df, ["k"], list(x), "y", 50, 4).head()
    seen = max(abs(rho(v, y, [1] * n)) for v in x.values())
    top = []
    for b in range(50):
        order = sorted(range(n), key=lambda k: (hashlib.md5(f"{k}/{b}/4".encode()).hexdigest(), k))
        given = np.empty(n)
        given[order] = y
        top.append(max(abs(rho(v, given, [1] * n)) for v in x.values()))
    hits = sum(t >= seen - 1e-12 for t in top)
    assert (p.max_abs_rho, p.hits, p.p) == pytest.approx((seen, hits, (hits + 1) / 51))
    assert df.where(F.col("k") < 0).count() == 0
