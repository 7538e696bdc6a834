"""Calibration: ridge weights from aggregated products, monotone thresholds, cross-validation, resampling."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scoring
from . import ordered, quantiles, resampling


#: Draws that one row of a plan is spread to.
SLICE = 4_096


@dataclass
class AxisModel:
    """What scoring needs, and the knobs of the features it was fitted on; a knob that is missing is 1."""

    weights: dict[str, float]
    ranges: dict[str, tuple[float, float]]
    thresholds: list[float]
    labels: list[str]
    dropped: list[str] = field(default_factory=list)
    lbp_step: int = 1
    blur_downsample: int = 1

    def score(self, features: Mapping[str, Column]) -> Column:
        return scoring.weighted(features, self.weights, self.ranges)

    def label(self, score: Column) -> Column:
        return scoring.bucket(score, self.thresholds, self.labels)

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=1)

    @classmethod
    def from_json(cls, text: str) -> AxisModel:
        raw = json.loads(text)
        return cls(**raw | {"ranges": {k: tuple(v) for k, v in raw["ranges"].items()}})


# The features that all have to lie below their floors for a field to count as empty.
EMPTY_FIELD_FEATURES = ("otsu_separability", "lbp_entropy", "glcm_contrast", "edge_density_unmasked")


@dataclass
class Gate:
    """The empty-field gate: floors by feature, off where a feature it needs was not fitted."""

    enabled: bool
    floors: dict[str, float]
    rule: str = "all_below"

    def fired(self, features: Mapping[str, Column]) -> Column:
        return scoring.gate_fired({n: features[n] for n in self.floors}, self.floors, self.enabled, self.rule)


def derive_gate(density: AxisModel, needed: Sequence[str] = EMPTY_FIELD_FEATURES) -> Gate:
    """Floors at the lower ends of the density axis' ranges. A gate of fewer features would be another, weaker rule, so with one missing it is off."""
    have = [n for n in needed if n in density.ranges]
    return Gate(len(have) == len(needed), {n: density.ranges[n][0] for n in have})


@dataclass
class Override:
    """Lifts a label to the top where the feature reaches the threshold; off as it ships."""

    enabled: bool = False
    feature: str = "saturation_score"
    threshold: float | None = None


@dataclass
class ScoringModel:
    """Everything that scoring a field needs: both axes, the gate, and an override for each axis."""

    density: AxisModel
    overlap: AxisModel
    gate: Gate
    lift_density: Override = field(default_factory=Override)
    lift_overlap: Override = field(default_factory=Override)

    def ranges(self) -> dict[str, tuple[float, float]]:
        """Range of every feature of either axis; where both have one, that of the overlap axis."""
        return {**self.density.ranges, **self.overlap.ranges}

    def score(self, features: Mapping[str, Column]) -> Column:
        """Struct of both scores, labels after override and gate, raw labels and whether the gate fired."""
        gated, out = self.gate.fired(features), []
        for name, axis, lift in (("density", self.density, self.lift_density), ("overlap", self.overlap, self.lift_overlap)):
            value = axis.score(features)
            raw = axis.label(value)
            cut = lift.threshold if lift.enabled else None
            shown = scoring.override(raw, features.get(lift.feature, F.lit(None).cast("double")), cut, axis.labels[-1], gated, axis.labels[0])
            out += [value.alias(f"{name}_score"), shown.alias(f"{name}_label"), raw.alias(f"{name}_raw_label")]
        return F.struct(*out, gated.alias("gated"))

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=1)

    @classmethod
    def from_json(cls, text: str) -> ScoringModel:
        raw = json.loads(text)
        axis = lambda a: AxisModel.from_json(json.dumps(a))
        lifts = {k: Override(**raw.get(k, {})) for k in ("lift_density", "lift_overlap")}
        return cls(axis(raw["density"]), axis(raw["overlap"]), Gate(**raw["gate"]), **lifts)


def drift(before: AxisModel | None, now: AxisModel) -> list[tuple[str, str, float | None, float | None, float | None]]:
    """(kind, name, before, now, change) of every weight and threshold of a refit; what one side lacks is null."""
    out = []
    for name in dict.fromkeys([*(before.weights if before else {}), *now.weights]):
        a, b = before.weights.get(name) if before else None, now.weights.get(name)
        out.append(("weight", name, a, b, None if a is None or b is None else b - a))
    for k, b in enumerate(now.thresholds):
        a = before.thresholds[k] if before and k < len(before.thresholds) else None
        out.append(("threshold", str(k), a, b, None if a is None else b - a))
    return out


def ranges(rows: DataFrame, names: Sequence[str], low: float = 0.02, high: float = 0.98) -> dict[str, tuple[float, float]]:
    """The two percentiles of each feature, the upper one moved by 1e-6 where they are equal; features without values have none."""
    got = {r["feature"]: (r["low"], r["high"]) for r in ranges_by(rows, names, (), low, high).collect()}
    return {n: got[n] for n in names if n in got}


def ranges_by(rows: DataFrame, names: Sequence[str], by: Sequence[str] = (), low: float = 0.02, high: float = 0.98) -> DataFrame:
    """(by, feature, low, high): the percentiles of each feature in each group, exact at any size, for all features at once."""
    long = rows.select(*by, F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("v")) for n in names))).alias("x")).select(*by, "x.feature", "x.v")
    q = quantiles.exact(long, [*by, "feature"], "v", {"low": quantiles.share(low), "high": quantiles.share(high)})
    return q.select(*by, "feature", "low", F.when(F.col("high") > F.col("low"), F.col("high")).otherwise(F.col("low") + 1e-6).alias("high"))


def _products(columns: Sequence[Column], target: Column) -> list[Column]:
    x = [F.lit(1.0), *columns]
    k = len(x)
    return [F.count(F.lit(1)).alias("n"), *(F.sum(x[i] * x[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)), *(F.sum(x[i] * target).alias(f"b{i}") for i in range(k))]


def _matrices(got: Row, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    a = np.array([[got[f"a{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k + 1)] for i in range(k + 1)], np.float64)
    return a, np.array([got[f"b{i}"] or 0.0 for i in range(k + 1)], np.float64), got["n"]


def gram(rows: DataFrame, columns: Sequence[Column], target: Column) -> tuple[np.ndarray, np.ndarray, int]:
    """(X'X, X'y, n) with a leading column of ones, as one aggregate: no row leaves its task."""
    return _matrices(rows.agg(*_products(columns, target)).head(), len(columns))


def ridge(a: np.ndarray, b: np.ndarray, alpha: float) -> np.ndarray:
    """Coefficients without the intercept, which is not penalised."""
    penalty = np.diag([0.0] + [alpha] * (len(b) - 1))
    return np.linalg.solve(a + penalty, b)[1:]


def fit_weights(rows: DataFrame, names: Sequence[str], target: str, alpha: float = 10.0) -> tuple[dict[str, float], dict[str, tuple[float, float]], list[str]]:
    """Weights whose sizes add up to one, with negative ones left out and the rest fitted again; ranges; what was left out.

    Dropping a feature drops a row and a column of the products, so the table is read twice, whatever is dropped.
    """
    lims = ranges(rows, names)
    names = [n for n in names if n in lims]
    a, b, _ = gram(rows, [scoring.unit_range(F.col(n), *lims[n]) for n in names], F.col(target).cast("double"))
    shares = shares_of(a, b, names, alpha)
    return shares, {n: lims[n] for n in shares}, [n for n in names if n not in shares]


def fit_weights_by(rows: DataFrame, names: Sequence[str], target: str, by: str, alpha: float = 10.0) -> dict[object, tuple[dict[str, float], dict[str, tuple[float, float]]]]:
    """(weights, ranges of all features with values) of each group: all groups are fitted in the same passes. Groups are few, as their figures reach the driver."""
    rows = ordered.written(rows.select(by, target, *names), "fitted")
    lims: dict = {}
    for r in ranges_by(rows, names, [by]).collect():
        lims.setdefault(r[by], {})[r["feature"]] = (r["low"], r["high"])
    ends = [(g, *(own.get(n, (None, None))[i] for n in names for i in (0, 1))) for g, own in lims.items()]
    if not ends:
        return {}
    bounds = rows.sparkSession.createDataFrame(ends, T.StructType([rows.schema[by], *(T.StructField(f"_{e}{i}", T.DoubleType()) for i in range(len(names)) for e in ("lo", "hi"))]))
    unit = [scoring.unit_range(F.col(n), F.col(f"_lo{i}"), F.col(f"_hi{i}")) for i, n in enumerate(names)]
    out = {}
    for r in ordered.matched(rows, F.broadcast(bounds), [by]).groupBy(by).agg(*_products(unit, F.col(target).cast("double"))).collect():  # a row for each group
        a, b, _ = _matrices(r, len(names))
        used = [i for i, n in enumerate(names) if n in lims[r[by]]]
        at = [0, *(i + 1 for i in used)]
        out[r[by]] = shares_of(a[np.ix_(at, at)], b[at], [names[i] for i in used], alpha), lims[r[by]]
    return out


def shares_of(a: np.ndarray, b: np.ndarray, names: Sequence[str], alpha: float) -> dict[str, float]:
    """Ridge weights from the products, negative ones left out and the rest fitted again, as shares of their sum."""
    keep = list(range(len(names)))
    while keep:
        at = [0, *(i + 1 for i in keep)]
        w = ridge(a[np.ix_(at, at)], b[at], alpha)
        if (w >= 0).all():
            break
        keep = [i for i, v in zip(keep, w, strict=True) if v >= 0]
    w = w if keep else np.zeros(0)
    total = np.abs(w).sum()
    shares = w / total if total > 1e-9 else np.full(len(keep), 1 / max(len(keep), 1))
    return dict(zip((names[i] for i in keep), map(float, shares), strict=True))


def monotone(values: Sequence[float], weights: Sequence[float]) -> np.ndarray:
    """The weighted least-squares fit that never falls: at each place the largest, over starts, of the smallest mean up to an end."""
    v, w = np.asarray(values, np.float64), np.asarray(weights, np.float64)
    sw, sv = np.append(0, np.cumsum(w)), np.append(0, np.cumsum(v * w))
    n = len(v)
    mean = np.array([[(sv[b + 1] - sv[a]) / (sw[b + 1] - sw[a]) if b >= a else np.inf for b in range(n)] for a in range(n)])
    return np.array([max(mean[a, i:].min() for a in range(i + 1)) for i in range(n)])


def thresholds(rows: DataFrame, score: Column, level: str, n_levels: int) -> tuple[list[float], list[float], list[int]]:
    """Midpoints between the levels' monotone medians; a level without rows takes the value to its left, else to its right."""
    mids = quantiles.exact(rows.select(F.col(level).alias("level"), score.alias("score")), ["level"], "score", {"m": quantiles.share(0.5)})
    return cuts_of({r["level"]: (r["m"], r["n"]) for r in mids.collect() if r["level"] is not None}, n_levels)


def cuts_of(got: Mapping[int, tuple[float, int]], n_levels: int) -> tuple[list[float], list[float], list[int]]:
    """The same from the levels' medians and numbers of rows."""
    have = sorted(k for k in got if 0 <= k < n_levels)
    if not have:
        raise ValueError("no labelled rows")
    fit = dict(zip(have, monotone([got[k][0] for k in have], [got[k][1] for k in have]), strict=True))
    full = [float(fit[max((h for h in have if h <= k), default=have[0])]) for k in range(n_levels)]
    return [(a + b) / 2 for a, b in zip(full, full[1:], strict=False)], full, [got.get(k, (None, 0))[1] for k in range(n_levels)]


def fit_axis(rows: DataFrame, names: Sequence[str], target: str, labels: Sequence[str], alpha: float = 10.0, **knobs) -> AxisModel:
    rows = ordered.written(rows.select(*dict.fromkeys([*names, target])), "labelled")  # read several times below
    weights, lims, dropped = fit_weights(rows, names, target, alpha)
    score = scoring.weighted({n: F.col(n) for n in weights}, weights, lims)
    cuts, _, _ = thresholds(rows, score, target, len(labels))
    return AxisModel(weights, lims, cuts, list(labels), dropped, **knobs)


def hashed_folds(rows: DataFrame, key: Sequence[str], level: str, k: int, seed: int) -> DataFrame:
    """Folds that share each level evenly, by the order of a digest of key and seed within the level."""
    mixed = F.md5(F.concat_ws("/", *(F.col(c).cast("string") for c in key), F.lit(str(seed))))
    mixed_rows = rows.withColumn("_mixed", mixed)
    placed = ordered.numbered(mixed_rows, [level], ["_mixed", *key], "_number")
    return placed.withColumn("fold", ((F.col("_number") - 1) % k).cast("int")).select(*rows.columns, "fold")


def _ranges_without(rows: DataFrame, names: Sequence[str], folds: Sequence[int]) -> DataFrame:
    """(feature, _b, low, high): ranges of the rows outside each fold, from one sort of the values; a row counts in every training set but one."""
    long = rows.select(F.col("fold").cast("long").alias("fold"), F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("v")) for n in names))).alias("x")).select("fold", "x.feature", "x.v")
    outside = lambda marks: (marks.to_numpy()[:, None] != np.array(folds)).astype(np.uint8)
    q = resampling.weighted_places(long, "feature", "v", "fold", outside, len(folds), {"low": quantiles.share(0.02), "high": quantiles.share(0.98)}, 1 << 14)
    return q.select("feature", "_b", "low", F.when(F.col("high") > F.col("low"), F.col("high")).otherwise(F.col("low") + 1e-6).alias("high"))


def cross_validate(rows: DataFrame, names: Sequence[str], target: str, labels: Sequence[str], folds: Sequence[int], alpha: float = 10.0) -> DataFrame:
    """Every row of ``folds`` with the score and ordinal of a model that was fitted, ranges and thresholds included, without its fold.

    The table is read once, and all folds are fitted at the same time: a row stands in the training set of
    every fold but its own, and ranges, products and medians are aggregates by training set. What
    reaches the driver are a few numbers for each fold, level and feature.
    """
    folds, names = list(folds), list(names)
    own = ordered.written(rows.where(F.col("fold").isin(folds)), "folds")
    others = F.filter(F.array(*map(F.lit, folds)), lambda f: f != F.col("fold"))
    train = own.select(F.col(target).alias("_y"), *names, F.explode(others).alias("_train"))
    lims: dict[int, dict[str, tuple[float, float]]] = {f: {} for f in folds}
    for r in _ranges_without(own, names, folds).collect():
        lims[folds[r["_b"]]][r["feature"]] = (r["low"], r["high"])
    spark = rows.sparkSession
    ends = [(f, *(lims[f].get(n, (None, None))[i] for n in names for i in (0, 1))) for f in folds]
    bounds = spark.createDataFrame(ends, ", ".join(["_train int", *(f"_{e}{i} double" for i in range(len(names)) for e in ("lo", "hi"))]))
    unit = [scoring.unit_range(F.col(n), F.col(f"_lo{i}"), F.col(f"_hi{i}")) for i, n in enumerate(names)]
    ranged = train.join(F.broadcast(bounds), "_train")  # a row for each fold
    shares = {}
    for r in ranged.groupBy("_train").agg(*_products(unit, F.col("_y").cast("double"))).collect():
        a, b, _ = _matrices(r, len(names))
        used = [i for i, n in enumerate(names) if n in lims[r["_train"]]]
        at = [0, *(i + 1 for i in used)]
        shares[r["_train"]] = shares_of(a[np.ix_(at, at)], b[at], [names[i] for i in used], alpha)
    weights = spark.createDataFrame([(f, *(shares.get(f, {}).get(n) for n in names)) for f in folds], ", ".join(["_fold int", *(f"_w{i} double" for i in range(len(names)))]))
    there = [F.when(u.isNotNull() & F.col(f"_w{i}").isNotNull(), F.struct((u * F.col(f"_w{i}")).alias("s"), F.col(f"_w{i}").alias("w"))) for i, u in enumerate(unit)]
    add = lambda field: sum((F.coalesce(t[field], F.lit(0.0)) for t in there), F.lit(0.0))
    score = F.when(add("w") > 0, add("s") / add("w")).otherwise(0.0)
    scored = ranged.join(F.broadcast(weights), F.col("_train") == F.col("_fold")).select("_train", "_y", score.alias("_s"))
    mids: dict[int, dict[int, tuple[float, int]]] = {f: {} for f in folds}
    for r in quantiles.exact(scored, ["_train", "_y"], "_s", {"m": quantiles.share(0.5)}).where("_y is not null").collect():
        mids[r["_train"]][int(r["_y"])] = (r["m"], r["n"])
    cuts = spark.createDataFrame([(f, cuts_of(mids[f], len(labels))[0]) for f in folds if mids[f]], "_cut int, _cuts array<double>")
    held = own.join(F.broadcast(bounds), F.col("fold") == F.col("_train")).join(F.broadcast(weights), F.col("fold") == F.col("_fold")).join(F.broadcast(cuts), F.col("fold") == F.col("_cut"))
    return held.withColumn("score", score).withColumn("predicted", F.size(F.filter("_cuts", lambda t: F.col("score") >= t))).select(*rows.columns, "score", "predicted")


def binomial_tail(hits: int, n: int) -> float | None:
    """Chance of at least ``hits`` heads in ``n`` fair throws."""
    return sum(comb(n, k) for k in range(hits, n + 1)) / 2**n if n else None


def bootstrap_medians(rows: DataFrame, score: str, level: str, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """(level, low, high): the 5th and 95th percentile of resampled medians; rows equal in all columns are drawn together."""
    return resampling.bootstrap_medians(rows, score, level, rows.columns, replicates, seed)


def hashed_bootstrap_medians(rows: DataFrame, score: str, level: str, key: Sequence[str], replicates: int = 1000, seed: int = 42) -> DataFrame:
    """As ``bootstrap_medians``, with draws by digests of replicate, place and seed, which any engine makes again.

    A level's draw j of replicate b is the row at digest(b, j, seed) modulo the level's size, in the order
    of the key. Draws are counted by place, so what is sorted for the medians are the rows, not the draws.
    """
    own = ordered.written(ordered.numbered(rows.select(F.col(level).alias("_l"), F.col(score).cast("double").alias("_s"), *key), ["_l"], list(key), "_at").select("_l", "_s", (F.col("_at") - 1).alias("_at")), "places")
    # A row for each level and a slice of its draws: the slices are dealt to all tasks before their draws are made.
    slices = own.groupBy("_l").agg(F.count(F.lit(1)).alias("_n")).select("_l", "_n", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / SLICE))).alias("_i"))
    slices = ordered.written(slices.select("*", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("_b")).hint("rebalance"), "slices")
    first = F.col("_i") * SLICE
    draws = slices.repartition(max(1, -(-slices.count() // 64))).select("_l", "_n", "_b", F.explode(F.sequence(first, F.least(first + SLICE, F.col("_n")) - 1)).alias("_j"))
    number = F.conv(F.substring(F.md5(F.concat_ws("/", *(F.col(c).cast("string") for c in ("_b", "_j")), F.lit(str(seed)))), 1, 12), 16, 10).cast("long")
    # What is joined is one row for each place, with the replicates that drew it; the hint keeps the draws, whose number Spark does not foresee, from being broadcast.
    hits = draws.groupBy("_l", (number % F.col("_n")).alias("_at")).agg(F.collect_list("_b").alias("_mark"))
    picked = ordered.matched(own.hint("merge"), hits, ["_l", "_at"])

    def weights(marks: pa.Array) -> np.ndarray:
        flat, row = marks.flatten().to_numpy(), np.repeat(np.arange(len(marks)), marks.value_lengths().to_numpy())
        return np.bincount(row * replicates + flat, minlength=len(marks) * replicates).reshape(len(marks), replicates)

    meds = resampling.weighted_medians(picked, "_l", "_s", "_mark", weights, replicates)
    q = meds.groupBy("_l").agg(F.percentile("m", F.array(F.lit(0.05), F.lit(0.95))).alias("q"))
    return q.select(F.col("_l").alias(level), F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
