"""Scores, labels and gates as Column expressions: signals stay in tables, decisions are made late."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ordinal scales of the two axes, lowest first, and what a blank label means.
DENSITY_LEVELS = ("sparser", "monolayer", "slightly dense", "dense", "very dense")
OVERLAP_LEVELS = ("no rouleaux", "slight rouleaux", "some rouleaux", "rouleaux", "heavy rouleaux")
DEFAULT_LABELS = {"density": "monolayer", "overlap": "no rouleaux"}
# Weights and ranges of the first composite.
V1_WEIGHTS = {"coverage": 0.2, "edge_density": 0.3, "glcm_contrast": 0.1, "lbp_entropy": 0.4}
V1_RANGES = {"coverage": (0.0, 1.0), "edge_density": (0.0, 1.0), "glcm_contrast": (0.0, 200.0), "lbp_entropy": (0.0, 6.0)}


def unit_range(x: Column, low: float | Column, high: float | Column) -> Column:
    """Min-max value clamped to [0, 1]; 0 where the range is empty or reversed; null stays null."""
    lo, hi = (v if isinstance(v, Column) else F.lit(float(v)) for v in (low, high))
    inside = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - lo) / F.nullif(hi - lo, F.lit(0.0))))
    return F.when(x.isNull(), None).when(hi <= lo, 0.0).otherwise(inside)


def weighted(features: Mapping[str, Column], weights: Mapping[str, float], ranges: Mapping[str, tuple]) -> Column:
    """Weighted mean of the features that are there and have a weight and a range, over the weights used; 0 if none."""
    used = [n for n in weights if n in features and n in ranges]
    terms = [F.when(features[n].isNotNull(), unit_range(features[n], *ranges[n]) * float(weights[n])).otherwise(0.0) for n in used]
    shares = [F.when(features[n].isNotNull(), float(weights[n])).otherwise(0.0) for n in used]
    if not used:
        return F.lit(0.0)
    total, share = reduce(lambda a, b: a + b, terms), reduce(lambda a, b: a + b, shares)
    return F.when(share > 0, total / share).otherwise(0.0)


def bucket_index(score: Column, thresholds: Sequence[float]) -> Column:
    """How many thresholds the score has reached; a score on a threshold belongs above it."""
    return reduce(lambda a, b: a + b, (F.when(score >= float(t), 1).otherwise(0) for t in thresholds))


def bucket(score: Column, thresholds: Sequence[float], labels: Sequence[str]) -> Column:
    if len(labels) != len(thresholds) + 1:
        raise ValueError("one label more than thresholds is needed")
    return F.when(score.isNotNull(), F.element_at(F.array(*map(F.lit, labels)), bucket_index(score, thresholds) + 1))


def below_floors(features: Mapping[str, Column], floors: Mapping[str, float]) -> Column:
    """How many features lie strictly below their floors; a missing value never does."""
    return reduce(lambda a, b: a + b, (F.when(F.coalesce(features[n] < float(t), F.lit(False)), 1).otherwise(0) for n, t in floors.items()))


def gate_fired(features: Mapping[str, Column], floors: Mapping[str, float], enabled: bool = True, rule: str = "all_below") -> Column:
    """True where every configured feature lies below its floor; a gate that is off or empty never fires, another rule is an error."""
    if rule != "all_below":
        raise ValueError(f"unknown rule of the gate: {rule}")
    return below_floors(features, floors) == len(floors) if enabled and floors else F.lit(False)


def near_miss(features: Mapping[str, Column], floors: Mapping[str, float]) -> Column:
    return below_floors(features, floors) == len(floors) - 1


def override(label: Column, saturation: Column, threshold: float | None, top: str, gated: Column, bottom: str) -> Column:
    """Saturation first lifts the label to the top, then the gate forces the bottom."""
    lifted = label if threshold is None else F.when(F.coalesce(saturation >= threshold, F.lit(False)), top).otherwise(label)
    return F.when(gated, bottom).otherwise(lifted)


def ordinal(label: Column, levels: Sequence[str]) -> Column:
    """Place of the label among its levels from 0; an unknown label is an error, null stays null."""
    at = F.array_position(F.array(*map(F.lit, levels)), label)
    return F.when(at == 0, F.raise_error(F.concat(F.lit("unknown level: "), label))).otherwise(at - 1).cast("int")


def range_position(x: Column, low: Column, high: Column) -> Column:
    """Where the value lies in its calibrated range, not clamped; null for an empty range."""
    return (x - low) / F.nullif(high - low, F.lit(0.0))


def correlation_words(r: Column) -> Column:
    return F.when(F.abs(r) >= 0.7, "strong").when(F.abs(r) >= 0.4, "moderate").when(r.isNotNull(), "weak")


def pair_relation(gain: Column) -> Column:
    return F.when(gain >= 0.10, "complementary").when(gain < 0.04, "redundant").when(gain.isNotNull(), "intermediate")


def fault_bucket(truth: Column, base: Column, folded: Column) -> Column:
    """Kind of a fault of the base rule, or of what folding adds: misses that folding rescues or not, false alarms old and new; null without a fault."""
    missed = truth & ~base
    return F.when(missed & folded, "A_rescued").when(missed, "B_still_missed").when(~truth & base, "C_fp_baseline").when(~truth & folded, "D_fp_new")


def halo_decision(contrast: Column, anisotropy: Column, radial_rho: Column, r2_over_r1: Column) -> Column:
    """Present: contrast at least 3 unless anisotropy above .35 demotes it; a radial field of low second moment is kept."""
    kept = (anisotropy <= 0.35) | ((radial_rho > 0.90) & (r2_over_r1 < 0.44))
    return (contrast >= 3.0) & kept


def halo_confidence(contrast: Column, present: Column) -> Column:
    return F.when((contrast >= 3.0) & ~present, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (contrast - 2.1) / 3.9)))


def diffuse_candidate(contrast: Column, radius: Column) -> Column:
    return (contrast >= 2.30) & (contrast < 3.0) & (radius >= 50)


def follows_neighbours(radius: Column, x: Column, y: Column, neighbours: Column) -> Column:
    """True if a neighbour (struct radius, x, y) has a blob within .12 of this one's centre and 1.3 times its own radius."""
    return F.exists(neighbours, lambda n: (n["radius"] > 0) & (F.hypot(x - n["x"], y - n["y"]) <= 0.12) & (radius <= 1.3 * n["radius"]))
