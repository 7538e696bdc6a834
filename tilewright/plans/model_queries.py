"""Calibration and resampling on the stand-in tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import models, ordered, relational, resampling
from ..registry import SQL, query, r6
from .quality_queries import PERCENTILES, RANGES, SHARES, statistics53
from .standins import counts, features, sql, table

NAMES = ("coverage", "edges", "entropy", "contrast")
LABELS = scoring.DENSITY_LEVELS


def levelled(rows):
    """The fields with an ordinal that follows two of the signals."""
    level = F.least(F.lit(4), F.greatest(F.lit(0), F.floor((F.col("coverage") - 0.3) * 8 + (F.col("edges") - 0.3) * 3)))
    return rows.withColumn("level", level.cast("int"))


def labelled(spark, d):
    """Fields that have all four signals, with their ordinal and the number of spots: the rows of ``_LABELLED``."""
    return levelled(features(spark, d).join(counts(spark, d), ["slide_id", "fov_id"]).where("contrast is not null"))


@query("ridge_gram", sql("+ x AS (SELECT coverage AS a, edges AS b, n_detected AS y FROM features JOIN counts USING (slide_id, fov_id)) SELECT count(*) AS n, round_even(sum(a * a), 4) AS aa, round_even(sum(a * b), 4) AS ab, round_even(sum(b * b), 4) AS bb, round_even(sum(a * y), 4) AS ay, round_even(sum(b * y), 4) AS \"by\" FROM x", "features", "counts"))
def ridge_gram(spark, d):
    x = features(spark, d).join(counts(spark, d), ["slide_id", "fov_id"])
    a, b, y = F.col("coverage"), F.col("edges"), F.col("n_detected")
    s = lambda p, q: F.bround(F.sum(p * q), 4)
    return x.agg(F.count(F.lit(1)).alias("n"), s(a, a).alias("aa"), s(a, b).alias("ab"), s(b, b).alias("bb"), s(a, y).alias("ay"), s(b, y).alias("by"))


@query("ridge_fit")
def ridge_fit(spark, d):
    m = models.fit_axis(labelled(spark, d), NAMES, "level", LABELS)
    rows = [(n, m.weights.get(n), *m.ranges.get(n, (None, None)), n in m.dropped) for n in NAMES]
    return spark.createDataFrame(rows, "feature string, weight double, low double, high double, dropped boolean")


#: Labelled fields with their level, as the plans above make them.
_LABELLED = """+ lab AS (SELECT slide_id, fov_id, coverage, edges, entropy, contrast, n_detected, CAST(least(4, greatest(0, floor((coverage - 0.3::DOUBLE) * 8 + (edges - 0.3::DOUBLE) * 3))) AS INTEGER) AS level FROM features JOIN counts USING (slide_id, fov_id) WHERE contrast IS NOT NULL)"""


def _unit(x: str, low: str, high: str) -> str:
    return f"CASE WHEN {high} <= {low} THEN 0 ELSE least(1, greatest(0, ({x} - {low}) / ({high} - {low}))) END"


_MEAN_SCORE = "(" + " + ".join(f"0.25::DOUBLE * {_unit(n, f'{lo}::DOUBLE', f'{hi}::DOUBLE')}" for n, (lo, hi) in ((n, RANGES[n]) for n in NAMES)) + ")"


def _monotone_sql(levels: str, by: str = "") -> str:
    """CTEs fit (level, v), full (every level, v) and cuts (level, t) from a view (by, level, m, n) of the levels' medians."""
    key = f"{by}, " if by else ""
    same = lambda a, b: f"{a}.{by} = {b}.{by} AND " if by else ""
    return f""", spans AS (SELECT {'a.' + by + ', ' if by else ''}a.level AS a, b.level AS b, sum(c.m * c.n) / sum(c.n) AS mean FROM {levels} a JOIN {levels} b ON {same('a', 'b')}a.level <= b.level JOIN {levels} c ON {same('a', 'c')}c.level BETWEEN a.level AND b.level GROUP BY ALL),
 lows AS (SELECT {'i.' + by + ', ' if by else ''}i.level, s.a, min(s.mean) AS low FROM {levels} i JOIN spans s ON {same('i', 's')}s.a <= i.level AND s.b >= i.level GROUP BY ALL), fit AS (SELECT {key}level, max(low) AS v FROM lows GROUP BY ALL),
 every AS (SELECT {'f.' + by + ', ' if by else ''}k AS level FROM (SELECT DISTINCT {by or '1 AS one'} FROM fit) f, (SELECT unnest(range(5))::INTEGER AS k)),
 full_ AS (SELECT {'e.' + by + ', ' if by else ''}e.level, coalesce(arg_max(f.v, f.level) FILTER (f.level <= e.level), arg_min(f.v, f.level)) AS v FROM every e JOIN fit f ON {same('e', 'f')}true GROUP BY ALL),
 cuts AS (SELECT {'a.' + by + ', ' if by else ''}a.level, (a.v + b.v) / 2 AS t FROM full_ a JOIN full_ b ON {same('a', 'b')}b.level = a.level + 1)"""


@query("pava_thresholds", sql(_LABELLED + f", lv AS (SELECT level, median({_MEAN_SCORE}) AS m, count(*) AS n FROM lab GROUP BY 1)" + _monotone_sql("lv") + " SELECT f.level, round_even(f.v, 9) AS median, coalesce(lv.n, 0) AS n, round_even(c.t, 9) AS upper FROM full_ f LEFT JOIN lv USING (level) LEFT JOIN cuts c USING (level)", "features", "counts"))
def pava_thresholds(spark, d):
    rows = labelled(spark, d)
    score = scoring.weighted({n: F.col(n) for n in NAMES}, dict.fromkeys(NAMES, 0.25), RANGES)
    cuts, fit, n = models.thresholds(rows, score, "level", 5)
    return spark.createDataFrame([(k, round(fit[k], 9), n[k], round(cuts[k], 9) if k < 4 else None) for k in range(5)], "level int, median double, n long, upper double")


def _two_sql(rows: str, by: str) -> str:
    """CTEs w (by, ranges, shares wa and wb) of the two-feature ridge fit, dropped features included, from a view (by, a, b, y)."""
    return f""", lim AS (SELECT {by}, quantile_cont(a, 0.02::DOUBLE) AS al, quantile_cont(a, 0.98::DOUBLE) AS ah0, quantile_cont(b, 0.02::DOUBLE) AS bl, quantile_cont(b, 0.98::DOUBLE) AS bh0 FROM {rows} GROUP BY 1),
 lims AS (SELECT {by}, al, CASE WHEN ah0 > al THEN ah0 ELSE ah0 + 1e-6::DOUBLE END AS ah, bl, CASE WHEN bh0 > bl THEN bh0 ELSE bh0 + 1e-6::DOUBLE END AS bh FROM lim),
 u AS (SELECT {by}, {_unit('a', 'al', 'ah')} AS a, {_unit('b', 'bl', 'bh')} AS b, y::DOUBLE AS y FROM {rows} JOIN lims USING ({by})),
 s AS (SELECT {by}, count(*) AS n, sum(a * a) - sum(a) * sum(a) / count(*) + 10 AS aa, sum(b * b) - sum(b) * sum(b) / count(*) + 10 AS bb, sum(a * b) - sum(a) * sum(b) / count(*) AS ab, sum(a * y) - sum(a) * sum(y) / count(*) AS ay, sum(b * y) - sum(b) * sum(y) / count(*) AS \"by\" FROM u GROUP BY 1),
 c AS (SELECT *, (ay * bb - \"by\" * ab) / (aa * bb - ab * ab) AS ca, (\"by\" * aa - ay * ab) / (aa * bb - ab * ab) AS cb FROM s),
 k AS (SELECT *, CASE WHEN ca >= 0 AND cb >= 0 THEN ca WHEN ca >= 0 AND cb < 0 AND ay >= 0 THEN ay / aa ELSE 0 END AS ka, CASE WHEN ca >= 0 AND cb >= 0 THEN cb WHEN cb >= 0 AND ca < 0 AND \"by\" >= 0 THEN \"by\" / bb ELSE 0 END AS kb FROM c),
 w AS (SELECT {by}, n, al, ah, bl, bh, ka / (ka + kb) AS wa, kb / (ka + kb) AS wb FROM k JOIN lims USING ({by}))"""


def _score_two(a: str, b: str) -> str:
    return f"(wa * {_unit(a, 'al', 'ah')} + wb * {_unit(b, 'bl', 'bh')}) / (wa + wb)"


@query("ridge_two", sql(_LABELLED + ", r AS (SELECT slide_id % 4 AS part, coverage AS a, edges AS b, level AS y FROM lab)" + _two_sql("r", "part") + " SELECT part, round_even(wa, 6) AS coverage, round_even(wb, 6) AS edges, round_even(al, 6) AS low, round_even(ah, 6) AS high FROM w", "features", "counts"))
def ridge_two(spark, d):
    """The fit of two features, for each part of the slides on its own: ranges, ridge, negative weights dropped, shares."""
    rows = labelled(spark, d).withColumn("part", (F.col("slide_id") % 4).cast("long"))
    fits = models.fit_weights_by(rows, ("coverage", "edges"), "level", "part")
    out = [(part, round(w.get("coverage", 0.0), 6), round(w.get("edges", 0.0), 6), *(round(x, 6) for x in lims["coverage"])) for part, (w, lims) in fits.items()]
    return spark.createDataFrame(out, "part long, coverage double, edges double, low double, high double")


@query("cross_validate", sql(_LABELLED + """, f AS (SELECT *, CAST((row_number() OVER (PARTITION BY level ORDER BY md5(slide_id || '/' || fov_id || '/42'), slide_id, fov_id) - 1) % 5 AS INTEGER) AS own FROM lab), folds AS (SELECT unnest(range(5))::INTEGER AS fold),
 r AS (SELECT fold, coverage AS a, edges AS b, level AS y FROM f, folds WHERE own <> fold)""" + _two_sql("r", "fold") + f", lv AS (SELECT fold, y AS level, median({_score_two('a', 'b')}) AS m, count(*) AS n FROM r JOIN w USING (fold) GROUP BY 1, 2)" + _monotone_sql("lv", "fold") + f""",
 held AS (SELECT f.own AS fold, f.slide_id, f.fov_id, f.level, {_score_two('f.coverage', 'f.edges')} AS score FROM f JOIN w ON w.fold = f.own), said AS (SELECT h.fold, h.level, count(CASE WHEN h.score >= c.t THEN 1 END) AS p FROM held h JOIN cuts c ON c.fold = h.fold GROUP BY h.fold, h.slide_id, h.fov_id, h.level)
 SELECT fold, count(*) AS n, round_even(avg(CASE WHEN p = level THEN 1::DOUBLE ELSE 0 END), 6) AS exact, round_even(avg(CASE WHEN abs(p - level) <= 1 THEN 1::DOUBLE ELSE 0 END), 6) AS within_one FROM said GROUP BY 1""", "features", "counts"))
def cross_validate(spark, d):
    """Five folds even in every level; ranges, weights and thresholds are fitted without the fold that they judge."""
    rows = models.hashed_folds(labelled(spark, d), ["slide_id", "fov_id"], "level", 5, 42)
    out = models.cross_validate(rows, ("coverage", "edges"), "level", LABELS, range(5))
    gap = F.abs(F.col("predicted") - F.col("level"))
    return out.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), r6(F.avg((gap == 0).cast("double"))).alias("exact"), r6(F.avg((gap <= 1).cast("double"))).alias("within_one"))


@query("cross_validate_four")
def cross_validate_four(spark, d):
    """The same with all four features, for every field of the table, and with an eighth of the slides in each fold: the ridge of four features has no short SQL.

    A feature that a field lacks adds nothing to the products of the fit and is left out of the field's score. Fields
    of no known slide stand in the first fold.
    """
    fold = F.coalesce(F.pmod(F.col("slide_id"), F.lit(8)), F.lit(0))
    rows = levelled(features(spark, d)).withColumn("fold", fold.cast("int"))
    out = models.cross_validate(rows, NAMES, "level", LABELS, range(8))
    gap = F.abs(F.col("predicted") - F.col("level"))
    return out.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), r6(F.avg((gap == 0).cast("double"))).alias("exact"), r6(F.avg((gap <= 1).cast("double"))).alias("within_one"))


@query("gate_floors", sql("+ q AS (" + " UNION ALL ".join(f"SELECT '{g}' AS feature, quantile_cont({c}, 0.02::DOUBLE) AS floor FROM features" for g, c in (("otsu_separability", "coverage"), ("lbp_entropy", "entropy"), ("edge_density_unmasked", "edges"))) + ") SELECT feature, round_even(floor, 6) AS floor, false AS enabled FROM q", "features"))
def gate_floors(spark, d):
    """Floors of the empty-field gate; one of its four features was not fitted, so it is off."""
    rows = features(spark, d).select(F.col("coverage").alias("otsu_separability"), F.col("entropy").alias("lbp_entropy"), F.col("edges").alias("edge_density_unmasked"))
    lims = models.ranges(rows, rows.columns)
    gate = models.derive_gate(models.AxisModel(dict.fromkeys(lims, 1.0), lims, [], ["all"]))
    return spark.createDataFrame([(k, v, gate.enabled) for k, v in gate.floors.items()], "feature string, floor double, enabled boolean").withColumn("floor", r6("floor"))


@query("axis_union", sql("+ q AS (SELECT 'coverage' AS feature, quantile_cont(coverage, 0.02::DOUBLE) AS low, quantile_cont(coverage, 0.98::DOUBLE) AS high FROM features UNION ALL SELECT 'edges', quantile_cont(edges, 0.1::DOUBLE), quantile_cont(edges, 0.9::DOUBLE) FROM features UNION ALL SELECT 'entropy', quantile_cont(entropy, 0.1::DOUBLE), quantile_cont(entropy, 0.9::DOUBLE) FROM features) SELECT feature, round_even(low, 6) AS low, round_even(high, 6) AS high FROM q", "features"))
def axis_union(spark, d):
    """Ranges of the features of either axis; the overlap axis wins where both have one. The model goes through its file."""
    f = ordered.written(features(spark, d).select("coverage", "edges", "entropy"), "features")
    axis = lambda lims: models.AxisModel(dict.fromkeys(lims, 1.0), lims, [], ["all"])
    model = models.ScoringModel(axis(models.ranges(f, ("coverage", "edges"))), axis(models.ranges(f, ("edges", "entropy"), 0.1, 0.9)), models.Gate(False, {}))
    rows = [(k, *v) for k, v in models.ScoringModel.from_json(model.to_json()).ranges().items()]
    return spark.createDataFrame(rows, "feature string, low double, high double").select("feature", r6("low").alias("low"), r6("high").alias("high"))


@query("hashed_bootstrap", sql(_LABELLED + f""", o AS (SELECT level, {_MEAN_SCORE} AS s, row_number() OVER (PARTITION BY level ORDER BY slide_id, fov_id) - 1 AS k FROM lab), z AS (SELECT level, count(*) AS n FROM lab GROUP BY 1),
 dr AS (SELECT level, b, CAST(('0x' || substr(md5(b || '/' || j || '/42'), 1, 12))::BIGINT % n AS BIGINT) AS k FROM (SELECT level, n, b, unnest(range(0, n)) AS j FROM (SELECT level, n, unnest(range(0, 60)) AS b FROM z))),
 md AS (SELECT level, b, median(s) AS m FROM dr JOIN o USING (level, k) GROUP BY 1, 2) SELECT level, round_even(quantile_cont(m, 0.05::DOUBLE), 6) AS low, round_even(quantile_cont(m, 0.95::DOUBLE), 6) AS high FROM md GROUP BY 1""", "features", "counts"))
def hashed_bootstrap(spark, d):
    """Intervals of the levels' medians from draws that any engine makes again."""
    rows = labelled(spark, d).withColumn("score", scoring.weighted({n: F.col(n) for n in NAMES}, dict.fromkeys(NAMES, 0.25), RANGES))
    return models.hashed_bootstrap_medians(rows, "score", "level", ["slide_id", "fov_id"], 60).select("level", r6("low").alias("low"), r6("high").alias("high"))


@query("refit_drift", sql("+ a AS (SELECT quantile_cont(coverage, 0.02::DOUBLE) AS x FROM features WHERE slide_id % 2 = 0), b AS (SELECT quantile_cont(coverage, 0.02::DOUBLE) AS x FROM features) SELECT 'threshold' AS kind, '0' AS name, round_even(a.x, 6) AS before, round_even(b.x, 6) AS now, round_even(b.x - a.x, 6) AS change FROM a, b UNION ALL SELECT 'weight', 'coverage', 0.75::DOUBLE, 0.5::DOUBLE, -0.25::DOUBLE UNION ALL SELECT 'weight', 'edges', NULL, 0.5::DOUBLE, NULL", "features"))
def refit_drift(spark, d):
    """What a refit moved: weights and thresholds before and now."""
    f = features(spark, d)
    low = lambda rows: models.ranges(rows, ("coverage",))["coverage"][0]
    before = models.AxisModel({"coverage": 0.75}, {}, [low(f.where("slide_id % 2 = 0"))], ["a", "b"])
    now = models.AxisModel({"coverage": 0.5, "edges": 0.5}, {}, [low(f)], ["a", "b"])
    out = spark.createDataFrame(models.drift(before, now), "kind string, name string, before double, now double, change double")
    return out.select("kind", "name", *(r6(c).alias(c) for c in ("before", "now", "change")))


def _draw_sql(key: str, seed: int) -> str:
    u = f"('0x' || substr(md5({key} || '/' || (b // {resampling.DRAWS}) || '/{seed}'), 1 + 4 * (b % {resampling.DRAWS}), 4))::BIGINT"
    return " + ".join(f"CAST({u} >= {c} AS INTEGER)" for c in resampling.CUTS)


@query("bootstrap_ci", sql(_LABELLED + f""", o AS (SELECT level, {_MEAN_SCORE} AS s, slide_id || '/' || fov_id AS key FROM lab), w AS (SELECT level, s, b, {_draw_sql("key", 42)} AS w FROM o, (SELECT unnest(range(0, 1000)) AS b)),
 c AS (SELECT level, b, s, sum(w) OVER (PARTITION BY level, b ORDER BY s RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(w) OVER (PARTITION BY level, b) AS n FROM w WHERE w > 0),
 md AS (SELECT level, b, (min(s) FILTER (upto > (n - 1) // 2) + min(s) FILTER (upto > n // 2)) / 2 AS m FROM c GROUP BY 1, 2) SELECT level, round_even(quantile_cont(m, 0.05::DOUBLE), 6) AS low, round_even(quantile_cont(m, 0.95::DOUBLE), 6) AS high FROM md GROUP BY 1""", "features", "counts"))
def bootstrap_ci(spark, d):
    """Intervals of the levels' medians from a thousand resamples."""
    rows = labelled(spark, d).withColumn("score", scoring.weighted({n: F.col(n) for n in NAMES}, dict.fromkeys(NAMES, 0.25), RANGES))
    return resampling.bootstrap_medians(rows, "score", "level", ["slide_id", "fov_id"]).select("level", r6("low").alias("low"), r6("high").alias("high"))


#: The 53 statistics of a slide's counts, as :func:`quality_queries.statistics53` names them.
STATISTICS = ("mean", "median", "range", "stdev", "mad", "iqr", *(f"p{p}" for p in PERCENTILES), *(f"at_least_{t}" for t in range(5, 13)), *(f"top{q}" for q in SHARES))
_SLIDES = f"sl AS (SELECT s.*, s_acctbal AS y FROM ({SQL['slide_statistics53']}) s JOIN supplier ON s_suppkey = slide_id), lg AS (UNPIVOT (SELECT slide_id, y, {', '.join(f'{s}::DOUBLE AS {s}' for s in STATISTICS)} FROM sl) ON {', '.join(STATISTICS)} INTO NAME statistic VALUE x)"
_RHO = "CASE WHEN (sw * sxx - sx * sx) * (sw * syy - sy * sy) > 0 THEN (sw * sxy - sx * sy) / sqrt((sw * sxx - sx * sx) * (sw * syy - sy * sy)) ELSE 0 END"
_SUMS = "sum(w)::DOUBLE AS sw, sum(w * rx)::DOUBLE AS sx, sum(w * ry)::DOUBLE AS sy, sum(w * rx * rx)::DOUBLE AS sxx, sum(w * ry * ry)::DOUBLE AS syy, sum(w * rx * ry)::DOUBLE AS sxy"


def _rank_sql(value: str, by: str) -> str:
    return f"sum(w) OVER (PARTITION BY {by} ORDER BY {value} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - (sum(w) OVER (PARTITION BY {by}, {value}) - 1) / 2::DOUBLE"


def _slides(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("slide_id"), F.col("s_acctbal").alias("target"))
    own = statistics53(counts(spark, d).withColumn("x", F.col("n_detected").cast("double")), "slide_id", "x")
    return ordered.written(own.join(s, "slide_id"), "slides")


@query("paired_bootstrap", f"""WITH {_SLIDES}, dw AS (SELECT slide_id, y, b, {_draw_sql("slide_id", 42)} AS w FROM sl, (SELECT unnest(range(0, 2000)) AS b) UNION ALL SELECT slide_id, y, -1, 1 FROM sl),
 ry AS (SELECT slide_id, b, w, {_rank_sql("y", "b")} AS ry FROM dw WHERE w > 0), rx AS (SELECT b, statistic, w, ry, {_rank_sql("x", "b, statistic")} AS rx FROM ry JOIN lg USING (slide_id)),
 rs AS (SELECT b, statistic, {_SUMS} FROM rx GROUP BY 1, 2), rh AS (SELECT b, statistic, {_RHO} AS rho FROM rs), dl AS (SELECT a.*, abs(a.rho) - abs(m.rho) AS delta FROM rh a JOIN rh m ON a.b = m.b AND m.statistic = 'mean'),
 q AS (SELECT statistic, max(rho) FILTER (b < 0) AS rho, quantile_cont(rho, 0.05::DOUBLE) FILTER (b >= 0) AS low, quantile_cont(rho, 0.95::DOUBLE) FILTER (b >= 0) AS high, quantile_cont(delta, 0.05::DOUBLE) FILTER (b >= 0) AS dlow, quantile_cont(delta, 0.95::DOUBLE) FILTER (b >= 0) AS dhigh FROM dl GROUP BY 1)
 SELECT statistic, round_even(rho, 6) AS rho, round_even(low, 6) AS low, round_even(high, 6) AS high, round_even(dlow, 6) AS delta_low, round_even(dhigh, 6) AS delta_high, dlow > 0 OR dhigh < 0 AS differs FROM q""")
def paired_bootstrap(spark, d):
    """All 53 statistics of a slide against its target on two thousand resamples of slides, each held against the mean."""
    got = resampling.paired_bootstrap(_slides(spark, d), ["slide_id"], STATISTICS, "target", "mean")
    return got.select("statistic", *(r6(c).alias(c) for c in ("rho", "low", "high", "delta_low", "delta_high")), "differs")


@query("permutation_p", f"""WITH {_SLIDES}, pl AS (SELECT slide_id, row_number() OVER (ORDER BY slide_id) AS k, (2 * rank() OVER (ORDER BY y) + count(*) OVER (PARTITION BY y) - 1) / 2::DOUBLE AS ry FROM sl),
 sh AS (SELECT slide_id, b, row_number() OVER (PARTITION BY b ORDER BY md5(slide_id || '/' || b || '/43'), slide_id) AS k FROM sl, (SELECT unnest(range(0, 2000)) AS b)), gv AS (SELECT b, sh.slide_id, ry FROM sh JOIN pl USING (k) UNION ALL SELECT -1, slide_id, ry FROM pl),
 rx AS (SELECT slide_id, statistic, 1 AS w, (2 * rank() OVER (PARTITION BY statistic ORDER BY x) + count(*) OVER (PARTITION BY statistic, x) - 1) / 2::DOUBLE AS rx FROM lg),
 rs AS (SELECT b, statistic, {_SUMS} FROM gv JOIN rx USING (slide_id) GROUP BY 1, 2), tp AS (SELECT b, max(abs({_RHO})) AS top FROM rs GROUP BY 1), se AS (SELECT top AS seen FROM tp WHERE b < 0)
 SELECT round_even(max(seen), 6) AS max_abs_rho, count(*) FILTER (b >= 0 AND top >= seen - 1e-12) AS hits, round_even((count(*) FILTER (b >= 0 AND top >= seen - 1e-12) + 1) / 2001::DOUBLE, 6) AS p FROM tp, se""")
def permutation_p(spark, d):
    """How often a shuffled target is matched as well by any of the 53 statistics."""
    got = resampling.permutation_p(_slides(spark, d), ["slide_id"], STATISTICS, "target")
    return got.select(r6("max_abs_rho").alias("max_abs_rho"), "hits", r6("p").alias("p"))


@query("grouping_rollup", sql("+ j AS (SELECT slide_id % 5 AS axis, fov_id % 12 AS fold, count(*) AS n, avg(CAST(n_detected % 3 = 0 AS INT)) AS exact FROM counts GROUP BY 1, 2) SELECT axis, sum(n)::BIGINT AS n, round_even(sum(n * exact) / sum(n), 6) AS exact FROM j GROUP BY 1", "counts"))
def grouping_rollup(spark, d):
    """Fold results to one figure for each axis, weighted by rows."""
    j = counts(spark, d).groupBy((F.col("slide_id") % 5).alias("axis"), (F.col("fov_id") % 12).alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("n_detected") % 3 == 0).cast("int")).alias("exact"))
    return j.groupBy("axis").agg(F.sum("n").alias("n"), r6(F.sum(F.col("n") * F.col("exact")) / F.sum("n")).alias("exact"))


@query("golden_drift", sql("SELECT slide_id, count(*) AS n, round_even(max(abs(coverage - edges)), 6) AS drift, count(CASE WHEN coverage >= 0.5 AND edges < 0.5 THEN 1 END) AS flips FROM features GROUP BY 1", "features"))
def golden_drift(spark, d):
    f = features(spark, d)
    met = relational.must_match(f.select("slide_id", "fov_id", "coverage"), f.select("slide_id", "fov_id", "edges"), ["slide_id", "fov_id"])
    return met.groupBy("slide_id").agg(F.count(F.lit(1)).alias("n"), r6(F.max(F.abs(F.col("coverage") - F.col("edges")))).alias("drift"), F.count(F.when((F.col("coverage") >= 0.5) & (F.col("edges") < 0.5), 1)).alias("flips"))
