"""Outlying fields, scores and gates, slide summaries, evaluation and statistics on the stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import robust, scoring
from ..operators import quantiles, relational
from ..registry import query, r6
from .standins import axes, counts, event_counts, features, judged, sql, table

WEIGHTS = {"coverage": 0.5, "edges": 0.25, "entropy": 0.125, "contrast": 0.125}
RANGES = {"coverage": (0.4, 0.6), "edges": (0.2, 0.8), "entropy": (0.25, 0.75), "contrast": (0.25, 0.75)}
THRESHOLDS = (0.35, 0.45, 0.55, 0.65)
FLOORS = {"coverage": 0.47, "edges": 0.5, "contrast": 0.5}
LABELS = scoring.DENSITY_LEVELS


# --- Outlying fields ---------------------------------------------------------------------------

_BASE = """+ b1 AS (SELECT slide_id, count(*) AS n_fovs, avg(n_detected) AS mean, coalesce(stddev_samp(n_detected), 0) AS std, median(CAST(n_detected AS DOUBLE)) AS median FROM {t} GROUP BY 1),
 base AS (SELECT b1.*, m.mad FROM b1 JOIN (SELECT slide_id, median(abs(n_detected - median)) * CAST(1.4826 AS DOUBLE) AS mad FROM {t} JOIN b1 USING (slide_id) GROUP BY 1) m USING (slide_id)),
 z AS (SELECT *, (n_detected - median) / nullif(mad, 0) AS z, n_detected / nullif(median, 0) AS ratio FROM {t} JOIN base USING (slide_id)),
 f AS (SELECT *, array_to_string(list_filter([CASE WHEN n_fovs < 20 THEN 'small_slide' END, CASE WHEN coalesce(median, 0) = 0 OR coalesce(mad, 0) = 0 THEN 'zero_or_undefined_baseline' END,
   CASE WHEN median <> 0 AND abs(mean - median) > 0.25 * median THEN 'mean_median_divergence' END, CASE WHEN z >= 2 THEN 'high_outlier' END, CASE WHEN z <= -2 THEN 'low_outlier' END], lambda x: x IS NOT NULL), ';') AS flags FROM z) """
_FLAGGED = "SELECT slide_id, fov_id, n_detected, round_even(ratio, 4) AS ratio_to_median, round_even(z, 6) AS robust_zscore, flags FROM f"


def _flagged(rows: DataFrame) -> DataFrame:
    return robust.scored(rows).select("slide_id", "fov_id", "n_detected", F.bround("ratio", 4).alias("ratio_to_median"), r6("z").alias("robust_zscore"), "flags")


@query("robust_z_flags", sql(_BASE.format(t="counts") + _FLAGGED + " WHERE z >= 2", "counts"))
def robust_z_flags(spark, d):
    return _flagged(counts(spark, d)).where(F.col("robust_zscore") >= 2)


@query("robust_z_degenerate", sql(_BASE.format(t="event_counts") + _FLAGGED, "event_counts"))
def robust_z_degenerate(spark, d):
    return _flagged(event_counts(spark, d))


@query("slide_baseline", sql(_BASE.format(t="counts") + "SELECT slide_id, n_fovs, round_even(mean, 3) AS mean, round_even(std, 3) AS std, median, round_even(mad, 4) AS mad FROM base", "counts"))
def slide_baseline(spark, d):
    b = robust.baseline(counts(spark, d))
    return b.select("slide_id", "n_fovs", F.bround("mean", 3).alias("mean"), F.bround("std", 3).alias("std"), "median", F.bround("mad", 4).alias("mad"))


@query("crop_summary", sql(_BASE.format(t="event_counts") + "SELECT slide_id, count(z) AS n_scored, count(CASE WHEN z >= 2 THEN 1 END) AS n_flagged, round_even(count(CASE WHEN z >= 2 THEN 1 END) / nullif(CAST(count(z) AS DOUBLE), 0), 6) AS fraction, round_even(max(z), 6) AS top FROM f GROUP BY 1", "event_counts"))
def crop_summary(spark, d):
    z = robust.scored(event_counts(spark, d))
    hit = F.count(F.when(F.col("z") >= 2, 1))
    return z.groupBy("slide_id").agg(F.count("z").alias("n_scored"), hit.alias("n_flagged"), r6(hit / F.nullif(F.count("z"), F.lit(0))).alias("fraction"), r6(F.max("z")).alias("top"))


TIERS = (2, 3, 4, 5, 6, 7, 8, 10, 15, 20)


@query("threshold_sweep", sql(_BASE.format(t="counts") + """, t AS (SELECT unnest([2.0, 3, 4, 5, 6, 7, 8, 10, 15, 20])::DOUBLE AS tier),
 x AS (SELECT tier, count(CASE WHEN z >= tier AND fov_id % 12 = 0 THEN 1 END) AS tp, count(CASE WHEN fov_id % 12 = 0 THEN 1 END) AS p, count(CASE WHEN z >= tier AND fov_id % 12 <> 0 THEN 1 END) AS fp, count(CASE WHEN fov_id % 12 <> 0 THEN 1 END) AS n FROM f, t GROUP BY 1)
 SELECT tier, tp, p, fp, n, round_even(tp / nullif(CAST(p AS DOUBLE), 0), 6) AS recall, round_even(fp / nullif(CAST(n AS DOUBLE), 0), 6) AS false_alarms FROM x""", "counts"))
def threshold_sweep(spark, d):
    rows = robust.scored(counts(spark, d)).withColumn("truth", F.col("fov_id") % 12 == 0)
    s = relational.sweep(rows, "z", "truth", TIERS)
    return s.select("tier", "tp", "p", "fp", "n", r6("recall").alias("recall"), r6("false_alarms").alias("false_alarms"))


@query("boundary_rows", sql(_BASE.format(t="counts") + """, w AS (SELECT s.slide_id, e.fov_id FROM (SELECT DISTINCT slide_id FROM counts) s, (SELECT min(fov_id) AS fov_id FROM counts UNION ALL SELECT max(fov_id) + 1 FROM counts) e)
 SELECT w.slide_id, w.fov_id, f.n_detected, round_even(f.z, 6) AS z, coalesce(f.flags, 'no_data') AS flags FROM w LEFT JOIN f ON w.slide_id = f.slide_id AND w.fov_id = f.fov_id""", "counts"))
def boundary_rows(spark, d):
    rows = robust.scored(counts(spark, d))
    a, b = counts(spark, d).agg(F.min("fov_id"), F.max("fov_id") + 1).head()
    want = rows.select("slide_id").distinct().withColumn("fov_id", F.explode(F.array(F.lit(a), F.lit(b))))
    return want.join(rows, ["slide_id", "fov_id"], "left").select("slide_id", "fov_id", "n_detected", r6("z").alias("z"), F.coalesce("flags", F.lit("no_data")).alias("flags"))


@query("missing_ids", sql("""+ r AS (SELECT min(fov_id) AS a, max(fov_id) AS b FROM counts), m AS (SELECT s.slide_id, x.fov_id FROM (SELECT DISTINCT slide_id FROM counts) s, (SELECT CAST(unnest(range(a, b + 1)) AS INTEGER) AS fov_id FROM r) x EXCEPT SELECT slide_id, fov_id FROM counts)
 SELECT slide_id, count(*) AS n_missing, string_agg(CAST(fov_id AS VARCHAR), ',' ORDER BY fov_id) AS missing FROM m GROUP BY 1""", "counts"))
def missing_ids(spark, d):
    c = counts(spark, d)
    a, b = c.agg(F.min("fov_id"), F.max("fov_id")).head()
    have = c.groupBy("slide_id").agg(F.collect_set("fov_id").alias("have"))
    gone = have.select("slide_id", F.array_except(F.sequence(F.lit(a), F.lit(b)), "have").alias("m"))
    return gone.where(F.size("m") > 0).select("slide_id", F.size("m").cast("long").alias("n_missing"), F.array_join(F.transform(F.sort_array("m"), lambda x: x.cast("string")), ",").alias("missing"))


# --- Scores, gates, labels ---------------------------------------------------------------------


def _norm(name: str) -> str:
    lo, hi = RANGES[name]
    return f"CASE WHEN {name} IS NULL THEN NULL ELSE least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), ({name} - CAST({lo} AS DOUBLE)) / (CAST({hi} AS DOUBLE) - CAST({lo} AS DOUBLE)))) END"


_SCORE = "+ n AS (SELECT *, " + ", ".join(f"{_norm(k)} AS n_{k}" for k in WEIGHTS) + " FROM features), s AS (SELECT *, (" + " + ".join(f"CASE WHEN {k} IS NOT NULL THEN n_{k} * {w} ELSE 0 END" for k, w in WEIGHTS.items()) + ") / (" + " + ".join(f"CASE WHEN {k} IS NOT NULL THEN CAST({w} AS DOUBLE) ELSE 0 END" for k, w in WEIGHTS.items()) + ") AS score FROM n), "
_SCORE += "l AS (SELECT *, CASE WHEN score >= 0.65 THEN 5 WHEN score >= 0.55 THEN 4 WHEN score >= 0.45 THEN 3 WHEN score >= 0.35 THEN 2 ELSE 1 END AS pos, coalesce(coverage < 0.47, false) AND coalesce(edges < 0.5, false) AND coalesce(contrast < 0.5, false) AS gated FROM s), "
_SCORE += f"g AS (SELECT *, {list(LABELS)}[pos] AS raw_label, CASE WHEN gated THEN '{LABELS[0]}' WHEN entropy >= 0.7 THEN '{LABELS[-1]}' ELSE {list(LABELS)}[pos] END AS label FROM l) "


def scored_fields(spark, d) -> DataFrame:
    """Fields with score, raw label, gate and final label."""
    f = features(spark, d)
    cols = {k: F.col(k) for k in WEIGHTS}
    s = f.withColumn("score", scoring.weighted(cols, WEIGHTS, RANGES))
    s = s.withColumn("raw_label", scoring.bucket(F.col("score"), THRESHOLDS, LABELS)).withColumn("gated", scoring.gate_fired(cols, FLOORS))
    return s.withColumn("label", scoring.override(F.col("raw_label"), F.col("entropy"), 0.7, LABELS[-1], F.col("gated"), LABELS[0]))


@query("normalize_ranges", sql(_SCORE + "SELECT slide_id, fov_id, " + ", ".join(f"round_even(n_{k}, 6) AS {k}" for k in WEIGHTS) + " FROM n", "features"))
def normalize_ranges(spark, d):
    return features(spark, d).select("slide_id", "fov_id", *(r6(scoring.unit_range(F.col(k), *RANGES[k])).alias(k) for k in WEIGHTS))


@query("weighted_composite", sql(_SCORE + "SELECT slide_id, fov_id, round_even(score, 6) AS score FROM s", "features"))
def weighted_composite(spark, d):
    return scored_fields(spark, d).select("slide_id", "fov_id", r6("score").alias("score"))


@query("bucket_labels", sql(_SCORE + "SELECT raw_label, pos - 1 AS ordinal, count(*) AS n FROM g GROUP BY 1, 2", "features"))
def bucket_labels(spark, d):
    s = scored_fields(spark, d).withColumn("ordinal", scoring.ordinal(F.col("raw_label"), LABELS))
    return s.groupBy("raw_label", "ordinal").agg(F.count(F.lit(1)).alias("n"))


@query("empty_field_gate", sql(_SCORE + "SELECT slide_id, count(*) AS n, count(CASE WHEN gated THEN 1 END) AS n_gated, count(CASE WHEN CAST(coalesce(coverage < 0.47, false) AS INT) + CAST(coalesce(edges < 0.5, false) AS INT) + CAST(coalesce(contrast < 0.5, false) AS INT) = 2 THEN 1 END) AS n_near FROM g GROUP BY 1", "features"))
def empty_field_gate(spark, d):
    near = scoring.near_miss({k: F.col(k) for k in WEIGHTS}, FLOORS)
    return scored_fields(spark, d).groupBy("slide_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("gated"), 1)).alias("n_gated"), F.count(F.when(near, 1)).alias("n_near"))


@query("label_overrides", sql(_SCORE + "SELECT slide_id, fov_id, raw_label, label, gated FROM g WHERE raw_label <> label OR gated", "features"))
def label_overrides(spark, d):
    return scored_fields(spark, d).where((F.col("raw_label") != F.col("label")) | F.col("gated")).select("slide_id", "fov_id", "raw_label", "label", "gated")


_LONG = _SCORE + ", u AS (" + " UNION ALL ".join(f"SELECT slide_id, fov_id, '{k}' AS feature, {k} AS raw, n_{k} AS norm, CAST({w} AS DOUBLE) AS weight FROM n" for k, w in WEIGHTS.items()) + ") "


@query("score_decomposition", sql(_LONG + "SELECT slide_id, fov_id, feature, floor(norm * weight * CAST(1e7 AS DOUBLE)) / CAST(1e7 AS DOUBLE) AS contribution, CAST(row_number() OVER (PARTITION BY slide_id, fov_id ORDER BY norm * weight DESC, feature) AS INT) AS place FROM u WHERE raw IS NOT NULL", "features"))
def score_decomposition(spark, d):
    f = features(spark, d).unpivot(["slide_id", "fov_id"], list(WEIGHTS), "feature", "raw").where("raw is not null")
    pick = lambda m: F.element_at(F.create_map(*[x for k in WEIGHTS for x in (F.lit(k), F.lit(float(m[k])))]), F.col("feature"))
    c = scoring.unit_range(F.col("raw"), pick({k: v[0] for k, v in RANGES.items()}), pick({k: v[1] for k, v in RANGES.items()})) * pick(WEIGHTS)
    place = F.row_number().over(Window.partitionBy("slide_id", "fov_id").orderBy(F.col("c").desc(), "feature"))
    return f.withColumn("c", c).select("slide_id", "fov_id", "feature", (F.floor(F.col("c") * 1e7) / 1e7).alias("contribution"), place.alias("place"))


@query("ood_positions", sql("+ u AS (" + " UNION ALL ".join(f"SELECT slide_id, fov_id, '{k}' AS feature, {k} AS raw FROM features" for k in WEIGHTS) + """ WHERE contrast IS NOT NULL), q AS (SELECT feature, quantile_cont(raw, CAST(0.02 AS DOUBLE)) AS lo, quantile_cont(raw, CAST(0.98 AS DOUBLE)) AS hi FROM u WHERE slide_id % 2 = 0 GROUP BY 1)
 SELECT feature, count(*) AS n, count(CASE WHEN raw < lo OR raw > hi THEN 1 END) AS n_clipped, round_even(max((raw - lo) / nullif(hi - lo, 0)), 5) AS furthest, round_even(max(raw / nullif(hi, 0)), 5) AS x_over_p98 FROM u JOIN q USING (feature) WHERE slide_id % 2 = 1 GROUP BY 1""", "features"))
def ood_positions(spark, d):
    u = features(spark, d).unpivot(["slide_id", "fov_id"], list(WEIGHTS), "feature", "raw").where("raw is not null")
    q = u.where("slide_id % 2 = 0").groupBy("feature").agg(F.percentile("raw", F.array(F.lit(0.02), F.lit(0.98))).alias("q"))
    rows = u.where("slide_id % 2 = 1").join(q, "feature").withColumn("lo", F.col("q")[0]).withColumn("hi", F.col("q")[1])
    at = scoring.range_position(F.col("raw"), F.col("lo"), F.col("hi"))
    return rows.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.count(F.when((F.col("raw") < F.col("lo")) | (F.col("raw") > F.col("hi")), 1)).alias("n_clipped"), F.bround(F.max(at), 5).alias("furthest"), F.bround(F.max(F.col("raw") / F.nullif(F.col("hi"), F.lit(0.0))), 5).alias("x_over_p98"))


# --- Slide summary and cohort --------------------------------------------------------------------

_SUMMARY = _SCORE + """, e AS (SELECT *, CASE WHEN gated THEN CAST(0 AS DOUBLE) ELSE score END AS eff FROM g),
 m AS (SELECT slide_id, label, count(*) AS n, min(list_position(""" + str(list(LABELS)) + """, label)) AS r FROM g GROUP BY 1, 2),
 mode AS (SELECT slide_id, arg_min(label, -n * 10 + r) AS modal FROM m GROUP BY 1),
 a AS (SELECT slide_id, count(*) AS n_scored, count(CASE WHEN gated THEN 1 END) AS n_gated, avg(eff) AS mean, avg(score) AS mean_raw, avg(CASE WHEN NOT gated THEN score END) AS mean_ungated, coalesce(stddev_samp(eff), 0) AS std FROM e GROUP BY 1) """


def slide_rows(spark, d) -> DataFrame:
    s = scored_fields(spark, d).withColumn("eff", F.when(F.col("gated"), 0.0).otherwise(F.col("score")))
    a = s.groupBy("slide_id").agg(F.count(F.lit(1)).alias("n_scored"), F.count(F.when(F.col("gated"), 1)).alias("n_gated"), F.avg("eff").alias("mean"), F.avg("score").alias("mean_raw"), F.avg(F.when(~F.col("gated"), F.col("score"))).alias("mean_ungated"), F.coalesce(F.stddev_samp("eff"), F.lit(0.0)).alias("std"))
    return a.join(relational.modal(s, ["slide_id"], "label", scoring.ordinal(F.col("label"), LABELS)), "slide_id")


@query("modal_bucket", sql(_SUMMARY + "SELECT * FROM mode", "features"))
def modal_bucket(spark, d):
    return relational.modal(scored_fields(spark, d), ["slide_id"], "label", scoring.ordinal(F.col("label"), LABELS))


@query("slide_summary", sql(_SUMMARY + """, z AS (SELECT slide_id, count(*) AS n_counts, max(n_detected) AS top FROM counts WHERE slide_id % 3 <> 0 GROUP BY 1)
 SELECT s.s_suppkey AS slide_id, n_scored, n_gated, round_even(mean, 6) AS mean, round_even(mean_raw, 6) AS mean_raw, round_even(mean_ungated, 6) AS mean_ungated, round_even(std, 5) AS std, modal, n_counts, top,
   CASE WHEN a.slide_id IS NULL AND z.slide_id IS NULL THEN 'no_data' WHEN a.slide_id IS NULL THEN 'no_scores' WHEN z.slide_id IS NULL THEN 'no_counts' ELSE 'ok' END AS status
 FROM supplier s LEFT JOIN a ON s.s_suppkey = a.slide_id LEFT JOIN mode ON mode.slide_id = a.slide_id LEFT JOIN z ON s.s_suppkey = z.slide_id""", "features", "counts"))
def slide_summary(spark, d):
    """One row for each slide of the catalogue, with what each pass has for it and which pass has nothing."""
    z = counts(spark, d).where("slide_id % 3 <> 0").groupBy("slide_id").agg(F.count(F.lit(1)).alias("n_counts"), F.max("n_detected").alias("top"))
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("slide_id")).join(slide_rows(spark, d), "slide_id", "left").join(z, "slide_id", "left")
    a, b = F.col("n_scored").isNull(), F.col("n_counts").isNull()
    status = F.when(a & b, "no_data").when(a, "no_scores").when(b, "no_counts").otherwise("ok")
    return rows.select("slide_id", "n_scored", "n_gated", r6("mean").alias("mean"), r6("mean_raw").alias("mean_raw"), r6("mean_ungated").alias("mean_ungated"), F.bround("std", 5).alias("std"), "modal", "n_counts", "top", status.alias("status"))


@query("cohort_grid", sql("SELECT coalesce(CAST(first AS VARCHAR), 'all') AS first, coalesce(CAST(second AS VARCHAR), 'all') AS second, count(*) AS n FROM axes GROUP BY CUBE (first, second)", "axes"))
def cohort_grid(spark, d):
    c = axes(spark, d).cube("first", "second").agg(F.count(F.lit(1)).alias("n"))
    return c.select(F.coalesce(F.col("first").cast("string"), F.lit("all")).alias("first"), F.coalesce(F.col("second").cast("string"), F.lit("all")).alias("second"), "n")


@query("level_counts", sql(_SCORE + f", lv AS (SELECT unnest({[*LABELS, 'never seen']}) AS level) SELECT level, count(g.label) AS n FROM lv LEFT JOIN g ON g.label = lv.level GROUP BY 1", "features"))
def level_counts(spark, d):
    levels = spark.createDataFrame([(x,) for x in (*LABELS, "never seen")], "level string")
    n = scored_fields(spark, d).groupBy(F.col("label").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    return levels.join(n, "level", "left").fillna(0, ["n"])


@query("dataset_medians", sql("SELECT slide_id % 4 AS dataset, count(*) AS n, round_even(median(coverage), 6) AS coverage, round_even(median(edges), 6) AS edges, round_even(median(entropy), 6) AS entropy, round_even(median(contrast), 6) AS contrast FROM features GROUP BY 1", "features"))
def dataset_medians(spark, d):
    f = features(spark, d).withColumn("dataset", F.col("slide_id") % 4)
    return medians(f, "dataset", list(WEIGHTS))


def medians(rows: DataFrame, by: str, names: list[str]) -> DataFrame:
    """A row for each group with its number of rows and the median of each column, exact at any size; a column without values has none."""
    long = rows.select(by, F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.col(k).alias("v")) for k in names))).alias("x")).select(by, "x.name", "x.v")
    mid = quantiles.exact(long, [by, "name"], "v", {"mid": quantiles.share(0.5)})
    wide = mid.groupBy(by).agg(*(r6(F.max(F.when(F.col("name") == k, F.col("mid")))).alias(k) for k in names))
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).join(wide, by, "left").select(by, "n", *names)


@query("catalog_counters", sql("SELECT CAST(grouping_id(first, site) AS BIGINT) AS level, first, site, count(*) AS n FROM axes GROUP BY GROUPING SETS ((first), (site), ())", "axes"))
def catalog_counters(spark, d):
    a = axes(spark, d)
    return a.groupingSets([[F.col("first")], [F.col("site")], []], "first", "site").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"))


# --- Evaluation --------------------------------------------------------------------------------


@query("confusion_binary", sql("""+ c AS (SELECT source, count(CASE WHEN truth AND predicted THEN 1 END) AS tp, count(CASE WHEN truth AND NOT predicted THEN 1 END) AS fn, count(CASE WHEN NOT truth AND predicted THEN 1 END) AS fp, count(CASE WHEN NOT truth AND NOT predicted THEN 1 END) AS tn FROM judged GROUP BY 1)
 SELECT *, round_even(fn / nullif(CAST(fn + tp AS DOUBLE), 0), 6) AS fn_rate, round_even(fp / nullif(CAST(fp + tn AS DOUBLE), 0), 6) AS fp_rate FROM c""", "judged"))
def confusion_binary(spark, d):
    c = relational.confusion(judged(spark, d), "truth", "predicted", ["source"])
    return c.withColumn("fn_rate", r6("fn_rate")).withColumn("fp_rate", r6("fp_rate"))


@query("confusion_matrix", sql("+ lv AS (SELECT unnest(range(1, 7))::INTEGER AS first) SELECT lv.first, " + ", ".join(f'count(CASE WHEN second = {k} THEN 1 END) AS "{k}"' for k in range(1, 7)) + " FROM lv LEFT JOIN axes ON axes.first = lv.first GROUP BY 1", "axes"))
def confusion_matrix(spark, d):
    return relational.dense_confusion(axes(spark, d), "first", "second", list(range(1, 7)))


@query("off_by_one", sql("SELECT site, count(*) AS n, round_even(avg(CASE WHEN first = second THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS exact, round_even(avg(CASE WHEN abs(first - second) <= 1 THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS within_one, round_even(avg(CAST(abs(first - second) AS DOUBLE)), 6) AS mean_error FROM axes GROUP BY 1", "axes"))
def off_by_one(spark, d):
    gap = F.abs(F.col("first") - F.col("second"))
    share = lambda c: r6(F.avg(F.when(c, 1.0).otherwise(0.0)))
    return axes(spark, d).groupBy("site").agg(F.count(F.lit(1)).alias("n"), share(gap == 0).alias("exact"), share(gap <= 1).alias("within_one"), r6(F.avg(gap.cast("double"))).alias("mean_error"))


@query("axis_delta_sign", sql("SELECT sign(first - second)::INTEGER AS manual, sign(cents - 10000000)::INTEGER AS model, count(*) AS n FROM axes WHERE abs(first - second) >= 2 GROUP BY 1, 2", "axes"))
def axis_delta_sign(spark, d):
    rows = axes(spark, d).where(F.abs(F.col("first") - F.col("second")) >= 2)
    return rows.groupBy(F.signum(F.col("first") - F.col("second")).cast("int").alias("manual"), F.signum(F.col("cents") - 10_000_000).cast("int").alias("model")).agg(F.count(F.lit(1)).alias("n"))


@query("flips_vs_baseline", sql(_SCORE + """, v AS (SELECT slide_id, fov_id, score * 1.03125 AS score FROM s), b AS (SELECT slide_id, fov_id, score, CASE WHEN score >= 0.65 THEN 5 WHEN score >= 0.55 THEN 4 WHEN score >= 0.45 THEN 3 WHEN score >= 0.35 THEN 2 ELSE 1 END AS pos FROM v)
 SELECT l.slide_id, count(*) AS n, count(CASE WHEN l.pos <> b.pos THEN 1 END) AS flips, round_even(max(abs(l.score - b.score)), 6) AS drift FROM l JOIN b ON l.slide_id = b.slide_id AND l.fov_id = b.fov_id GROUP BY 1""", "features"))
def flips_vs_baseline(spark, d):
    base = scored_fields(spark, d).select("slide_id", "fov_id", "score")
    variant = base.select("slide_id", "fov_id", (F.col("score") * 1.03125).alias("other"))
    met = relational.must_match(base, variant, ["slide_id", "fov_id"])
    flip = scoring.bucket_index(F.col("score"), THRESHOLDS) != scoring.bucket_index(F.col("other"), THRESHOLDS)
    return met.groupBy("slide_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(flip, 1)).alias("flips"), r6(F.max(F.abs(F.col("score") - F.col("other")))).alias("drift"))


@query("fn_fp_buckets", sql("""+ k AS (SELECT CASE WHEN truth AND NOT predicted AND (predicted OR toxic) THEN 'A_rescued' WHEN truth AND NOT predicted THEN 'B_still_missed' WHEN NOT truth AND predicted THEN 'C_fp_baseline' WHEN NOT truth AND NOT predicted AND toxic THEN 'D_fp_new' END AS bucket FROM judged)
 SELECT bucket, count(*) AS n FROM k WHERE bucket IS NOT NULL GROUP BY 1""", "judged"))
def fn_fp_buckets(spark, d):
    rows = judged(spark, d).withColumn("bucket", scoring.fault_bucket(F.col("truth"), F.col("predicted"), F.col("predicted") | F.col("toxic")))
    return rows.where("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


# --- Statistics --------------------------------------------------------------------------------


@query("avg_rank", sql("SELECT slide_id, fov_id, (2 * rank() OVER (PARTITION BY slide_id ORDER BY n_detected) + count(*) OVER (PARTITION BY slide_id, n_detected) - 1) / CAST(2 AS DOUBLE) AS place FROM counts", "counts"))
def avg_rank(spark, d):
    return counts(spark, d).select("slide_id", "fov_id", robust.tie_rank("n_detected", ["slide_id"]).alias("place"))


def _rank_sql(*cols: str) -> str:
    return "r AS (SELECT " + ", ".join(f"(2 * rank() OVER (ORDER BY {c}) + count(*) OVER (PARTITION BY {c}) - 1) / CAST(2 AS DOUBLE) AS {c}" for c in cols) + " FROM axes)"


@query("spearman", sql(f"+ {_rank_sql('first', 'second', 'cents')} SELECT round_even(corr(cents, first), 6) AS rho_cents_first, round_even(corr(cents, second), 6) AS rho_cents_second, round_even(corr(first, second), 6) AS rho_first_second FROM r", "axes"))
def spearman(spark, d):
    r = robust.spearman(axes(spark, d), [("cents", "first"), ("cents", "second"), ("first", "second")])
    return r.select(*(r6(c).alias(c) for c in r.columns))


@query("partial_spearman", sql(f"+ {_rank_sql('first', 'second', 'cents')}, c AS (SELECT corr(cents, first) AS a, corr(cents, second) AS b, corr(first, second) AS c FROM r) SELECT round_even((a - b * c) / sqrt((1 - b * b) * (1 - c * c)), 6) AS partial_first, round_even((b - a * c) / sqrt((1 - a * a) * (1 - c * c)), 6) AS partial_second FROM c", "axes"))
def partial_spearman(spark, d):
    r = robust.spearman(axes(spark, d), [("cents", "first"), ("cents", "second"), ("first", "second")])
    a, b, c = F.col("rho_cents_first"), F.col("rho_cents_second"), F.col("rho_first_second")
    return r.select(r6(robust.partial(a, b, c)).alias("partial_first"), r6(robust.partial(b, a, c)).alias("partial_second"))


@query("ols_residual_outliers", sql("""+ w AS (SELECT slide_id, fov_id, edges AS y, coverage AS x FROM features), m AS (SELECT slide_id, regr_slope(y, x) AS slope, regr_intercept(y, x) AS icept FROM w GROUP BY 1),
 r AS (SELECT w.slide_id, fov_id, y - (icept + slope * x) AS res FROM w JOIN m USING (slide_id)), s AS (SELECT slide_id, stddev_samp(res) AS sd FROM r GROUP BY 1)
 SELECT slide_id, count(*) AS n, count(CASE WHEN abs(res) > 1.5 * sd THEN 1 END) AS outliers, round_even(max(sd), 6) AS sd FROM r JOIN s USING (slide_id) GROUP BY 1""", "features"))
def ols_residual_outliers(spark, d):
    f = features(spark, d)
    m = f.groupBy("slide_id").agg(F.regr_slope("edges", "coverage").alias("slope"), F.regr_intercept("edges", "coverage").alias("icept"))
    r = f.join(m, "slide_id").withColumn("res", F.col("edges") - (F.col("icept") + F.col("slope") * F.col("coverage"))).withColumn("sd", F.stddev_samp("res").over(Window.partitionBy("slide_id")))
    return r.groupBy("slide_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.abs("res") > 1.5 * F.col("sd"), 1)).alias("outliers"), r6(F.max("sd")).alias("sd"))


@query("joint_r2", sql("""+ c AS (SELECT slide_id, count(*) AS n, corr(edges, coverage) AS a, corr(edges, entropy) AS b, corr(coverage, entropy) AS c FROM features GROUP BY 1), j AS (SELECT *, (a * a + b * b - 2 * a * b * c) / nullif(1 - c * c, 0) AS r2 FROM c)
 SELECT slide_id, n, round_even(a * a, 5) AS solo_a, round_even(b * b, 5) AS solo_b, round_even(r2, 5) AS joint, round_even(1 - (1 - r2) * (n - 1) / (n - 3), 5) AS adjusted FROM j WHERE n > 3""", "features"))
def joint_r2(spark, d):
    c = features(spark, d).groupBy("slide_id").agg(F.count(F.lit(1)).alias("n"), F.corr("edges", "coverage").alias("a"), F.corr("edges", "entropy").alias("b"), F.corr("coverage", "entropy").alias("c")).where("n > 3")
    r2 = F.expr("(a * a + b * b - 2 * a * b * c) / nullif(1 - c * c, 0)")
    return c.withColumn("r2", r2).select("slide_id", "n", F.bround(F.expr("a * a"), 5).alias("solo_a"), F.bround(F.expr("b * b"), 5).alias("solo_b"), F.bround("r2", 5).alias("joint"), F.bround(F.expr("1 - (1 - r2) * (n - 1) / (n - 3)"), 5).alias("adjusted"))


#: Percentiles, and shares of the largest values whose means are taken: with six of the whole slide and eight shares at or above a value, 53 statistics.
PERCENTILES, SHARES = tuple(range(5, 101, 5)), tuple(range(5, 100, 5))


@query("slide_statistics53", sql("""+ c AS (SELECT slide_id, CAST(n_detected AS DOUBLE) AS x FROM counts), md AS (SELECT slide_id, median(x) AS m FROM c GROUP BY 1), dv AS (SELECT slide_id, median(abs(x - m)) AS mad FROM c JOIN md USING (slide_id) GROUP BY 1),
 s AS (SELECT slide_id, list(x ORDER BY x DESC) AS xs FROM c GROUP BY 1)
 SELECT c.slide_id, round_even(avg(x), 6) AS mean, median(x) AS median, max(x) - min(x) AS range, round_even(coalesce(stddev_samp(x), 0), 5) AS stdev, any_value(mad) AS mad, round_even(quantile_cont(x, CAST(0.75 AS DOUBLE)) - quantile_cont(x, CAST(0.25 AS DOUBLE)), 6) AS iqr, """
    + ", ".join(f"round_even(quantile_cont(x, CAST({p / 100} AS DOUBLE)), 6) AS p{p}" for p in PERCENTILES) + ", " + ", ".join(f"round_even(avg(CASE WHEN x >= {t} THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS at_least_{t}" for t in range(5, 13)) + ", "
    + ", ".join(f"round_even(list_avg(list_slice(any_value(xs), 1, greatest(1, CAST(round_even(len(any_value(xs)) * {q} / CAST(100 AS DOUBLE), 0) AS INTEGER)))), 6) AS top{q}" for q in SHARES) + " FROM c JOIN dv USING (slide_id) JOIN s USING (slide_id) GROUP BY 1", "counts"))
def slide_statistics53(spark, d):
    """Location, spread, percentiles, shares at or above a value, and means of the top shares of each slide."""
    c = counts(spark, d).withColumn("x", F.col("n_detected").cast("double"))
    return statistics53(c, "slide_id", "x")


def statistics53(rows: DataFrame, slide: str, value: str) -> DataFrame:
    """A row for each slide with the 53 statistics of its values, whatever number of them a slide has.

    Percentiles and the bounds of the top shares are exact order statistics; the mean of a top share is the sum
    of what lies above its bound, and as often the bound as is missing then.
    """
    x = F.col(value)
    places = {"median": quantiles.share(0.5), **{f"p{p}": quantiles.share(p / 100) for p in PERCENTILES}, **{f"b{q}": quantiles.from_top(q) for q in SHARES}, "q1": quantiles.share(0.25), "q3": quantiles.share(0.75)}
    at = quantiles.exact(rows, [slide], value, places).withColumnRenamed("n", "n_values")
    met = rows.join(at, slide)
    above = [F.struct(F.sum(F.when(x > F.col(f"b{q}"), x).otherwise(0.0)).alias("s"), F.count(F.when(x > F.col(f"b{q}"), 1)).alias("n")).alias(f"a{q}") for q in SHARES]
    sums = met.groupBy(slide).agg(F.avg(x).alias("mean"), (F.max(x) - F.min(x)).alias("range"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("stdev"), *(F.avg(F.when(x >= t, 1.0).otherwise(0.0)).alias(f"at_least_{t}") for t in range(5, 13)), *above)
    mad = quantiles.exact(met.select(slide, F.abs(x - F.col("median")).alias("off")), [slide], "off", {"mad": quantiles.share(0.5)}).select(slide, "mad")
    k = lambda q: quantiles.top_count(F.col("n_values"), q)
    top = lambda q: (F.col(f"a{q}.s") + (k(q) - F.col(f"a{q}.n")) * F.col(f"b{q}")) / k(q)
    out = at.join(sums, slide).join(mad, slide)
    return out.select(slide, r6("mean").alias("mean"), "median", "range", F.bround("stdev", 5).alias("stdev"), "mad", r6(F.col("q3") - F.col("q1")).alias("iqr"), *(r6(f"p{p}").alias(f"p{p}") for p in PERCENTILES),
        *(r6(f"at_least_{t}").alias(f"at_least_{t}") for t in range(5, 13)), *(r6(top(q)).alias(f"top{q}") for q in SHARES))


@query("upper_median", sql("SELECT slide_id, list_sort(list(n_detected))[len(list(n_detected)) // 2 + 1] AS upper FROM counts GROUP BY 1", "counts"))
def upper_median(spark, d):
    return quantiles.exact(counts(spark, d), ["slide_id"], "n_detected", {"upper": quantiles.upper}).select("slide_id", F.col("upper").cast("long").alias("upper"))


@query("iqr_fence", sql("""+ q AS (SELECT slide_id, quantile_cont(CAST(n_detected AS DOUBLE), CAST(0.25 AS DOUBLE)) AS a, quantile_cont(CAST(n_detected AS DOUBLE), CAST(0.75 AS DOUBLE)) AS b FROM counts GROUP BY 1)
 SELECT slide_id, fov_id, n_detected FROM counts JOIN q USING (slide_id) WHERE n_detected < a - 1.5 * (b - a) OR n_detected > b + 1.5 * (b - a)""", "counts"))
def iqr_fence(spark, d):
    c = counts(spark, d)
    q = c.groupBy("slide_id").agg(F.percentile("n_detected", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    x, a, b = F.col("n_detected"), F.col("q")[0], F.col("q")[1]
    return c.join(q, "slide_id").where((x < a - 1.5 * (b - a)) | (x > b + 1.5 * (b - a))).select("slide_id", "fov_id", "n_detected")
