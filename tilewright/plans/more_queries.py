"""Smaller operators of the workflow on the stand-in tables: names, scales, counters, orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import robust, scoring, text
from ..operators import quantiles
from ..registry import SQL, query, r6
from .quality_queries import statistics53
from .standins import axes, counts, features, judged, sql, table

@query("composite_v1", sql("SELECT slide_id, fov_id, round_even((coverage_n * 0.2::DOUBLE + edges_n * 0.3::DOUBLE + CASE WHEN contrast IS NOT NULL THEN contrast_n * 0.1::DOUBLE ELSE 0 END + entropy_n * 0.4::DOUBLE) / (0.2::DOUBLE + 0.3::DOUBLE + CASE WHEN contrast IS NOT NULL THEN 0.1::DOUBLE ELSE 0 END + 0.4::DOUBLE), 5) AS score FROM (SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, coverage)) AS coverage_n, least(1.0::DOUBLE, greatest(0.0::DOUBLE, edges)) AS edges_n, least(1.0::DOUBLE, contrast / 2) AS contrast_n, least(1.0::DOUBLE, entropy / 2) AS entropy_n FROM features)", "features"))
def composite_v1(spark, d):
    own = {"coverage": F.col("coverage"), "edge_density": F.col("edges"), "glcm_contrast": F.col("contrast") * 100, "lbp_entropy": F.col("entropy") * 3}
    s = scoring.weighted(own, scoring.V1_WEIGHTS, scoring.V1_RANGES)
    return features(spark, d).select("slide_id", "fov_id", F.bround(s, 5).alias("score"))


@query("mean_z", sql("SELECT slide_id, fov_id, round_even((n_detected - avg(n_detected) OVER w) / nullif(stddev_samp(n_detected) OVER w, 0), 5) AS z FROM counts WINDOW w AS (PARTITION BY slide_id)", "counts"))
def mean_z(spark, d):
    w = Window.partitionBy("slide_id")
    return counts(spark, d).select("slide_id", "fov_id", F.bround((F.col("n_detected") - F.avg("n_detected").over(w)) / F.nullif(F.stddev_samp("n_detected").over(w), F.lit(0.0)), 5).alias("z"))


LEVELS = ("small", "large", "red", "blue")


@query("manual_tags", "SELECT p_partkey, CASE WHEN split_part(p_name, ' ', 1) IN ('small', 'red') THEN 'large' WHEN split_part(p_name, ' ', 1) IN ('large', 'blue') THEN split_part(p_name, ' ', 1) END AS density, split_part(p_name, ' ', 2) = 'ring' AS crenated, upper(p_type[1]) || lower(p_type[2:]) AS shown FROM part")
def manual_tags(spark, d):
    """The lowest levels folded into the next, a flag that is a tag, and a level's name as it is shown."""
    tags = text.tags(F.replace("p_name", F.lit(" "), F.lit(",")))
    return table(spark, d, "part").select("p_partkey", text.folded(text.last_level(tags, LEVELS), ("small", "red"), "large").alias("density"), F.array_contains(tags, "ring").alias("crenated"), F.initcap("p_type").alias("shown"))


@query("protocol_parse", "WITH p AS (SELECT p_partkey, p_brand || '_' || p_size || 'uL_' || (p_size % 7) || 'min_' || CASE WHEN p_size % 2 = 0 THEN 'DAPI' ELSE 'none' END AS name FROM part) SELECT p_partkey, CAST(regexp_extract(name, '_([0-9]+)uL', 1) AS INTEGER) AS volume, CAST(regexp_extract(name, '_([0-9]+)min', 1) AS INTEGER) AS minutes, name LIKE '%_DAPI' AS dapi, regexp_extract(name, '^(.*)_[0-9]+uL', 1) AS sample FROM p")
def protocol_parse(spark, d):
    """Volume, incubation and stain are the last three parts of a name; the rest is the sample."""
    p = table(spark, d, "part")
    stain = F.when(F.col("p_size") % 2 == 0, "DAPI").otherwise("none")
    parts = F.split(F.concat_ws("_", "p_brand", F.concat(F.col("p_size").cast("string"), F.lit("uL")), F.concat((F.col("p_size") % 7).cast("string"), F.lit("min")), stain), "_")
    q = p.select("p_partkey", parts.alias("x"))
    whole = lambda c, unit: F.regexp_replace(c, f"{unit}$", "").cast("int")
    return q.select("p_partkey", whole(F.element_at("x", -3), "uL").alias("volume"), whole(F.element_at("x", -2), "min").alias("minutes"), (F.element_at("x", -1) == "DAPI").alias("dapi"), F.array_join(F.slice("x", F.lit(1), F.size("x") - 3), "_").alias("sample"))


@query("crenation_flag", sql("SELECT slide_id, sum(n_detected)::BIGINT AS isolated, CASE WHEN sum(n_detected) < 620 THEN 'insufficient' WHEN count(CASE WHEN n_detected >= 12 THEN 1 END) / CAST(count(*) AS DOUBLE) >= 0.05 THEN 'flagged' ELSE 'clear' END AS verdict FROM counts GROUP BY 1", "counts"))
def crenation_flag(spark, d):
    n = F.sum("n_detected")
    share = F.count(F.when(F.col("n_detected") >= 12, 1)) / F.count(F.lit(1))
    return counts(spark, d).groupBy("slide_id").agg(n.alias("isolated"), F.when(n < 620, "insufficient").when(share >= 0.05, "flagged").otherwise("clear").alias("verdict"))


@query("combined_scores", sql("SELECT site, round_even(avg(first) + avg(second), 6) AS sum_of_means, round_even(avg((first + second) / CAST(2 AS DOUBLE)), 6) AS mean_of_two, sum(first + second - 2)::BIGINT AS ordinal_sum FROM axes GROUP BY 1", "axes"))
def combined_scores(spark, d):
    """The three scores that go by one name: sum of means, mean of two, and sum of ordinals."""
    a, b = F.col("first"), F.col("second")
    return axes(spark, d).groupBy("site").agg(r6(F.avg(a) + F.avg(b)).alias("sum_of_means"), r6(F.avg((a + b) / 2)).alias("mean_of_two"), F.sum(a + b - 2).alias("ordinal_sum"))


_FAMILY = "CASE WHEN regexp_matches(statistic, '^p[0-9]+$') THEN 'percentile' WHEN statistic LIKE 'at_least%' THEN 'fraction' WHEN statistic LIKE 'top%' THEN 'trimmed-mean' ELSE 'whole-slide' END"


@query("statistic_family", f"WITH s AS (UNPIVOT (SELECT COLUMNS(* EXCLUDE (slide_id))::DOUBLE FROM ({SQL['slide_statistics53']})) ON COLUMNS(*) INTO NAME statistic VALUE x) SELECT statistic, {_FAMILY} AS family, CAST(nullif(regexp_extract(statistic, '([0-9]+)$', 1), '') AS INTEGER) AS sweep, count(*) AS n, round_even(avg(x), 5) AS mean FROM s GROUP BY 1, 2, 3")
def statistic_family(spark, d):
    """The family and sweep of each of the slides' statistics by its name, and its mean over all slides."""
    own = statistics53(counts(spark, d).withColumn("x", F.col("n_detected").cast("double")), "slide_id", "x")
    names = [c for c in own.columns if c != "slide_id"]
    rows = own.select(F.explode(F.array(*(F.struct(F.lit(c).alias("statistic"), F.col(c).cast("double").alias("x")) for c in names))).alias("p")).select("p.*")
    s = F.col("statistic")
    return rows.groupBy("statistic", text.statistic_family(s).alias("family"), text.sweep(s).alias("sweep")).agg(F.count(F.lit(1)).alias("n"), F.bround(F.avg("x"), 5).alias("mean"))


@query("short_labels", "SELECT s_name, regexp_extract(s_name, '^([A-Z])', 1) || '-' || right(s_name, 4) AS short FROM supplier")
def short_labels(spark, d):
    return table(spark, d, "supplier").select("s_name", F.concat_ws("-", F.regexp_extract("s_name", "^([A-Z])", 1), F.right("s_name", F.lit(4))).alias("short"))


@query("signed_offset", sql("SELECT second - first AS off_by, count(*) AS n FROM axes GROUP BY 1", "axes"))
def signed_offset(spark, d):
    return axes(spark, d).groupBy((F.col("second") - F.col("first")).alias("off_by")).agg(F.count(F.lit(1)).alias("n"))


@query("first_seen", sql("SELECT second, arg_min(site, o_orderkey) AS site, min(o_orderkey) AS row_no FROM axes GROUP BY 1", "axes"))
def first_seen(spark, d):
    return axes(spark, d).groupBy("second").agg(F.min_by("site", "o_orderkey").alias("site"), F.min("o_orderkey").alias("row_no"))


@query("group_ranges", sql("+ c AS (SELECT min(cents) AS cutoff FROM axes WHERE first = 5) SELECT site, first, count(*) AS n, min(cents) AS low, max(cents) AS high, count(CASE WHEN cents < cutoff * 2 THEN 1 END) AS below FROM axes, c GROUP BY 1, 2 HAVING count(*) > 1", "axes"))
def group_ranges(spark, d):
    """Range of each group of more than one, and how many lie under the cutoff taken from the reference level."""
    a = axes(spark, d)
    cutoff = a.where("first = 5").agg(F.min("cents")).head()[0]
    return a.groupBy("site", "first").agg(F.count(F.lit(1)).alias("n"), F.min("cents").alias("low"), F.max("cents").alias("high"), F.count(F.when(F.col("cents") < F.lit(cutoff) * 2, 1)).alias("below")).where("n > 1")


@query("cross_technique_outliers", sql("+ q AS (SELECT slide_id, quantile_cont(coverage, 0.75::DOUBLE) AS a, quantile_cont(edges, 0.75::DOUBLE) AS b, quantile_cont(entropy, 0.75::DOUBLE) AS c FROM features GROUP BY 1) SELECT slide_id, fov_id, CAST(coverage > a AS INT) + CAST(edges > b AS INT) + CAST(entropy > c AS INT) AS n FROM features JOIN q USING (slide_id) WHERE CAST(coverage > a AS INT) + CAST(edges > b AS INT) + CAST(entropy > c AS INT) >= 2", "features"))
def cross_technique_outliers(spark, d):
    f = features(spark, d)
    q = f.groupBy("slide_id").agg(*(F.percentile(k, F.lit(0.75)).alias(f"q_{k}") for k in ("coverage", "edges", "entropy")))
    hits = sum(((F.col(k) > F.col(f"q_{k}")).cast("int") for k in ("edges", "entropy")), (F.col("coverage") > F.col("q_coverage")).cast("int"))
    return f.join(q, "slide_id").withColumn("n", hits).where("n >= 2").select("slide_id", "fov_id", "n")


@query("flag_counters", sql("+ m AS (SELECT slide_id, fov_id, n_detected, median(n_detected) OVER (PARTITION BY slide_id) AS md FROM counts), f AS (SELECT array_to_string(list_filter([CASE WHEN n_detected > 1.5 * md THEN 'high' END, CASE WHEN n_detected < 0.5 * md THEN 'low' END, CASE WHEN n_detected % 2 = 0 THEN 'even' END], lambda x: x IS NOT NULL), ';') AS flags FROM m) SELECT flag, count(*) AS n FROM (SELECT unnest(string_split(flags, ';')) AS flag FROM f WHERE flags <> '') GROUP BY 1", "counts"))
def flag_counters(spark, d):
    c = counts(spark, d)
    m = c.join(c.groupBy("slide_id").agg(F.median("n_detected").alias("md")), "slide_id")
    n = F.col("n_detected")
    f = m.select(robust.flags(("high", n > 1.5 * F.col("md")), ("low", n < 0.5 * F.col("md")), ("even", n % 2 == 0)).alias("flags")).where("flags <> ''")
    return f.select(F.explode(F.split("flags", ";")).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


@query("stage_timings", "SELECT event_type AS stage, min(value) AS fastest, round_even(median(value), 6) AS middle, round_even(max(value) - min(value), 6) AS spread FROM events GROUP BY 1")
def stage_timings(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("stage")).agg(F.min("value").alias("fastest"), r6(F.median("value")).alias("middle"), r6(F.max("value") - F.min("value")).alias("spread"))


@query("protocol_rollup", sql("SELECT coalesce(CAST(second AS VARCHAR), 'all') AS grp, coalesce(CAST(first AS VARCHAR), 'all') AS volume, count(*) AS n, round_even(avg(cents), 3) AS mean FROM axes GROUP BY ROLLUP (second, first)", "axes"))
def protocol_rollup(spark, d):
    r = axes(spark, d).rollup("second", "first").agg(F.count(F.lit(1)).alias("n"), F.bround(F.avg("cents"), 3).alias("mean"))
    return r.select(F.coalesce(F.col("second").cast("string"), F.lit("all")).alias("grp"), F.coalesce(F.col("first").cast("string"), F.lit("all")).alias("volume"), "n", "mean")


@query("class_reference", sql("SELECT round_even(median(coverage), 6) AS coverage, round_even(median(edges), 6) AS edges, round_even(median(entropy), 6) AS entropy FROM features WHERE coverage < 0.45", "features"))
def class_reference(spark, d):
    names = ("coverage", "edges", "entropy")
    long = features(spark, d).where("coverage < 0.45").select(F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.col(k).alias("v")) for k in names))).alias("x")).select("x.name", "x.v")
    mid = quantiles.exact(long, ["name"], "v", {"mid": quantiles.share(0.5)})
    return mid.agg(*(r6(F.max(F.when(F.col("name") == k, F.col("mid")))).alias(k) for k in names))


@query("jitter_places", sql("SELECT slide_id, fov_id, (row_number() OVER (PARTITION BY slide_id, n_detected ORDER BY fov_id) - 1) - (count(*) OVER (PARTITION BY slide_id, n_detected) - 1) / CAST(2 AS DOUBLE) AS shift FROM counts", "counts"))
def jitter_places(spark, d):
    """Where the points of equal value are drawn: side by side around their value."""
    w = Window.partitionBy("slide_id", "n_detected")
    return counts(spark, d).select("slide_id", "fov_id", ((F.row_number().over(w.orderBy("fov_id")) - 1) - (F.count(F.lit(1)).over(w) - 1) / 2).alias("shift"))


@query("least_uniform", sql("SELECT slide_id, fov_id, contrast FROM features ORDER BY contrast DESC NULLS LAST, slide_id, fov_id LIMIT 5", "features"))
def least_uniform(spark, d):
    return features(spark, d).select("slide_id", "fov_id", "contrast").orderBy(F.col("contrast").desc_nulls_last(), "slide_id", "fov_id").limit(5)


@query("missing_first", sql("SELECT slide_id, fov_id, CAST(row_number() OVER (PARTITION BY slide_id ORDER BY contrast ASC NULLS FIRST, fov_id) AS INTEGER) AS place FROM features", "features"))
def missing_first(spark, d):
    return features(spark, d).select("slide_id", "fov_id", F.row_number().over(Window.partitionBy("slide_id").orderBy(F.col("contrast").asc_nulls_first(), "fov_id")).alias("place"))


@query("work_slice", sql("SELECT slide_id, fov_id FROM counts ORDER BY slide_id, fov_id LIMIT 64 OFFSET 100", "counts"))
def work_slice(spark, d):
    return counts(spark, d).select("slide_id", "fov_id").orderBy("slide_id", "fov_id").offset(100).limit(64)


@query("fov_stride", sql("+ r AS (SELECT slide_id, fov_id, row_number() OVER (PARTITION BY slide_id ORDER BY fov_id) - 1 AS k FROM counts) SELECT slide_id, fov_id FROM r WHERE k % 4 = 0 AND k // 4 < 10", "counts"))
def fov_stride(spark, d):
    """Every fourth field of a slide, ten at most."""
    k = F.row_number().over(Window.partitionBy("slide_id").orderBy("fov_id")) - 1
    return counts(spark, d).withColumn("k", k).where("k % 4 = 0 and k < 40").select("slide_id", "fov_id")


ALIASES = {"building": "liberia", "automobile": "lb", "machinery": "tanzania", "household": "tz", "furniture": "uganda"}
COUNTRY = {"liberia": "LB", "lb": "LB", "tanzania": "TZ", "tz": "TZ", "uganda": "UG", "ug": "UG"}


@query("country_alias", "SELECT c_custkey, CASE lower(c_mktsegment) WHEN 'building' THEN 'LB' WHEN 'automobile' THEN 'LB' WHEN 'machinery' THEN 'TZ' WHEN 'household' THEN 'TZ' WHEN 'furniture' THEN 'UG' END AS country FROM customer")
def country_alias(spark, d):
    """Names of a country in any case to its code."""
    m = lambda x: F.create_map(*[y for k, v in x.items() for y in (F.lit(k), F.lit(v))])
    name = F.try_element_at(m(ALIASES), F.lower("c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", F.when(name.isNotNull(), F.try_element_at(m(COUNTRY), name)).alias("country"))


@query("first_box", "SELECT l_partkey AS slide_id, min('box-' || (l_linenumber % 5)) AS box FROM lineitem GROUP BY 1")
def first_box(spark, d):
    """Boxes are probed in order and the first that has the slide is taken."""
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("slide_id")).agg(F.min(F.concat(F.lit("box-"), (F.col("l_linenumber") % 5).cast("string"))).alias("box"))


@query("group_map", "SELECT r_name AS grp, n_nationkey AS slide_id, lower(r_name) || '/' || n_name AS uri FROM nation JOIN region ON n_regionkey = r_regionkey")
def group_map(spark, d):
    """Groups of slides with where each slide lies, as a map for each group and as rows again."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    rows = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("r_name").alias("grp"), "n_nationkey", F.concat_ws("/", F.lower("r_name"), "n_name").alias("uri"))
    maps = rows.groupBy("grp").agg(F.map_from_entries(F.collect_list(F.struct("n_nationkey", "uri"))).alias("slides"))  # a group has few slides
    return maps.select("grp", F.explode("slides").alias("slide_id", "uri"))


@query("quintile_labels", sql("+ q AS (SELECT slide_id, quantile_cont(n_detected::DOUBLE, 0.2::DOUBLE) AS a, quantile_cont(n_detected::DOUBLE, 0.4::DOUBLE) AS b, quantile_cont(n_detected::DOUBLE, 0.6::DOUBLE) AS c, quantile_cont(n_detected::DOUBLE, 0.8::DOUBLE) AS d FROM counts GROUP BY 1) SELECT slide_id, fov_id, CASE WHEN n_detected < a THEN 1 WHEN n_detected < b THEN 2 WHEN n_detected < c THEN 3 WHEN n_detected < d THEN 4 ELSE 5 END AS quintile FROM counts JOIN q USING (slide_id)", "counts"))
def quintile_labels(spark, d):
    c = counts(spark, d)
    q = c.groupBy("slide_id").agg(F.percentile("n_detected", F.array(*map(F.lit, (0.2, 0.4, 0.6, 0.8)))).alias("q"))
    return c.join(q, "slide_id").select("slide_id", "fov_id", (F.size(F.filter("q", lambda t: F.col("n_detected") >= t)) + 1).alias("quintile"))


@query("notes_subsets", sql("SELECT coalesce(lang, 'all') AS subset, count(*) AS n, count(CASE WHEN truth AND predicted THEN 1 END) AS tp, count(CASE WHEN truth AND NOT predicted THEN 1 END) AS fn FROM judged GROUP BY GROUPING SETS ((lang), ())", "judged"))
def notes_subsets(spark, d):
    """Counts for each subset and for all rows in one pass."""
    j = judged(spark, d).groupingSets([[F.col("lang")], []], "lang")
    t, p = F.col("truth"), F.col("predicted")
    return j.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(t & p, 1)).alias("tp"), F.count(F.when(t & ~p, 1)).alias("fn")).select(F.coalesce("lang", F.lit("all")).alias("subset"), "n", "tp", "fn")
