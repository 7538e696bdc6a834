"""Joins, neighbours, sampling, names and sources on the stand-in tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import robust, text
from ..operators import ordered, relational
from ..registry import query
from .standins import counts, features, sql, table


@query("nearest_control", sql("""+ r AS (SELECT slide_id, fov_id, n_detected FROM counts WHERE fov_id % 5 = 0), c AS (SELECT slide_id, fov_id AS control, n_detected AS v FROM counts WHERE fov_id % 5 <> 0),
 p AS (SELECT r.slide_id, r.fov_id, c.control, CAST(abs(r.n_detected - c.v) AS DOUBLE) AS distance, row_number() OVER (PARTITION BY r.slide_id, r.fov_id ORDER BY abs(r.n_detected - c.v), c.control) AS k FROM r JOIN c USING (slide_id))
 SELECT slide_id, fov_id, control, distance FROM p WHERE k = 1""", "counts"))
def nearest_control(spark, d):
    c = counts(spark, d)
    return relational.nearest(c.where("fov_id % 5 = 0"), c.where("fov_id % 5 <> 0"), "n_detected", "fov_id", ["slide_id"])


@query("neighbor_range_window", sql("SELECT slide_id, fov_id, coalesce(array_to_string(list(fov_id) OVER w, ','), '') AS before, coalesce(max(n_detected) OVER w, -1) AS top FROM event_counts WINDOW w AS (PARTITION BY slide_id ORDER BY fov_id RANGE BETWEEN 2 PRECEDING AND 1 PRECEDING)", "event_counts"))
def neighbor_range_window(spark, d):
    from .standins import event_counts

    n = relational.id_neighbours(event_counts(spark, d), "slide_id", "fov_id", ["n_detected"])
    return n.select("slide_id", "fov_id", F.array_join(F.transform("neighbours", lambda x: x["fov_id"].cast("string")), ",").alias("before"), F.coalesce(F.array_max(F.transform("neighbours", lambda x: x["n_detected"])), F.lit(-1)).alias("top"))


@query("neighbor_row_window", sql("SELECT slide_id, fov_id, coalesce(array_to_string(list(fov_id) OVER w, ','), '') AS before FROM event_counts WINDOW w AS (PARTITION BY slide_id ORDER BY fov_id ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING)", "event_counts"))
def neighbor_row_window(spark, d):
    from .standins import event_counts

    n = relational.row_neighbours(event_counts(spark, d), "slide_id", "fov_id", ["n_detected"])
    return n.select("slide_id", "fov_id", F.array_join(F.transform("neighbours", lambda x: x["fov_id"].cast("string")), ",").alias("before"))


@query("theta_contains", "WITH w AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS needle FROM part) SELECT needle, count(*) AS n, min(p_partkey) AS low FROM part JOIN w ON contains(p_name, needle) WHERE needle <> '' GROUP BY 1")
def theta_contains(spark, d):
    """Names that contain a needle, for all needles there are: an equi-join on pieces of the names."""
    p = table(spark, d, "part")
    met = relational.containing(p, "p_name", p.select(F.split("p_name", " ")[1].alias("needle")), "needle")
    return met.groupBy("needle").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("low"))


@query("fallback_source", """WITH a AS (SELECT doc_id, CAST(quality AS BIGINT) AS value, 'labels' AS source FROM labels), b AS (SELECT doc_id, n_chars AS value, 'measured' AS source FROM documents WHERE n_chars > 500), c AS (SELECT doc_id, CAST(NULL AS BIGINT) AS value, 'none' AS source FROM documents)
 SELECT * FROM a UNION ALL SELECT * FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a) UNION ALL SELECT * FROM c WHERE doc_id NOT IN (SELECT doc_id FROM a) AND doc_id NOT IN (SELECT doc_id FROM b)""")
def fallback_source(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    parts = [("labels", labels.select("doc_id", F.col("quality").cast("long").alias("value"))), ("measured", docs.where("n_chars > 500").select("doc_id", F.col("n_chars").alias("value"))), ("none", docs.select("doc_id", F.lit(None).cast("long").alias("value")))]
    return relational.first_source(parts, "doc_id").select("doc_id", "value", "source")


@query("self_pairs", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name")
def self_pairs(spark, d):
    n = table(spark, d, "nation")
    a, b = n.select("n_regionkey", F.col("n_name").alias("a")), n.select("n_regionkey", F.col("n_name").alias("b"))
    return a.join(b, "n_regionkey").where("a < b").select("a", "b")


@query("patch_column", sql("SELECT slide_id, fov_id, CASE WHEN fov_id % 4 = 0 THEN coverage * 2 ELSE edges END AS edges FROM features", "features"))
def patch_column(spark, d):
    f = features(spark, d)
    variant = f.where("fov_id % 4 = 0").select("slide_id", "fov_id", (F.col("coverage") * 2).alias("edges"))
    return relational.patch_column(f, variant, ["slide_id", "fov_id"], "edges").select("slide_id", "fov_id", "edges")


@query("set_overlap", "WITH a AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 48), b AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 48) SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'only_a', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'only_b', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT 'all', count(*) FROM (SELECT * FROM a UNION ALL SELECT * FROM b)")
def set_overlap(spark, d):
    l = table(spark, d, "lineitem").where("l_quantity > 48")  # noqa: E741
    a, b = (l.where(F.col("l_returnflag") == x).select(F.col("l_suppkey").alias("k")).distinct() for x in "AR")
    size = lambda df, name: df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"))
    return size(a.intersect(b), "both").unionByName(size(a.subtract(b), "only_a")).unionByName(size(b.subtract(a), "only_b")).unionByName(size(a.unionByName(b), "all"))


@query("unmatched_slides", "SELECT s_suppkey AS slide_id FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_discount > 0.09 AND l_quantity > 49 AND l_tax > 0.06)")
def unmatched_slides(spark, d):
    used = table(spark, d, "lineitem").where("l_discount > 0.09 and l_quantity > 49 and l_tax > 0.06").select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, d, "supplier").join(used, "s_suppkey", "left_anti").select(F.col("s_suppkey").alias("slide_id"))


@query("quantile_bins", "WITH x AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) AS k FROM orders), n AS (SELECT count(*) AS n FROM orders), w AS (SELECT b AS bin, CAST(round_even(b * n / CAST(5 AS DOUBLE), 0) AS BIGINT) + 1 AS k FROM n, (SELECT unnest([1, 2, 3, 4]) AS b)) SELECT bin, v AS edge FROM x JOIN w USING (k)")
def quantile_bins(spark, d):
    return relational.nearest_index_edges(table(spark, d, "orders"), "o_totalprice", 5)


@query("stratified_even_sample", sql("""+ r AS (SELECT slide_id, fov_id, n_detected, row_number() OVER (PARTITION BY slide_id ORDER BY n_detected, fov_id) - 1 AS k, count(*) OVER (PARTITION BY slide_id) AS n FROM counts), w AS (SELECT unnest(range(0, 7)) AS i)
 SELECT DISTINCT slide_id, fov_id, n_detected FROM r, w WHERE n <= 7 OR k = (2 * i + 1) * n // 14""", "counts"))
def stratified_even_sample(spark, d):
    return relational.even_sample(counts(spark, d), ["slide_id"], F.struct("n_detected", "fov_id"), 7)


@query("seeded_sample", sql("+ r AS (SELECT *, row_number() OVER (PARTITION BY slide_id ORDER BY md5(slide_id || '/' || fov_id || '/42'), slide_id, fov_id) AS k FROM counts) SELECT slide_id, fov_id, n_detected FROM r WHERE k <= 20", "counts"))
def seeded_sample(spark, d):
    return relational.seeded_sample(counts(spark, d), ["slide_id"], ["slide_id", "fov_id"], 20, 42)


@query("best_per_bin", sql("SELECT slide_id % 10 AS bin, arg_min(fov_id, [-n_detected, fov_id]) AS fov_id, max(n_detected) AS n_detected FROM counts GROUP BY 1", "counts"))
def best_per_bin(spark, d):
    return relational.best_per(counts(spark, d).withColumn("bin", F.col("slide_id") % 10), ["bin"], "n_detected", "fov_id")


@query("topk", sql("SELECT slide_id, fov_id, n_detected FROM counts ORDER BY n_detected DESC, slide_id, fov_id LIMIT 15", "counts"))
def topk(spark, d):
    return counts(spark, d).orderBy(F.col("n_detected").desc(), "slide_id", "fov_id").limit(15)


@query("percentile_position", sql("+ s AS (SELECT slide_id, sum(n_detected)::BIGINT AS n FROM counts GROUP BY 1) SELECT slide_id, n, round_even(percent_rank() OVER (ORDER BY n) * 100, 4) AS position FROM s", "counts"))
def percentile_position(spark, d):
    s = counts(spark, d).groupBy("slide_id").agg(F.sum("n_detected").alias("n"))
    at = robust.places(s, "n").select("n", "before")
    others = F.nullif(F.lit(s.count() - 1), F.lit(0))
    return s.join(at, "n").select("slide_id", "n", F.bround(F.coalesce(F.col("before") / others, F.lit(0.0)) * 100, 4).alias("position"))


@query("rolling_eta", sql("SELECT slide_id, fov_id, round_even(avg(CAST(n_detected AS DOUBLE)) OVER (PARTITION BY slide_id ORDER BY fov_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) * (count(*) OVER (PARTITION BY slide_id) - row_number() OVER (PARTITION BY slide_id ORDER BY fov_id)), 5) AS eta FROM counts", "counts"))
def rolling_eta(spark, d):
    w = Window.partitionBy("slide_id").orderBy("fov_id")
    left = F.count(F.lit(1)).over(Window.partitionBy("slide_id")) - F.row_number().over(w)
    return counts(spark, d).select("slide_id", "fov_id", F.bround(F.avg(F.col("n_detected").cast("double")).over(w.rowsBetween(-9, 0)) * left, 5).alias("eta"))


@query("loso_folds", sql("+ s AS (SELECT DISTINCT slide_id FROM counts) SELECT slide_id, CAST(dense_rank() OVER (ORDER BY slide_id) - 1 AS INTEGER) AS fold FROM s", "counts"))
def loso_folds(spark, d):
    s = counts(spark, d).select("slide_id").distinct()
    return ordered.numbered(s, [], ["slide_id"]).select("slide_id", (F.col("number") - 1).cast("int").alias("fold"))


@query("nearest_anywhere", """WITH a AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS v FROM orders), r AS (SELECT * FROM a WHERE o_orderkey % 11 = 0), c AS (SELECT v, min(o_orderkey) AS control FROM a WHERE o_orderkey % 11 <> 0 GROUP BY 1),
 lo AS (SELECT r.o_orderkey, r.v, c.control, r.v - c.v AS d FROM r ASOF LEFT JOIN c ON r.v >= c.v), hi AS (SELECT r.o_orderkey, c.control, c.v - r.v AS d FROM r ASOF LEFT JOIN c ON r.v <= c.v)
 SELECT o_orderkey, CASE WHEN hi.d IS NULL OR lo.d < hi.d OR (lo.d = hi.d AND lo.control <= hi.control) THEN lo.control ELSE hi.control END AS control, CAST(least(lo.d, hi.d) AS DOUBLE) AS distance FROM lo JOIN hi USING (o_orderkey)""")
def nearest_anywhere(spark, d):
    """For every eleventh order the other order of nearest price, among all orders: one group of all rows."""
    o = table(spark, d, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("v"))
    return ordered.nearest(o.where("o_orderkey % 11 = 0"), o.where("o_orderkey % 11 <> 0"), "v", "o_orderkey").select("o_orderkey", "control", "distance")


TYPES = ("ECONOMY", "STANDARD", "PROMO", "LARGE")


@query("tag_parse", "WITH t AS (SELECT p_partkey, list_filter(list_transform(string_split(p_type || ' , ' || replace(p_name, ' ', ',') || ',' || p_brand, ','), lambda x: trim(x)), lambda x: x <> '') AS tags FROM part) SELECT p_partkey, coalesce(list_filter(tags, lambda x: x IN ('small', 'large', 'red', 'blue', 'green'))[-1], 'plain') AS level, len(tags)::INTEGER AS n, list_contains(tags, 'Brand#2') AS flagged FROM t")
def tag_parse(spark, d):
    t = table(spark, d, "part").withColumn("tags", text.tags(F.concat("p_type", F.lit(" , "), F.replace("p_name", F.lit(" "), F.lit(",")), F.lit(","), "p_brand")))
    return t.select("p_partkey", text.last_level(F.col("tags"), ("small", "large", "red", "blue", "green"), "plain").alias("level"), F.size("tags").alias("n"), F.array_contains("tags", "Brand#2").alias("flagged"))


@query("slide_from_name", "SELECT s_name, CASE WHEN regexp_extract(s_name, '#0*([1-9][0-9]?)', 1) = '' THEN s_name ELSE regexp_extract(s_name, '#0*([1-9][0-9]?)', 1) END AS by_pattern, split_part(replace(s_name, '#', '_'), '_', 1) AS by_prefix, regexp_replace(s_name, '[^A-Za-z0-9_.-]', '_', 'g') AS cache FROM supplier")
def slide_from_name(spark, d):
    n = F.col("s_name")
    return table(spark, d, "supplier").select("s_name", text.slide_by_pattern(n, "#0*([1-9][0-9]?)").alias("by_pattern"), text.slide_by_prefix(F.replace(n, F.lit("#"), F.lit("_"))).alias("by_prefix"), text.cache_name(n).alias("cache"))


@query("raster_decode", "WITH p AS (SELECT p_partkey, p_size AS fov, 3 AS rows, p_partkey % 7 + 10 AS cols FROM part), q AS (SELECT *, CASE WHEN (fov - 1) // cols < rows THEN cols WHEN (fov - 1) // 18 < rows AND (fov - 1) % 18 < cols THEN 18 END AS w FROM p) SELECT p_partkey, CAST((fov - 1) // w AS INTEGER) AS r, CAST((fov - 1) % w AS INTEGER) AS c, printf('IMG%03dx%03d.bmp', CAST((fov - 1) // w AS INTEGER), CAST((fov - 1) % w AS INTEGER)) AS name FROM q WHERE w IS NOT NULL")
def raster_decode(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").alias("fov"), (F.col("p_partkey") % 7 + 10).cast("int").alias("cols"))
    at = p.withColumn("at", text.raster(F.col("fov"), F.lit(3), F.col("cols"))).where("at is not null")
    return at.select("p_partkey", F.col("at.row").alias("r"), F.col("at.col").alias("c"), text.tile_name(F.col("at")).alias("name"))


@query("json_props", "SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k FROM events GROUP BY 1")
def json_props(spark, d):
    k = F.from_json("props", T.StructType([T.StructField("k", T.LongType())]))["k"]
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("k"))


@query("catalog_dedup", "SELECT l_orderkey, arg_min(l_suppkey, [CAST(l_linenumber AS BIGINT), l_partkey, l_suppkey]) AS slide_id, min(l_linenumber) AS line FROM lineitem GROUP BY 1")
def catalog_dedup(spark, d):
    first = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_suppkey", first).alias("slide_id"), F.min("l_linenumber").alias("line"))


@query("box_map", "SELECT l_partkey AS slide_id, max('box-' || (l_linenumber % 5)) AS box, count(DISTINCT l_linenumber % 5) > 1 AS collided FROM lineitem GROUP BY 1")
def box_map(spark, d):
    """The later box wins where a slide lies in several."""
    b = F.col("l_linenumber") % 5
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("slide_id")).agg(F.max(F.concat(F.lit("box-"), b.cast("string"))).alias("box"), (F.count_distinct(b) > 1).alias("collided"))


@query("resume_plan", sql("+ done AS (SELECT slide_id, count(*) AS n FROM counts WHERE n_detected > 3 GROUP BY 1), want AS (SELECT slide_id, count(*) AS n FROM counts GROUP BY 1) SELECT w.slide_id, w.n FROM want w WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.slide_id = w.slide_id AND d.n = w.n)", "counts"))
def resume_plan(spark, d):
    """Slides without a finished output: an anti-join on the slide and its expected row count."""
    c = counts(spark, d)
    n = lambda df: df.groupBy("slide_id").agg(F.count(F.lit(1)).alias("n"))
    return n(c).join(n(c.where("n_detected > 3")), ["slide_id", "n"], "left_anti")


@query("error_routing", sql("+ e AS (SELECT slide_id, count(*) AS n, count(CASE WHEN n_detected <= 3 THEN 1 END) AS errors FROM counts GROUP BY 1) SELECT slide_id, n, errors, errors > greatest(3, 0.05 * n) AS failed FROM e", "counts"))
def error_routing(spark, d):
    e = counts(spark, d).groupBy("slide_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("n_detected") <= 3, 1)).alias("errors"))
    return e.withColumn("failed", F.col("errors") > F.greatest(F.lit(3.0), 0.05 * F.col("n")))
