"""Tables that stand for slides, fields and tiles over the driver's tables, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def month(col: str):
    return (F.year(col) * 12 + F.month(col)).cast("int")


def counts(spark: SparkSession, d: str) -> DataFrame:
    """Spots of a field: line items of a supplier in a month."""
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("slide_id"), month("l_shipdate").alias("fov_id"))
    return rows.groupBy("slide_id", "fov_id").agg(F.count(F.lit(1)).alias("n_detected"))


def event_counts(spark: SparkSession, d: str) -> DataFrame:
    """Spots of a field: events of a user on a day; some slides have no spread at all."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("slide_id"), F.datediff(F.col("ts"), F.lit("2024-01-01").cast("date")).alias("fov_id"))
    return rows.groupBy("slide_id", "fov_id").agg(F.count(F.lit(1)).alias("n_detected"))


def features(spark: SparkSession, d: str) -> DataFrame:
    """Four signals of a field, as sums of whole cents over counts, and nulls where a seventh of the fields has none."""
    cents = lambda c: F.sum(F.round(F.col(c) * 100).cast("long"))
    n = F.count(F.lit(1))
    rows = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("slide_id"), month("l_shipdate").alias("fov_id"))
    out = rows.agg((cents("l_quantity") / n / 5000).alias("coverage"), (cents("l_extendedprice") / n / 1e7).alias("edges"), (cents("l_discount") / n / 10).alias("entropy"), (cents("l_tax") / n / 8).alias("contrast"))
    return out.withColumn("contrast", F.when((F.col("slide_id") * 31 + F.col("fov_id")) % 7 != 0, F.col("contrast")))


def axes(spark: SparkSession, d: str) -> DataFrame:
    """Two manual ordinals of an order (priority, segment of the customer by region) and a signal."""
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select("o_orderkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("first"), (F.col("n_regionkey") + 1).alias("second"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), F.col("n_name").alias("site"))


def judged(spark: SparkSession, d: str) -> DataFrame:
    """Truth and a rule's verdict of a document."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return docs.join(labels, "doc_id").select("doc_id", "lang", "source", "n_chars", (F.col("quality") == 0).alias("truth"), (F.col("n_chars") > 3000).alias("predicted"), (F.col("toxic") == 1).alias("toxic"), (F.col("n_chars") / 1000).alias("contrast"))


def grids(spark: SparkSession, d: str) -> DataFrame:
    """Grey values of a tile of 8 x 8, row by row: (vec_id, vs)."""
    value = lambda e: F.floor(255 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), e.cast("double") + 0.5))).cast("int")
    return table(spark, d, "embeddings").select("vec_id", F.transform("embedding", value).alias("vs"))


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """The same, a row for each pixel: (vec_id, y, x, v)."""
    rows = grids(spark, d).select("vec_id", F.posexplode("vs").alias("i", "v"))
    return rows.select("vec_id", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), "v")


SQL = {
    "counts": "counts AS (SELECT l_suppkey AS slide_id, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS INTEGER) AS fov_id, count(*) AS n_detected FROM lineitem GROUP BY 1, 2)",
    "event_counts": "event_counts AS (SELECT user_id AS slide_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS fov_id, count(*) AS n_detected FROM events GROUP BY 1, 2)",
    "features": """features AS (
      SELECT slide_id, fov_id, coverage, edges, entropy, CASE WHEN (slide_id * 31 + fov_id) % 7 <> 0 THEN contrast END AS contrast FROM (
        SELECT l_suppkey AS slide_id, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS INTEGER) AS fov_id,
               CAST(sum(CAST(round(l_quantity * 100) AS BIGINT)) AS DOUBLE) / count(*) / 5000 AS coverage, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / CAST(1e7 AS DOUBLE) AS edges,
               CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / count(*) / 10 AS entropy, CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) / count(*) / 8 AS contrast
        FROM lineitem GROUP BY 1, 2))""",
    "axes": """axes AS (SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS first, n_regionkey + 1 AS second, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, n_name AS site
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)""",
    "judged": "judged AS (SELECT doc_id, lang, source, n_chars, quality = 0 AS truth, n_chars > 3000 AS predicted, toxic = 1 AS toxic, CAST(n_chars AS DOUBLE) / 1000 AS contrast FROM documents JOIN labels USING (doc_id))",
    "pixels": """pixels AS (SELECT vec_id, CAST((i - 1) // 8 AS INTEGER) AS y, CAST((i - 1) % 8 AS INTEGER) AS x,
      CAST(floor(255 * least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), CAST(embedding[i] AS DOUBLE) + CAST(0.5 AS DOUBLE)))) AS INTEGER) AS v
      FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings))""",
}


def sql(body: str, *views: str) -> str:
    """A query over some of the stand-in views."""
    return "WITH " + ", ".join(SQL[v] for v in views) + (", " if body.lstrip().startswith("+") else " ") + body.lstrip().removeprefix("+")
