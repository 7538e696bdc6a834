"""Streams over files made of the given tables, with the SQL of what they leave."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query, r6
from ..sources import sinks
from ..storage import new_path
from ..streaming import neighbours, passes
from .standins import table

FIELDS = "slide_id long, fov_id long, ts timestamp, value double"


@query("stateful_neighbours", """SELECT user_id AS slide_id, event_id AS fov_id, coalesce(array_to_string(list(event_id) OVER w, ','), '') AS before, round_even(value - coalesce(max(value) OVER w, value), 6) AS rise
 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING)""")
def stateful_neighbours(spark, d):
    """Every event with its user's two events before it, taken from files in an order of arrival up to five days off; two runs, the second of which ends the stream."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("slide_id"), F.col("event_id").alias("fov_id"), "ts", "value")
    src, out, mark = (new_path(spark, x) for x in ("arrivals", "neighbours", "mark"))
    late = 0
    neighbours.arrivals(rows, src, slices=6, spread_days=5)
    # Three batches, whatever number of files the slices have.
    files = max(2, -(-len(sinks._read(spark, src, FIELDS).inputFiles()) // 3))
    late += neighbours.take_all(spark, src, FIELDS, "6 days", out, mark, files=files)
    neighbours.end(spark, src)
    late += neighbours.take_all(spark, src, FIELDS, "6 days", out, mark, files=2)
    if late:
        raise RuntimeError(f"{late} fields came later than the delay allows")
    return spark.read.parquet(out).where("slide_id >= 0").select("slide_id", "fov_id", "before", r6("rise").alias("rise"))


@query("resumed_pass", "SELECT l_suppkey AS slide_id, count(*) AS n, round_even(sum(l_quantity * 2), 2) AS total FROM lineitem GROUP BY 1")
def resumed_pass(spark, d):
    """A pass over files that are added between its runs; each run takes the new ones only."""
    src, out, mark = (new_path(spark, x) for x in ("pass-in", "pass-out", "pass-mark"))
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("slide_id"), F.col("l_orderkey").alias("fov_id"), "l_quantity")
    taken = []
    for part in range(2):
        rows.where(F.col("fov_id") % 2 == part).write.mode("append").parquet(src)
        for _ in range(2):
            taken.append(passes.resumable(spark, src, "slide_id long, fov_id long, l_quantity double", lambda s: s.withColumn("twice", F.col("l_quantity") * 2), out, mark))
    if taken[1] or taken[3]:
        raise RuntimeError("a run without new files took some")
    return spark.read.parquet(out).groupBy("slide_id").agg(F.count(F.lit(1)).alias("n"), F.bround(F.sum("twice"), 2).alias("total"))
