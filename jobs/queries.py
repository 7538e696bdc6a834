"""The jobs as queries: each runs twice into one new folder below the shared one, and what it left is read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.plans import quality_queries
from tilewright.plans.standins import sql
from tilewright.registry import r6
from tilewright.storage import new_path

from . import common, score_slides, watch_texts

_BASE = quality_queries._BASE


#: Six digits, cut where no short fraction lies: scores are sums of such, and halves would be rounded by the last bits of either engine.
_CUT = "floor({} * 1e6::DOUBLE + 0.0137::DOUBLE) / 1e6::DOUBLE"


def _cut(name: str) -> Column:
    return F.floor(F.col(name) * 1e6 + 0.0137) / 1e6


def job1_score_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields and slides of all sites: the whole output after a second run."""
    out = new_path(spark, "score-slides")
    config = common.read_config(spark, score_slides.CONFIG, score_slides.DEFAULTS)
    for _ in range(2):
        score_slides.run(spark, sf_dir, out, config)
    fields, slides = score_slides.read_back(spark, out)
    fields = fields.select(F.lit("field").alias("kind"), "site", "slide_id", "fov_id", _cut("score").alias("score"), "label", "gated", "n_detected", r6("z").alias("z"), "flags")
    slides = slides.select(F.lit("slide").alias("kind"), "site", "slide_id", _cut("mean").alias("score"), F.col("modal").alias("label"), "n_scored", "n_gated", "n_high", "status")
    return fields.unionByName(slides, allowMissingColumns=True)


_JOB1 = (
    quality_queries._SCORE.rstrip()
    + ", "
    + _BASE.format(t="counts").lstrip("+ ")
    + f""", site AS (SELECT s_suppkey AS slide_id, n_name AS site FROM supplier JOIN nation ON s_nationkey = n_nationkey),
 sf AS (SELECT site, s.slide_id, s.fov_id, s.score, s.gated, CASE WHEN s.gated THEN '{quality_queries.LABELS[0]}' ELSE s.raw_label END AS label, CASE WHEN s.gated THEN 1 ELSE s.pos END AS r, f.n_detected, f.z, f.flags FROM g s JOIN site ON site.slide_id = s.slide_id LEFT JOIN f ON f.slide_id = s.slide_id AND f.fov_id = s.fov_id),
 mo AS (SELECT slide_id, arg_min(label, -n * 10 + r) AS modal FROM (SELECT slide_id, label, min(r) AS r, count(*) AS n FROM sf GROUP BY 1, 2) GROUP BY 1),
 pe AS (SELECT slide_id, count(*) AS n_scored, count(CASE WHEN gated THEN 1 END) AS n_gated, avg(CASE WHEN gated THEN 0::DOUBLE ELSE score END) AS mean, count(CASE WHEN list_contains(string_split(flags, ';'), 'high_outlier') THEN 1 END) AS n_high FROM sf GROUP BY 1)
 SELECT 'field' AS kind, site, slide_id, fov_id, {_CUT.format("score")} AS score, label, gated, n_detected, round_even(z, 6) AS z, flags, NULL::BIGINT AS n_scored, NULL::BIGINT AS n_gated, NULL::BIGINT AS n_high, NULL::VARCHAR AS status FROM sf
 UNION ALL SELECT 'slide', site, site.slide_id, NULL, {_CUT.format("mean")}, modal, NULL, NULL, NULL, NULL, n_scored, n_gated, n_high, CASE WHEN n_scored IS NULL THEN 'no_data' WHEN n_gated = n_scored THEN 'empty' ELSE 'ok' END FROM site LEFT JOIN pe ON pe.slide_id = site.slide_id LEFT JOIN mo ON mo.slide_id = site.slide_id"""
)


def job2_watch_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields and sources of all documents: the whole output after a second run, which finds no new file."""
    out = new_path(spark, "watch-texts")
    config = common.read_config(spark, watch_texts.CONFIG, watch_texts.DEFAULTS)
    for _ in range(2):
        watch_texts.run(spark, f"{sf_dir}/documents.parquet", f"{out}/tables", f"{out}/checkpoint", config)
    fields, sources = watch_texts.read_back(spark, f"{out}/tables")
    fields = fields.select(F.lit("field").alias("kind"), "source", "doc_id", "n_detected", "n_lines", F.bround("ratio", 4).alias("ratio"), r6("z").alias("z"), "flags")
    sources = sources.select(F.lit("source").alias("kind"), "source", F.col("n_words").alias("n_detected"), "n_fovs", F.bround("mean", 3).alias("mean"), "median", F.bround("mad", 4).alias("mad"), "n_high", "n_low", "n_bad")
    return fields.unionByName(sources, allowMissingColumns=True)


_JOB2 = """WITH texts AS (SELECT coalesce(source, '') AS slide_id, doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_detected,
   len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]'))) AS n_lines, text IS NULL AS no_text, coalesce(n_chars <> length(coalesce(text, '')), true) AS wrong_length FROM documents), """ + _BASE.format(t="texts").lstrip("+ ") + """,
 fl AS (SELECT *, concat_ws(';', nullif(flags, ''), CASE WHEN no_text THEN 'no_text' WHEN wrong_length THEN 'wrong_length' END) AS all_flags FROM f)
 SELECT 'field' AS kind, nullif(slide_id, '') AS source, doc_id, n_detected::BIGINT AS n_detected, n_lines::BIGINT AS n_lines, round_even(ratio, 4) AS ratio, round_even(z, 6) AS z, all_flags AS flags, NULL::BIGINT AS n_fovs, NULL::DOUBLE AS mean, NULL::DOUBLE AS median, NULL::DOUBLE AS mad, NULL::BIGINT AS n_high, NULL::BIGINT AS n_low, NULL::BIGINT AS n_bad FROM fl
 UNION ALL SELECT 'source', nullif(slide_id, ''), NULL, sum(n_detected)::BIGINT, NULL, NULL, NULL, NULL, any_value(n_fovs), round_even(any_value(mean), 3), any_value(median), round_even(any_value(mad), 4), count(CASE WHEN z >= 2 THEN 1 END), count(CASE WHEN z <= -2 THEN 1 END), count(CASE WHEN no_text OR wrong_length THEN 1 END) FROM fl GROUP BY slide_id"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_score_slides": job1_score_slides, "job2_watch_texts": job2_watch_texts}
SQL: dict[str, str] = {"job1_score_slides": sql(_JOB1, "features", "counts"), "job2_watch_texts": _JOB2}
