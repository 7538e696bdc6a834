"""Scores every field of the slides and sums the slides up, site by site.

    python -m jobs.score_slides --tables DIR --out DIR [--config FILE]

What a site is sent after a scan: ``fields`` has the score, the label after the empty-field gate and
the outlier flags of each field, ``slides`` a row for each slide of the catalogue with its mean score, most
frequent label, outliers and status; both are partitioned by site. A run replaces the partitions of the
sites it was asked for (``sites`` in the configuration; none: all) and no others, and a run over the same
tables writes the same rows, so a run that was cut short is simply run again.
"""

from __future__ import annotations

import argparse
import logging
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import robust, scoring
from tilewright.operators import relational
from tilewright.plans import standins

from . import common

LOG = logging.getLogger("jobs.score_slides")
CONFIG = str(Path(__file__).with_name("score_slides.json"))
DEFAULTS: dict[str, Any] = {"weights": {}, "ranges": {}, "thresholds": [], "floors": {}, "outlier": 2.0, "sites": []}
FIELDS = "slide_id long, fov_id int, score double, label string, gated boolean, n_detected long, z double, flags string, site string"
SLIDES = "slide_id long, n_scored long, n_gated long, mean double, modal string, n_high long, status string, site string"


def catalogue(spark: SparkSession, tables: str, sites: list[str]) -> DataFrame:
    """(slide_id, site) of the slides of the wanted sites; a site that no slide has is an error."""
    slides = standins.table(spark, tables, "supplier").join(standins.table(spark, tables, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    slides = slides.select(F.col("s_suppkey").alias("slide_id"), F.col("n_name").alias("site"))
    if not sites:
        return slides
    some = slides.where(F.col("site").isin(sites))
    if missing := sorted(set(sites) - {r.site for r in some.select("site").distinct().collect()}):
        raise ValueError(f"no slides of: {', '.join(missing)}")
    return some


def scored_fields(spark: SparkSession, tables: str, slides: DataFrame, config: Mapping[str, Any]) -> DataFrame:
    """Rows of FIELDS: every field of the slides with signals, and with its outlier flags among its slide's fields."""
    signals = standins.features(spark, tables).join(slides, "slide_id")
    spots = robust.scored(standins.counts(spark, tables).join(slides.select("slide_id"), "slide_id"), threshold=float(config["outlier"])).select("slide_id", "fov_id", "n_detected", "z", "flags")
    cols = {k: F.col(k) for k in config["weights"]}
    labels = scoring.DENSITY_LEVELS
    score = scoring.weighted(cols, config["weights"], {k: tuple(v) for k, v in config["ranges"].items()})
    rows = signals.withColumn("score", score).withColumn("gated", scoring.gate_fired(cols, config["floors"]))
    label = F.when(F.col("gated"), F.lit(labels[0])).otherwise(scoring.bucket(F.col("score"), config["thresholds"], labels))
    return rows.withColumn("label", label).join(spots, ["slide_id", "fov_id"], "left").select("slide_id", "fov_id", "score", "label", "gated", "n_detected", "z", "flags", "site")


def slide_rows(slides: DataFrame, fields: DataFrame) -> DataFrame:
    """Rows of SLIDES: a gated field counts as score 0; slides of the catalogue without fields have the status no_data."""
    score = F.when(F.col("gated"), 0.0).otherwise(F.col("score"))
    per = fields.groupBy("slide_id").agg(F.count(F.lit(1)).alias("n_scored"), F.count(F.when(F.col("gated"), 1)).alias("n_gated"), F.avg(score).alias("mean"), F.count(F.when(robust.has_flag(F.col("flags"), "high_outlier"), 1)).alias("n_high"))
    modal = relational.modal(fields, ["slide_id"], "label", scoring.ordinal(F.col("label"), scoring.DENSITY_LEVELS))
    rows = slides.join(per, "slide_id", "left").join(modal, "slide_id", "left")
    status = F.when(F.col("n_scored").isNull(), "no_data").when(F.col("n_gated") == F.col("n_scored"), "empty").otherwise("ok")
    return rows.select("slide_id", "n_scored", "n_gated", "mean", "modal", "n_high", status.alias("status"), "site")


def run(spark: SparkSession, tables: str, out: str, config: Mapping[str, Any]) -> dict[str, int]:
    """Write ``fields`` and ``slides`` below ``out``; returns the numbers of rows written. Slides are summed up from the fields as written."""
    config = {**DEFAULTS, **config}
    slides = catalogue(spark, tables, list(config["sites"]))
    LOG.info("read %d slides of %s from %s", slides.count(), ", ".join(config["sites"]) or "all sites", tables)
    fields = common.write_counted(scored_fields(spark, tables, slides, config), f"{out}/fields", ["site"], LOG)
    mine = spark.read.schema(FIELDS).parquet(f"{out}/fields").join(F.broadcast(slides.select("site").distinct()), "site", "left_semi")  # a row for each site
    return {"fields": fields, "slides": common.write_counted(slide_rows(slides, mine), f"{out}/slides", ["site"], LOG)}


def read_back(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """The fields and the slides as they stand."""
    return spark.read.schema(FIELDS).parquet(f"{out}/fields"), spark.read.schema(SLIDES).parquet(f"{out}/slides")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="score_slides", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--tables", required=True, help="folder of the tables")
    parser.add_argument("--out", required=True, help="folder of the output")
    parser.add_argument("--config", default=CONFIG, help="JSON file with weights, ranges, thresholds, floors, outlier, sites")
    common.main(lambda spark, a: run(spark, a.tables, a.out, common.read_config(spark, a.config, DEFAULTS)), parser, argv)


if __name__ == "__main__":
    main()
