"""Takes in new texts and keeps each source's outliers up to date.

    python -m jobs.watch_texts --documents DIR --out DIR --checkpoint DIR [--config FILE]

A source stands for a slide and a text for one of its fields: a text's number of words is held against
its source's median and scaled deviation, as the spots of a field are against its slide's. The job reads
each file of the input once, whatever number of runs it takes: a file stream with a checkpoint knows
which files were taken. Of every batch

1. ``measures`` gets a row for each text, in the partition of its source and batch, so a batch that is taken
   again replaces itself;
2. ``fields`` and ``sources`` are written again for the sources that the batch has texts of, from all
   measures of those sources, and no other partition is touched.

A run without new files changes nothing; one that was cut short goes on with the batch it was at.
"""

from __future__ import annotations

import argparse
import logging
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import robust

from . import common

LOG = logging.getLogger("jobs.watch_texts")
CONFIG = str(Path(__file__).with_name("watch_texts.json"))
DEFAULTS: dict[str, Any] = {"outlier": 2.0, "small": 20, "files_at_once": 1000}
MEASURES = "doc_id long, n_detected long, n_lines long, wrong_length boolean, no_text boolean, source string, taken long"
FIELDS = "doc_id long, n_detected long, n_lines long, ratio double, z double, flags string, source string"
SOURCES = "n_fovs long, n_words long, mean double, median double, mad double, n_high long, n_low long, n_bad long, source string"


def measured(documents: DataFrame) -> DataFrame:
    """Rows of MEASURES but taken: words, lines, and whether the stated length is wrong; a null text has none of either. A null and an empty source are one."""
    text = F.coalesce("text", F.lit(""))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    wrong = F.coalesce(F.col("n_chars") != F.length(text), F.lit(True))
    return documents.select("doc_id", count(r"[^\x20\x09-\x0D]+").alias("n_detected"), count(r"[^\s][^\n]*").alias("n_lines"), wrong.alias("wrong_length"), F.col("text").isNull().alias("no_text"), F.nullif("source", F.lit("")).alias("source"))


def judged(measures: DataFrame, config: Mapping[str, Any]) -> DataFrame:
    """Rows of FIELDS and the baseline: each text against all texts of its source."""
    rows = measures.withColumn("source", F.coalesce("source", F.lit("")))
    rows = robust.scored(rows, slide="source", threshold=float(config["outlier"]), small=int(config["small"]))
    own = robust.flags(("no_text", F.col("no_text")), ("wrong_length", F.col("wrong_length") & ~F.col("no_text")))
    return rows.withColumn("flags", F.concat_ws(";", F.nullif("flags", F.lit("")), F.nullif(own, F.lit(""))))


def summed(fields: DataFrame) -> DataFrame:
    """Rows of SOURCES from judged fields."""
    n = lambda flag: F.count(F.when(robust.has_flag(F.col("flags"), flag), 1))
    base = ("n_fovs", "mean", "median", "mad")
    per = fields.groupBy("source").agg(*(F.first(c).alias(c) for c in base), F.sum("n_detected").alias("n_words"), n("high_outlier").alias("n_high"), n("low_outlier").alias("n_low"), (n("no_text") + n("wrong_length")).alias("n_bad"))
    return per.select("n_fovs", "n_words", "mean", "median", "mad", "n_high", "n_low", "n_bad", "source")


def take(batch: DataFrame, number: int, out: str, config: Mapping[str, Any]) -> dict[str, int]:
    """One batch of measured texts: its measures, then all that hangs on its sources; taken again, it leaves the same."""
    spark = batch.sparkSession
    if batch.isEmpty():
        return {"texts": 0, "fields": 0, "sources": 0}
    counts = {"texts": common.write_counted(batch.withColumn("taken", F.lit(number)), f"{out}/measures", ["source", "taken"], LOG)}
    # Measures of later batches are those of an earlier checkpoint and do not count.
    known = spark.read.schema(MEASURES).parquet(f"{out}/measures").where(F.col("taken") <= number)
    touched = known.where(F.col("taken") == number).select(F.col("source").alias("s")).distinct()
    rows = judged(known.join(touched, F.col("source").eqNullSafe(F.col("s")), "left_semi"), config)
    # The empty name goes to the partition for none.
    counts["fields"] = common.write_counted(rows.select("doc_id", "n_detected", "n_lines", "ratio", "z", "flags", "source"), f"{out}/fields", ["source"], LOG)
    counts["sources"] = common.write_counted(summed(rows), f"{out}/sources", ["source"], LOG)
    return counts


def pattern_of(path: str) -> str:
    """A pattern that ``path`` alone matches: a file stream takes folders and patterns, and a pattern may also match a single file."""
    path = path.rstrip("/")
    return path if path[-1] in "*]}?" else f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, documents: str, out: str, checkpoint: str, config: Mapping[str, Any]) -> dict[str, int]:
    """Take all files of ``documents`` that no run with this checkpoint has taken, and wait until they are; returns sums over the batches."""
    config = {**DEFAULTS, **config}
    total = {"batches": 0, "texts": 0, "fields": 0, "sources": 0}

    def each(batch: DataFrame, number: int) -> None:
        got = take(batch, number, out, config)
        LOG.info("batch %d: read %d texts of %s", number, got["texts"], documents)
        for k, n in {"batches": 1, **got}.items():
            total[k] += n

    schema = spark.read.parquet(documents).select("doc_id", "text", "source", "n_chars").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", int(config["files_at_once"])).parquet(pattern_of(documents))
    started = measured(stream).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    started.awaitTermination()
    LOG.info("%(batches)d batches: read %(texts)d texts, wrote %(fields)d fields of %(sources)d sources", total)
    return total


def read_back(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """The fields and the sources as they stand."""
    return spark.read.schema(FIELDS).parquet(f"{out}/fields"), spark.read.schema(SOURCES).parquet(f"{out}/sources")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="watch_texts", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--documents", required=True, help="folder or pattern of Parquet files to which new ones are added")
    parser.add_argument("--out", required=True, help="folder of the output")
    parser.add_argument("--checkpoint", required=True, help="folder of the stream's checkpoint")
    parser.add_argument("--config", default=CONFIG, help="JSON file with outlier, small, files_at_once")
    common.main(lambda spark, a: run(spark, a.documents, a.out, a.checkpoint, common.read_config(spark, a.config, DEFAULTS)), parser, argv)


if __name__ == "__main__":
    main()
