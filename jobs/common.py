"""What the jobs share: configuration, logging, counted writes, and the session of a command line."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable, Mapping, Sequence
from pathlib import Path
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def read_config(spark: SparkSession, path: str, known: Mapping[str, Any]) -> dict[str, Any]:
    """The JSON file at ``path`` over the defaults in ``known``; a name that is not known is an error.

    A plain path is one of the driver's machine, which executors need not see; a path with a scheme is read by Spark.
    """
    given = json.loads(spark.read.text(path, wholetext=True).head()[0] if "://" in path else Path(path).read_text("utf-8"))
    if extra := sorted(set(given) - set(known)):
        raise ValueError(f"{path}: unknown settings: {', '.join(extra)}")
    return {**known, **given}


def write_counted(rows: DataFrame, path: str, by: Sequence[str], log: logging.Logger) -> int:
    """Replace the partitions of ``path`` that ``rows`` has rows for; returns how many rows were written.

    The rebalance hint brings the rows of a partition together in files of even size and splits a
    large one among tasks. Partitions go by the option of this write, so no setting of the session changes.
    """
    seen = Observation()
    out = rows.observe(seen, F.count(F.lit(1)).alias("n")).hint("rebalance", *by)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    try:
        n = int(seen.get["n"])
    except Py4JJavaError:  # a plan that is known to be empty is not run, so there is nothing to see
        n = 0
    log.info("wrote %d rows to %s", n, path)
    return n


def main(run: Callable[[SparkSession, argparse.Namespace], Any], parser: argparse.ArgumentParser, argv: Sequence[str] | None = None) -> None:
    """Parse the command line, run with a session of its own and stop it."""
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(levelname)s %(message)s")
    spark = SparkSession.builder.appName(parser.prog).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, args)
    finally:
        spark.stop()
