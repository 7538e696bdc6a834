"""Passes that can stop and go on: file streams with checkpoints, and neighbours kept as state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState


def resumable(spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> int:
    """Take whatever files of ``source`` no earlier call has taken, and write what ``work`` makes of them; returns the rows written, as the output's files count them.

    Files already done are known from the checkpoint, so a pass that was cut short goes on where it was.
    """
    before = _rows(spark, out)
    stream = work(spark.readStream.schema(schema).parquet(source))
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return _rows(spark, out) - before


def _rows(spark: SparkSession, path: str) -> int:
    """Rows of the output so far, none where nothing was written yet."""
    try:
        return spark.read.parquet(path).count()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return 0


NEIGHBOURS = "slide_id long, fov_id long, value double, before string, rise double"


def _walk(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = [(int(f), v) for f, v in state.get[0]] if state.exists else []
    rows = pd.concat(list(batches)).sort_values("fov_id")
    out = []
    for fov, value in zip(rows["fov_id"], rows["value"], strict=True):
        out.append((key[0], int(fov), float(value), ",".join(str(f) for f, _ in last), float(value) - max((v for _, v in last), default=float(value))))
        last = [*last, (int(fov), float(value))][-2:]
    state.update(([[float(f), v] for f, v in last],))
    yield pd.DataFrame(out, columns=["slide_id", "fov_id", "value", "before", "rise"])


def stateful_neighbours(stream: DataFrame) -> DataFrame:
    """Each field (slide_id, fov_id, value) with the numbers of the two fields of its slide taken before it, over all batches, and its rise over them."""
    typed = stream.selectExpr("cast(slide_id as long) slide_id", "cast(fov_id as long) fov_id", "cast(value as double) value")
    return typed.groupBy("slide_id").applyInPandasWithState(_walk, NEIGHBOURS, "last array<array<double>>", "append", "NoTimeout")
