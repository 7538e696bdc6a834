"""Each field with the two before it in time, over a stream whose fields come late and out of order."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ValueState

OUT = "slide_id long, fov_id long, us long, value double, before string, rise double"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Keys that the slides are dealt to; a checkpoint is bound to this number.
BUCKETS = 256
_WAITING = pa.schema([("slide", pa.int64()), ("us", pa.int64()), ("fov", pa.int64()), ("value", pa.float64())])
_LAST = pa.schema([("slide", pa.int64()), ("fov_a", pa.int64()), ("value_a", pa.float64()), ("fov_b", pa.int64()), ("value_b", pa.float64())])


def _packed(columns: list[list], schema: pa.Schema) -> tuple[bytes]:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as out:
        out.write_table(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema))
    return (sink.getvalue().to_pybytes(),)


def _unpacked(state: ValueState) -> list[tuple]:
    if not state.exists():
        return []
    table = pa.ipc.open_stream(state.get()[0]).read_all()
    return list(zip(*(c.to_pylist() for c in table.columns), strict=True))


class Neighbours(StatefulProcessor):
    """Holds the fields of a bucket of slides until the watermark has passed them, then takes each slide's in the order of time and number.

    waiting: fields that may still be preceded by others; last: of each slide, the two fields taken last. Both are
    read and written once for a bucket and batch, not once for a field, and so is the timer, which stands at the
    first waiting field. What is kept is what came within the delay, and two fields of a slide for ever.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "rows binary")
        self.last = handle.getValueState("last", "rows binary")

    def _wait(self, rows: list[tuple], newest: list[tuple]) -> None:
        self.waiting.update(_packed(list(map(list, zip(*rows, strict=True))) or [[]] * 4, _WAITING))
        if newest:
            self.handle.registerTimer(min(r[1] for r in newest) // 1_000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(s, us, f, None if v != v else v) for batch in rows for s, us, f, v in zip(*(batch[c].tolist() for c in ("slide_id", "us", "fov_id", "value")), strict=True)]
        self._wait(_unpacked(self.waiting) + new, new)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        all_ = _unpacked(self.waiting)
        taken = sorted((r for r in all_ if r[1] // 1_000 <= due), key=lambda r: r[:3])  # a field that comes again is a field again
        out = []
        if taken:
            near = {s: [(f, v) for f, v in (a, b) if f is not None] for s, a, b in ((r[0], r[1:3], r[3:5]) for r in _unpacked(self.last))}
            for slide, us, fov, value in taken:
                own = near.get(slide, [])
                top = max((v for _, v in own if v is not None), default=value)
                out.append((slide, fov, us, value, ",".join(str(f) for f, _ in own), None if value is None or top is None else value - top))
                near[slide] = [*own, (fov, value)][-2:]
            pad = [(s, *([(None, None)] * (2 - len(own)) + own)) for s, own in near.items()]
            self.last.update(_packed([[p[0] for p in pad], *([p[i][j] for p in pad] for i in (1, 2) for j in (0, 1))], _LAST))
            left = [r for r in all_ if r[1] // 1_000 > due]
            self._wait(left, left)
        yield pd.DataFrame(out, columns=["slide_id", "fov_id", "us", "value", "before", "rise"])

    def close(self) -> None:
        pass


def ordered_neighbours(stream: DataFrame, delay: str) -> DataFrame:
    """(slide_id, fov_id, ts, value) with before, the numbers of the two fields of its slide before it in time, and its rise over them.

    Fields may come in any order and up to ``delay`` after later ones; each comes out once, when no earlier
    one can come any more. Fields that come later still are dropped, and the stream's progress counts them.
    Fields without slide, number or time, or of a time beyond the year 2261, have no place and are left
    out; a null value has no rise.
    """
    typed = stream.selectExpr("cast(slide_id as long) slide_id", "cast(fov_id as long) fov_id", "cast(ts as timestamp) ts", "cast(value as double) value").withColumn("us", F.unix_micros("ts"))
    timed = typed.where("slide_id is not null and fov_id is not null and ts between timestamp'1700-01-01' and timestamp'2261-12-31'").withWatermark("ts", delay)
    out = timed.withColumn("_bucket", F.pmod(F.xxhash64("slide_id"), F.lit(BUCKETS))).groupBy("_bucket").transformWithStateInPandas(Neighbours(), OUT, "Append", "EventTime")
    return out.select("slide_id", "fov_id", F.timestamp_micros("us").alias("ts"), "value", "before", "rise")


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that state with timers needs, for the streams started inside; the setting is put back."""
    old = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if old is None else spark.conf.set(PROVIDER, old)


def take_all(spark: SparkSession, source: str, schema: str, delay: str, out: str, checkpoint: str, files: int = 1) -> int:
    """Take the files of ``source`` that no earlier call took, ``files`` at a time, and add the fields that are due to ``out``; returns how many came too late."""
    with state_store(spark):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
        q = ordered_neighbours(stream, delay).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    return sum(int(s.get("numRowsDroppedByWatermark", 0)) for p in q.recentProgress for s in p["stateOperators"])


def end_of_stream() -> str:
    """SQL for the row (slide_id, fov_id, ts, value) that ends a stream: its time passes all others, so all that waits comes out."""
    return "SELECT CAST(-1 AS LONG) AS slide_id, CAST(-1 AS LONG) AS fov_id, TIMESTAMP '2200-01-01' AS ts, CAST(NULL AS DOUBLE) AS value"


def end(spark: SparkSession, folder: str) -> None:
    spark.sql(end_of_stream()).coalesce(1).write.mode("append").parquet(folder)


def arrivals(rows: DataFrame, folder: str, slices: int, spread_days: int) -> None:
    """Write ``rows`` as files in an order of arrival that is up to ``spread_days`` days off their times; no rows, no files."""
    late = F.pmod(F.xxhash64("slide_id", "fov_id"), F.lit(spread_days * 86_400))
    timed = rows.withColumn("_at", F.unix_timestamp("ts") + late)
    low, high = timed.agg(F.min("_at"), F.max("_at")).head()
    width = max(1, -(-(high + 1 - low) // slices)) if low is not None else 1
    for k in range(slices if low is not None else 0):
        timed.where((F.col("_at") >= low + k * width) & (F.col("_at") < low + (k + 1) * width)).drop("_at").write.mode("append").parquet(folder)
