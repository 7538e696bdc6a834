"""File contents fetched by the tasks, with retries: what stays unreadable is a row with an error."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..storage import filesystem
from .sinks import Committed


def retrying(call: Callable, *args, attempts: int = 3, delay: float = 1.0, transient: tuple[type[BaseException], ...] = (OSError, TimeoutError), final: tuple[type[BaseException], ...] = (PermissionError,), sleep: Callable[[float], None] = time.sleep):
    """``call(*args)``, tried again after a transient failure; waits double from ``delay``, with up to half a second of jitter.

    ``final`` failures are not tried again though they may be of a transient kind. A file that is not
    found is tried again: listings have proved it is there, so the cause is a short read.
    """
    if attempts < 1:
        raise ValueError("at least one attempt is needed")
    for left in range(attempts - 1, -1, -1):
        try:
            return call(*args)
        except final:
            raise
        except transient:
            if not left:
                raise
        sleep(delay * 2 ** (attempts - 1 - left) + random.uniform(0, 0.5))
    return None


def read_whole(path: str) -> bytes:
    fs, name = filesystem(path)
    with fs.open_input_file(name) as f:
        size, content = f.size(), f.read()
    if len(content) < size:
        raise FileNotFoundError(f"short read of {path}")
    return content


def fetch(listing: DataFrame, path: str = "path", read: Callable[[str], bytes] = read_whole, attempts: int = 3, delay: float = 1.0) -> DataFrame:
    """All columns of ``listing``, the content of the file at each path, and error: null, or why there is no content.

    Only the read is tried again, never what is computed from it.
    """
    keep = listing.columns
    at = keep.index(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                try:
                    content, error = retrying(read, batch.column(at)[i].as_py(), attempts=attempts, delay=delay), None
                except Exception as e:  # a file that cannot be read is a row, not a failed task
                    content, error = None, f"{type(e).__name__}: {e}"[:200]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, pa.array([content], pa.binary()), pa.array([error], pa.string())], names=[*keep, "content", "error"])

    return listing.mapInArrow(run, T.StructType([*listing.schema.fields, T.StructField("content", T.BinaryType()), T.StructField("error", T.StringType())]))


CACHED = "path string, name string, length long, modified timestamp, digest string, content binary, error string"


class FetchCache:
    """Contents kept by path, with the length and time that the file had and a digest of what was read.

    A file is fetched where the ledger has none of its path, length and time, which is an anti-join on names
    alone; so a second run reads no source file, a changed one is read again, and one that could not be
    read is tried again. What a run fetched counts once all of it is in place.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.held = Committed(spark, folder, CACHED, "path")

    def missing(self, listing: DataFrame) -> DataFrame:
        """The rows of ``listing`` (path, length, modified) that are not held as they are; contents are not read for it."""
        have = self.held.read().where("error is null").select(F.col("path").alias("_p"), F.col("length").alias("_l"), F.col("modified").alias("_m"))
        same = (F.col("path") == F.col("_p")) & F.col("length").eqNullSafe(F.col("_l")) & F.col("modified").eqNullSafe(F.col("_m"))
        return listing.join(have, same, "left_anti")

    def fetch(self, listing: DataFrame, **how) -> int:
        """Fetch what is missing of ``listing``; returns how many files were tried. ``how`` goes to :func:`fetch`."""
        new = self.missing(listing.select("path", F.col("length").cast("long").alias("length"), F.col("modified").cast("timestamp").alias("modified")).dropDuplicates(["path"]))
        got = fetch(new, **how)
        rows = got.withColumn("name", text.cache_name(F.col("path"))).withColumn("digest", F.sha2("content", 256))
        version = self.held.stage(rows)
        self.held.commit(version)
        return self.held.staged(version).count()

    def read(self, listing: DataFrame) -> DataFrame:
        """``listing`` with name, digest, content and error of each file as it was fetched last; a file that never was has none."""
        own = self.held.read().select(F.col("path").alias("_p"), *(F.col(c).alias(f"_{c}") for c in ("name", "digest", "content", "error")))
        rows = listing.join(own, F.col("path") == F.col("_p"), "left")
        return rows.select(*listing.columns, *(F.col(f"_{c}").alias(c) for c in ("name", "digest", "content", "error") if c not in listing.columns))
