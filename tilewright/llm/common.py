"""Helpers that the text operators share: shared storage, materialisation, byte-level word splitting."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import filesystem as filesystem
from ..storage import new_path as new_path
from ..storage import shared_dir as shared_dir

#: Largest serialised object that an operator ships to every task (models, query sets, vocabularies).
BROADCAST_LIMIT_BYTES = 64 << 20


_CACHES: list[tuple[str, Callable[[], None]]] = []
_AT_WORK = [""]


def keeps(operator: str, clear: Callable[[], None]) -> None:
    """State that an operator keeps between tasks of a Python worker, by what empties it."""
    _CACHES.append((operator, clear))


def at_work(operator: str) -> None:
    """Called by each task: where the worker last worked for another operator, what that one kept is let go and freed memory returned."""
    if _AT_WORK[0] == operator:
        return
    _AT_WORK[0] = operator
    for other, clear in _CACHES:
        if other != operator:
            clear()
    give_back()


def give_back(collect: bool = True) -> None:
    """Return freed memory to the machine: a worker that waits for its next task should not hold what the last one needed."""
    if collect:
        gc.collect()
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # glibc only
        trim(0)


def materialise(df: DataFrame, tag: str, files: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, a lost executor costs nothing.

    ``files`` bounds the number of files of a table that is known to be small.
    """
    path = new_path(df.sparkSession, tag)
    (df if files is None else df.coalesce(files)).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_or_not(df: DataFrame, most_rows: int = 500_000) -> DataFrame:
    """``df`` (written out, narrow rows) marked for broadcast while its counted rows stay under a bound; beyond it the join shuffles."""
    return F.broadcast(df) if df.count() <= most_rows else df


def digest(text: Column) -> Column:
    """16 bytes that stand for a text where verdicts go by text and not by id; null has none."""
    return F.unhex(F.md5(text.cast("string")))


def free_name(name: str, taken: Iterable[str]) -> str:
    """``name``, behind as many underscores as it takes to be none of ``taken`` in any letter case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes that separate words for :func:`alnum_words`: every ASCII byte but letters and digits; A-Z become a-z.
_ALNUM = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)


def utf8(text: str) -> bytes:
    """UTF-8 bytes; lone surrogates, which Spark cannot produce, are replaced."""
    return text.encode("utf-8", "replace")


def alnum_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased; None has none."""
    return utf8(text).translate(_ALNUM).split() if text else []


def space_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; None has none.

    ``bytes.lower`` changes A-Z only and ``bytes.split`` splits at just these six characters.
    """
    return utf8(text).lower().split() if text else []


#: Slices after which freed memory goes back within a task.
SLICES = 16


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Views of at most ``rows`` rows of each batch, so that few texts are Python objects at a time; freed memory goes back now and then, and at the end."""
    batch, n = None, 0
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
            n += 1
            if n % SLICES == 0:
                give_back(collect=False)
    del batch
    give_back()
