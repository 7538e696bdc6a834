"""The workflow's named row filters, each a condition that Catalyst can push down."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that are sent to the tasks as a list; more of them are joined.
MOST_LISTED = 1_000


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def without_errors(rows: DataFrame, error: str = "error") -> DataFrame:
    """Rows whose error is null or blank."""
    return rows.where(F.coalesce(F.trim(F.col(error)), F.lit("")) == "")


def in_catalog(rows: DataFrame, mark: str = "in_catalog") -> DataFrame:
    """Rows marked as in the catalogue; a null mark, or a table without the column, counts as in it."""
    return rows.where(F.coalesce(F.col(mark), F.lit(True))) if mark in rows.columns else rows


def selected(rows: DataFrame, keys: Iterable, key: str = "slide_id", strict: bool = True) -> DataFrame:
    """Rows of the named keys; with ``strict`` a key that no row has is an error, else it is passed over."""
    want = list(dict.fromkeys(keys))
    kind = rows.schema[key].dataType.simpleString()
    listed = rows.sparkSession.createDataFrame([(k,) for k in want], f"`{key}` {kind}")
    if strict:
        gone = listed.join(rows.select(key).distinct(), key, "left_anti").limit(5).collect()
        if gone:
            raise ValueError("unknown: " + ", ".join(sorted(str(r[0]) for r in gone)))
    return rows.where(F.col(key).isin(want)) if len(want) <= MOST_LISTED else rows.join(listed, key, "left_semi")


def excluded(rows: DataFrame, keys: Iterable, key: str = "slide_id") -> DataFrame:
    """Rows of other keys than those named, as the slides that a model was fitted on; a null key stays."""
    want = list(dict.fromkeys(keys))
    return rows.where(F.col(key).isNull() | ~F.col(key).isin(want)) if want else rows


def numeric(rows: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Rows in which all named text columns read as finite numbers, and these columns as doubles."""
    out = rows
    for c in columns:
        out = out.withColumn(c, F.col(c).try_cast("double")).where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return out


def usable_negatives(rows: DataFrame, truth: str | Column, flags: str | Column, spoiling: Iterable[str]) -> DataFrame:
    """Rows that are known negatives and carry none of the spoiling flags (semicolon-separated)."""
    own = F.split(F.coalesce(_col(flags), F.lit("")), ";")
    return rows.where(~_col(truth) & ~F.arrays_overlap(own, F.array(*map(F.lit, spoiling))))


def disagreements(rows: DataFrame, first: str | Column, second: str | Column, least: int = 1) -> DataFrame:
    """Rows in which two ordinals lie at least ``least`` apart; a missing one disagrees with nothing."""
    return rows.where(F.abs(_col(first) - _col(second)) >= least)


def partition_by_cutoff(rows: DataFrame, value: str | Column, cutoff: float) -> tuple[DataFrame, DataFrame]:
    """(rows strictly below the cutoff, rows at or above it); rows without a value are in neither."""
    v = _col(value)
    return rows.where(v < cutoff), rows.where(v >= cutoff)


def missing(rows: DataFrame, value: str | Column) -> DataFrame:
    """Rows without a value."""
    return rows.where(_col(value).isNull())
