"""Work on rows in order without a window over a whole group or table: numbering, and the nearest row of another table.

Rows are sorted over the cluster by range and written out with the number of their part and place in it. What
a part has to know of the ones before or after it is a row for each group and part, so a group that
fills many parts is worked on by as many tasks, and nothing grows with a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import new_path

#: Rows of a part of the sorted rows.
PART_ROWS = 1 << 18


def written(rows: DataFrame, tag: str = "ordered") -> DataFrame:
    """``rows`` written to the shared folder and read back: lineage is cut, and every use sees the same rows."""
    path = new_path(rows.sparkSession, tag)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def in_parts(rows: DataFrame, order: Sequence[str | Column], part_rows: int = PART_ROWS) -> DataFrame:
    """``rows`` sorted by range, with _part and _at (place in all parts, rising with the order); written out.

    Rows equal in ``order`` may lie in two parts, as their places in the input tell them apart.
    """
    first = written(rows.withColumn("_salt", F.monotonically_increasing_id()), "rows")
    n = max(1, -(-first.count() // part_rows))
    ranged = first.repartitionByRange(n, *order, "_salt").sortWithinPartitions(*order, "_salt").drop("_salt")
    return written(ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), "parts")


def matched(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``left`` with the other columns of ``right`` where the keys are equal, nulls too; ``right`` may come of ``left``."""
    own = {k: f"_key{i}" for i, k in enumerate(keys)}
    renamed = right.select(*(F.col(k).alias(n) for k, n in own.items()), *(c for c in right.columns if c not in own))
    on = F.lit(True)
    for k, n in own.items():
        on = on & F.col(k).eqNullSafe(F.col(n))
    return left.join(renamed, on, how).drop(*own.values())


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[str | Column], name: str = "number", part_rows: int = PART_ROWS) -> DataFrame:
    """``rows`` with their number from 1 in the order within their group, nulls being a group; of rows equal in the order any comes first.

    Two passes: rows are counted by group and part, and a row's number is its place in its part, less that of the
    group's first row there, plus the group's rows in earlier parts.
    """
    placed = in_parts(rows, [*by, *order], part_rows)
    count = placed.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # A row for each group and part: as many for a group as it fills parts.
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_part")) - F.col("_n") if by else F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    base = count.withColumn("_base", before).drop("_n")
    joined = matched(placed, base, [*by, "_part"])
    return joined.select(*rows.columns, (F.col("_at") - F.col("_first") + F.col("_base") + 1).alias(name))


def nearest(rows: DataFrame, controls: DataFrame, value: str, key: str, group: Sequence[str] = (), part_rows: int = PART_ROWS) -> DataFrame:
    """(group, key, control, distance): each row with the control of nearest value in its group, the smaller key of equals; null where there is none.

    A join by place in the order: both sides are sorted together, the last control before a row and the
    first one after it are the only two that can be nearest, and what a part does not hold itself is
    carried over its borders, one control for each group and part. Groups may be of any size, and there may
    be none. Rows and controls without a value have no place: such rows get no control.
    """
    by = list(group)
    v = F.col(value).cast("double")
    # Of controls with one value the smallest key stands for all.
    few = controls.where(v.isNotNull()).groupBy(*by, v.alias("_v")).agg(F.min(key).alias("_c"))
    both = rows.where(v.isNotNull()).select(*by, v.alias("_v"), F.col(key).alias("_k"), F.lit(None).cast(few.schema["_c"].dataType).alias("_c")).unionByName(few.select(*by, "_v", F.lit(None).cast(rows.schema[key].dataType).alias("_k"), "_c"))
    placed = in_parts(both, [*by, "_v", F.col("_c").isNull()], part_rows)
    pick = F.when(F.col("_c").isNotNull(), F.struct("_v", "_c"))
    # Edges: the last and the first control of each group in each part, carried on to later and to earlier parts.
    ends = placed.where("_c is not null").groupBy(*by, "_part").agg(F.max_by(F.struct("_v", "_c"), "_at").alias("_last"), F.min_by(F.struct("_v", "_c"), "_at").alias("_first"))
    parts = placed.select(*by, "_part").distinct()
    met = matched(parts, ends, [*by, "_part"], "left")
    up = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*by).orderBy(F.col("_part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = met.select(*by, "_part", F.last("_last", ignorenulls=True).over(up).alias("_low"), F.last("_first", ignorenulls=True).over(down).alias("_high"))
    inside = Window.partitionBy("_part", *by)
    seen = placed.withColumn("_a", F.last(pick, ignorenulls=True).over(inside.orderBy("_at"))).withColumn("_b", F.last(pick, ignorenulls=True).over(inside.orderBy(F.col("_at").desc()))).where("_c is null")
    got = matched(seen, carried, [*by, "_part"]).select(*by, "_k", "_v", F.coalesce("_a", "_low").alias("_a"), F.coalesce("_b", "_high").alias("_b"))
    gap = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("_v") - F.col(f"{c}._v")).alias("d"), F.col(f"{c}._c").alias("c")))
    best = got.withColumn("_best", F.least(gap("_a"), gap("_b"))).select(*by, F.col("_k").alias(key), F.col("_best.c").alias("control"), F.col("_best.d").alias("distance"))
    lost = rows.where(v.isNull()).select(*by, key, F.lit(None).cast(few.schema["_c"].dataType).alias("control"), F.lit(None).cast("double").alias("distance"))
    return best.unionByName(lost)
