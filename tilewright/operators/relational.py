"""Joins, roll-ups, windows and sampling of the quality workflow as DataFrame plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.robust import places
from . import ordered

#: Needles, and characters of them, that are sent to all tasks.
MOST_NEEDLES, MOST_CHARACTERS = 100_000, 4_000_000


def must_match(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join that fails, naming a key, when a row of the left side has no partner."""
    keys = list(on)
    marked = right.withColumn("_there", F.lit(True))
    rows = left.join(marked, keys, "left")
    missing = F.concat(F.lit("no partner for "), F.concat_ws("/", *(F.col(k).cast("string") for k in keys)))
    return rows.withColumn("_there", F.when(F.col("_there").isNull(), F.raise_error(missing).cast("boolean")).otherwise(F.col("_there"))).where("_there").drop("_there")


def containing(rows: DataFrame, name: str, needles: DataFrame, needle: str) -> DataFrame:
    """Each row with each distinct needle that its name contains (needle, and the columns of ``rows``); blank needles are in nothing.

    An equi-join on pieces: a needle is found by its first three characters, or all of a shorter one,
    among the distinct pieces of the name, and then compared. A name of n characters has at most 3n
    pieces, and no row meets a needle that it shares no piece with. Up to MOST_NEEDLES needles of up to
    MOST_CHARACTERS are broadcast; more are joined by shuffle. The pieces never are broadcast: Spark takes
    them for as few as the names.
    """
    few = needles.select(F.col(needle).alias("_needle")).where(F.length("_needle") > 0).distinct()
    whole = ordered.written(few, "needles").withColumn("_piece", F.substring("_needle", 1, 3))
    size = whole.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("_needle")), F.lit(0))).head()
    whole = F.broadcast(whole) if size[0] <= MOST_NEEDLES and size[1] <= MOST_CHARACTERS else whole.hint("merge")
    places = F.sequence(F.lit(1), F.length(name))
    pieces = F.flatten(F.transform(places, lambda i: F.array(*(F.substring(F.col(name), i, F.lit(n)) for n in (1, 2, 3)))))
    cut = rows.where(F.length(name) > 0).withColumn("_piece", F.explode(F.array_distinct(pieces)))
    return cut.join(whole, "_piece").where(F.col(name).contains(F.col("_needle"))).drop("_piece").withColumnRenamed("_needle", needle)


def patch_column(base: DataFrame, variant: DataFrame, on: Sequence[str], column: str) -> DataFrame:
    """The base rows with one column taken from the variant where it has the key."""
    new = variant.select(*on, F.col(column).alias("_new"))
    return base.join(new, list(on), "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def first_source(parts: Sequence[tuple[str, DataFrame]], key: str) -> DataFrame:
    """All rows of the first source that has the key, with its name; sources in order of preference."""
    tagged = [df.select(key, *[c for c in df.columns if c != key]).withColumn("source", F.lit(name)).withColumn("_p", F.lit(i)) for i, (name, df) in enumerate(parts)]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionByName(t, allowMissingColumns=True)
    best = F.min("_p").over(Window.partitionBy(key))
    return every.withColumn("_best", best).where(F.col("_p") == F.col("_best")).drop("_p", "_best")


def id_neighbours(rows: DataFrame, slide: str, fov: str, value: Sequence[str], back: int = 2) -> DataFrame:
    """With neighbours: structs of the fields whose number is one to ``back`` lower; gaps in numbers count."""
    w = Window.partitionBy(slide).orderBy(fov).rangeBetween(-back, -1)
    return rows.withColumn("neighbours", F.collect_list(F.struct(fov, *value)).over(w))


def row_neighbours(rows: DataFrame, slide: str, fov: str, value: Sequence[str], back: int = 2) -> DataFrame:
    """With neighbours: structs of the ``back`` fields before it that exist."""
    w = Window.partitionBy(slide).orderBy(fov).rowsBetween(-back, -1)
    return rows.withColumn("neighbours", F.collect_list(F.struct(fov, *value)).over(w))


def nearest(rows: DataFrame, controls: DataFrame, value: str, key: str, group: Sequence[str]) -> DataFrame:
    """Each row with the control of nearest value (the smaller key of equals) in its group; see :func:`ordered.nearest`, which also takes no group at all."""
    if not group:
        raise ValueError("nearest needs a group; ordered.nearest does without")
    return ordered.nearest(rows, controls, value, key, group)


def modal(rows: DataFrame, by: Sequence[str], label: str, rank: Column) -> DataFrame:
    """The most frequent label of each group, the lower rank of equals."""
    n = rows.groupBy(*by, label).agg(F.count(F.lit(1)).alias("_n"), F.min(rank).alias("_r"))
    return n.groupBy(*by).agg(F.min_by(label, F.struct(-F.col("_n"), F.col("_r"))).alias("modal"))


def even_sample(rows: DataFrame, by: Sequence[str], order: Column, k: int) -> DataFrame:
    """k rows of each group at evenly spread places of its order; groups of at most k whole."""
    w = Window.partitionBy(*by)
    n, at = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy(order)) - 1
    placed = rows.withColumn("_n", n).withColumn("_at", at)
    # Place i is floor(i * step + step / 2) with step = n / k: the row's place belongs to one i at most.
    i = F.greatest(F.lit(0), F.floor((F.col("_at") * 2 * k - F.col("_n")) / (2 * F.col("_n"))).cast("int"))
    hit = lambda j: F.floor((2 * j + 1) * F.col("_n") / (2 * k)) == F.col("_at")
    return placed.where((F.col("_n") <= k) | hit(i) | hit(i + 1) & (i + 1 < k)).drop("_n", "_at")


def seeded_sample(rows: DataFrame, by: Sequence[str], key: Sequence[str], k: int, seed: int) -> DataFrame:
    """k rows of each group by the smallest digests of key and seed: the same on every run, partitioning and engine."""
    mixed = F.md5(F.concat_ws("/", *(F.col(c).cast("string") for c in key), F.lit(str(seed))))
    w = Window.partitionBy(*by).orderBy(mixed, *key)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def best_per(rows: DataFrame, by: Sequence[str], value: str, key: str) -> DataFrame:
    """The row key of the largest value in each group, the smaller key of equals."""
    top = F.min_by(key, F.struct(-F.col(value), F.col(key)))
    return rows.groupBy(*by).agg(top.alias(key), F.max(value).alias(value))


def nearest_index_edges(values: DataFrame, value: str, k: int) -> DataFrame:
    """(bin, edge): the k - 1 inner edges at the sorted places round(i * n / k), halves to even."""
    n = values.agg(F.count(value).alias("all"))
    want = n.select(F.explode(F.sequence(F.lit(1), F.lit(k - 1))).alias("bin"), "all").select("bin", (F.bround(F.col("bin") * F.col("all") / k) + 1).cast("long").alias("at"))
    at = places(values, value)
    hit = (F.col("before") < F.col("at")) & (F.col("at") <= F.col("before") + F.col("occurs"))
    return at.join(F.broadcast(want), hit).select("bin", F.col(value).alias("edge"))  # k - 1 rows on the right


def confusion(rows: DataFrame, truth: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """tp, fn, fp, tn and the miss and false-alarm rates (null without such rows) of each group."""
    t, p = F.col(truth), F.col(predicted)
    n = rows.groupBy(*by).agg(*(F.count(F.when(c, 1)).alias(name) for name, c in (("tp", t & p), ("fn", t & ~p), ("fp", ~t & p), ("tn", ~t & ~p))))
    rate = lambda a, b: F.col(a) / F.nullif(F.col(a) + F.col(b), F.lit(0))
    return n.withColumn("fn_rate", rate("fn", "tp")).withColumn("fp_rate", rate("fp", "tn"))


def dense_confusion(rows: DataFrame, truth: str, predicted: str, levels: Sequence) -> DataFrame:
    """A row per level with a count per predicted level, zeros kept."""
    spark = rows.sparkSession
    every = spark.createDataFrame([(x,) for x in levels], f"{truth} {rows.schema[truth].dataType.simpleString()}")
    got = rows.groupBy(truth).pivot(predicted, list(levels)).count()
    return every.join(got, truth, "left").fillna(0)


def sweep(rows: DataFrame, score: str, truth: str, tiers: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """A row per tier: share of negatives and of positives at or above it.

    All tiers are conditions of one aggregate, so a row is read once and none is multiplied; the few
    sums are turned into rows afterwards.
    """
    t = F.col(truth)
    at = lambda tier: F.coalesce(F.col(score) >= tier, F.lit(False))
    sums = [F.struct(F.lit(float(x)).alias("tier"), F.count(F.when(at(x) & t, 1)).alias("tp"), F.count(F.when(at(x) & ~t, 1)).alias("fp")) for x in tiers]
    n = rows.groupBy(*by).agg(F.array(*sums).alias("_t"), F.count(F.when(t, 1)).alias("p"), F.count(F.when(~t, 1)).alias("n"))
    n = n.select(*by, "p", "n", F.explode("_t").alias("_t")).select(*by, "_t.tier", "_t.tp", "p", "_t.fp", "n")
    return n.withColumn("recall", F.col("tp") / F.nullif(F.col("p"), F.lit(0))).withColumn("false_alarms", F.col("fp") / F.nullif(F.col("n"), F.lit(0)))
