"""Bootstrap and permutation over tables of any size: replicates are weights and orders by digest, and ranks are sums of weights.

A row's weight in a replicate is how often a Poisson draw of mean one takes it, read off a digest of the row's
key, so no row is moved or repeated to be drawn, every engine makes the same draws, and a lost task
makes them again. All replicates are worked out side by side in the same aggregates.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from hashlib import md5
from math import exp, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ordered, quantiles

#: Draws that one digest gives, of 16 bits each.
DRAWS = 8
#: Below which of the 65,536 values a draw takes a row at most 0, 1, 2, ... times.
CUTS = tuple(round(65_536 * exp(-1) * sum(1 / factorial(i) for i in range(k + 1))) for k in range(7))


def digest(key: Sequence[str], number: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("/", *(F.col(k).cast("string") for k in key), number.cast("string"), F.lit(str(seed))))


def weighted(rows: DataFrame, key: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """A row of ``rows`` for each replicate that takes it: _b, from 0, and _w, how often. ``key`` tells rows apart."""
    chunk = rows.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(-(-replicates // DRAWS) - 1)))).withColumn("_d", digest(key, F.col("_c"), seed))
    draws = F.array(*(F.conv(F.substring("_d", 4 * i + 1, 4), 16, 10).cast("int") for i in range(DRAWS)))
    each = chunk.select(*rows.columns, "_c", F.posexplode(draws).alias("_i", "_u")).withColumn("_b", F.col("_c") * DRAWS + F.col("_i"))
    w = F.lit(0)
    for cut in CUTS:
        w = w + (F.col("_u") >= cut).cast("int")
    return each.where(F.col("_b") < replicates).withColumn("_w", w).where("_w > 0").select(*rows.columns, "_b", "_w")


#: The same draws as numbers of times, by value.
TIMES = np.searchsorted(np.array(CUTS), np.arange(65_536), side="right").astype(np.uint8)
#: Rows of a block of sorted rows.
BLOCK = 2_048


def prefix(key: Sequence[str]) -> Column:
    """What :func:`digest` puts before the number."""
    return F.concat_ws("/", *(F.col(k).cast("string") for k in key), F.lit(""))


def times(prefixes: Sequence[str], replicates: range, seed: int) -> np.ndarray:
    """The weights of :func:`weighted` as a matrix, a row for each prefix and a column for each replicate; zeros are kept."""
    first, last = replicates.start // DRAWS, -(-replicates.stop // DRAWS)
    tails = [f"{c}/{seed}".encode() for c in range(first, last)]
    got = b"".join([md5(p + t).digest() for p in (x.encode() for x in prefixes) for t in tails])
    all_ = TIMES[np.frombuffer(got, ">u2").reshape(len(prefixes), len(tails) * DRAWS)]
    return all_[:, replicates.start - first * DRAWS : replicates.stop - first * DRAWS]


def weighted_medians(rows: DataFrame, level: str, value: str, mark: str, weights: Callable[[pa.Array], np.ndarray], replicates: int, block: int = BLOCK) -> DataFrame:
    """(level, _b, m): the median of each level in each replicate that takes a row of it."""
    return weighted_places(rows, level, value, mark, weights, replicates, {"m": quantiles.share(0.5)}, block)


def weighted_places(rows: DataFrame, level: str, value: str, mark: str, weights: Callable[[pa.Array], np.ndarray], replicates: int, places: Mapping[str, quantiles.Place], block: int = BLOCK) -> DataFrame:
    """(level, _b, and a column for each of ``places``): order statistics of each level in each replicate that takes a row of it, for weights that are found from a row's ``mark``.

    Rows are sorted by range and cut into blocks. A block's weights are added up for all replicates at once; the
    sums say in which block a replicate's place lies, and only these few blocks are looked into. No row is
    repeated for a replicate, and what is shuffled then is a number for each block and replicate.
    """
    own = rows.select(F.col(level).alias("_l"), F.col(value).cast("double").alias("_v"), F.col(mark).alias("_mark")).where("_v is not null")
    bits = max(0, (block - 1).bit_length())
    placed = ordered.in_parts(own, ["_l", "_v"], 16 * block).withColumn("_block", F.shiftright("_at", bits))
    kind = placed.schema["_l"].dataType

    def add(batches):
        for batch in batches:
            if batch.num_rows:
                cell = np.stack([batch.column(0).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False), batch.column(1).to_numpy()])
                starts = np.append(0, np.flatnonzero((np.diff(cell) != 0).any(0)) + 1)
                sums = np.add.reduceat(weights(batch.column(2)), starts, axis=0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(starts)), pa.array(cell[1][starts]), pa.FixedSizeListArray.from_arrays(pa.array(sums.ravel()), replicates).cast(pa.list_(pa.int64()))], names=["_l", "_block", "_s"])

    sums = placed.select("_l", "_block", "_mark").mapInArrow(add, T.StructType([T.StructField("_l", kind), T.StructField("_block", T.LongType()), T.StructField("_s", T.ArrayType(T.LongType()))]))
    each = sums.select("_l", "_block", F.posexplode("_s").alias("_b", "_s")).groupBy("_l", "_b", "_block").agg(F.sum("_s").alias("_s"))
    w = Window.partitionBy("_l", "_b")  # a row for each block
    upto = each.select("*", F.sum("_s").over(w.orderBy("_block")).alias("_upto"), F.sum("_s").over(w).alias("_n")).where("_s > 0")
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(p(F.col("_n"))).cast("long"), F.ceil(p(F.col("_n"))).cast("long")) for p in places.values()))))
    hit = upto.select("*", F.explode(ranks).alias("_rank")).where("_upto - _s <= _rank and _rank < _upto")
    asked = ordered.written(hit.select("_l", "_b", "_block", "_rank", "_n", (F.col("_rank") - F.col("_upto") + F.col("_s")).alias("_k")), "asked")

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        left, out = left.sort_by("_at"), []
        own, want = left["_l"].to_pylist(), right["_l"].to_pylist()
        for one in set(want):
            at, ask = np.flatnonzero([x == one for x in own]), np.flatnonzero([x == one for x in want])
            b, k = right["_b"].to_numpy()[ask], right["_k"].to_numpy()[ask]
            upto = np.cumsum(weights(left["_mark"].take(pa.array(at)).combine_chunks()), axis=0, dtype=np.int64)
            place = at[[np.searchsorted(upto[:, i], n, side="right") for i, n in zip(b, k, strict=True)]]
            out.append(right.select(["_l", "_b", "_rank", "_n"]).take(pa.array(ask)).append_column("_v", left["_v"].take(pa.array(place))))
        return pa.concat_tables(out)

    schema = T.StructType([*(asked.schema[c] for c in ("_l", "_b", "_rank", "_n")), T.StructField("_v", T.DoubleType())])
    few = placed.join(asked.select("_block").distinct(), "_block", "left_semi").select("_l", "_v", "_mark", "_at", "_block")
    found = few.groupBy("_block").cogroup(asked.groupBy("_block")).applyInArrow(look, schema)
    got = found.groupBy(F.col("_l").alias(level), "_b").agg(F.max("_n").alias("_n"), F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_m"))  # two for each place
    return got.select(level, "_b", *(quantiles.between(p(F.col("_n")), lambda k: F.element_at("_m", k)).alias(c) for c, p in places.items()))


def bootstrap_medians(rows: DataFrame, score: str, level: str, key: Sequence[str], replicates: int = 1000, seed: int = 42, small: int = BLOCK) -> DataFrame:
    """(level, low, high): the 5th and 95th percentile of the medians of ``replicates`` resamples of each level, of whatever size."""
    own = rows.select(level, score, prefix(key).alias("_mark"))
    meds = weighted_medians(own, level, score, "_mark", lambda m: times(m.to_pylist(), range(replicates), seed), replicates, min(small, BLOCK))
    q = meds.groupBy(level).agg(F.percentile("m", F.array(F.lit(0.05), F.lit(0.95))).alias("q"))  # a value for each replicate
    return q.select(level, F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def _rank(value: str, by: Sequence[str]) -> Column:
    """The mean place from 1 of a row's copies among all copies in its group, ties sharing theirs."""
    w = Window.partitionBy(*by).orderBy(value)
    upto, tied = F.sum("_w").over(w.rangeBetween(Window.unboundedPreceding, 0)), F.sum("_w").over(w.rangeBetween(0, 0))
    return upto - (tied - 1) / 2


def _rho(w: str, x: str, y: str) -> list[Column]:
    """The sums that :func:`_from_sums` makes the weighted correlation of."""
    a, b, c = F.col(w), F.col(x), F.col(y)
    return [F.sum(a).alias("_sw"), F.sum(a * b).alias("_sx"), F.sum(a * c).alias("_sy"), F.sum(a * b * b).alias("_sxx"), F.sum(a * c * c).alias("_syy"), F.sum(a * b * c).alias("_sxy")]


def _from_sums() -> Column:
    room = F.sqrt((F.col("_sw") * F.col("_sxx") - F.col("_sx") * F.col("_sx")) * (F.col("_sw") * F.col("_syy") - F.col("_sy") * F.col("_sy")))
    return F.when(room > 0, (F.col("_sw") * F.col("_sxy") - F.col("_sx") * F.col("_sy")) / room).otherwise(0.0)


def _long(rows: DataFrame, keep: Sequence[str], statistics: Sequence[str]) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(s).alias("statistic"), F.col(s).cast("double").alias("_x")) for s in statistics))
    return rows.select(*keep, F.explode(pairs).alias("_p")).select(*keep, "_p.statistic", "_p._x")


#: Rows of a table whose numbers a task may hold, and replicates that a task works out with them.
MOST_HELD, SHARE = 500_000, 40


def _complete(rows: DataFrame, key: Sequence[str], statistics: Sequence[str], target: str) -> DataFrame:
    return rows.select(*key, *(F.col(s).cast("double").alias(s) for s in statistics), F.col(target).cast("double").alias("_y")).dropna(subset=[*statistics, "_y"])


def _by_share(rows: DataFrame, statistics: Sequence[str], replicates: int, rhos: Callable[[np.ndarray, np.ndarray, list[str], range], np.ndarray]) -> DataFrame:
    """(_b, statistic, rho): ``rhos`` of (statistics by rows, targets, keys, replicates) for each share of the replicates; -1 is a share of its own.

    Rows come in the order of _k, where they have one.
    """
    shares = rows.sparkSession.range(-1, -(-replicates // SHARE), 1, 1).select(F.col("id").cast("int").alias("_share"))
    names = list(statistics)

    def run(table: pa.Table) -> pa.Table:
        share = table["_share"][0].as_py()
        some = range(-1, 0) if share < 0 else range(share * SHARE, min(replicates, (share + 1) * SHARE))
        if "_k" in table.column_names:
            table = table.sort_by("_k")
        got = rhos(np.stack([table[n].to_numpy() for n in names]), table["_y"].to_numpy(), table["_key"].to_pylist(), some)
        return pa.table({"_b": pa.array(np.repeat(np.array(some, np.int32), len(names))), "statistic": pa.array(names * len(some)), "rho": pa.array(got.ravel())})

    keep = ["_key", "_y", *names, *(c for c in ("_k",) if c in rows.columns)]
    dealt = rows.select(*keep).crossJoin(F.broadcast(shares)).repartition(len(range(-1, -(-replicates // SHARE))), "_share")
    return dealt.groupBy("_share").applyInArrow(run, "_b int, statistic string, rho double")


def _correlation(n: np.ndarray, x: np.ndarray, y: np.ndarray, xx: np.ndarray, yy: np.ndarray, xy: np.ndarray) -> np.ndarray:
    room = np.sqrt(np.maximum((n * xx - x * x) * (n * yy - y * y), 0))
    return np.where(room > 0, (n * xy - x * y) / np.where(room > 0, room, 1), 0.0)


def _tied(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, where a new value starts in it)."""
    order = np.argsort(values, kind="stable")
    return order, np.append(0, np.flatnonzero(np.diff(values[order]) != 0) + 1)


def _places(weights: np.ndarray) -> np.ndarray:
    """Mean places from 1 of values in order, whose copies are counted."""
    upto = np.cumsum(weights, axis=0)
    return upto - (weights - 1) / 2


def _paired_rhos(x: np.ndarray, y: np.ndarray, keys: list[str], some: range, seed: int) -> np.ndarray:
    w = np.ones((len(keys), 1), np.uint8) if some.start < 0 else times(keys, some, seed)
    out = np.empty((len(some), len(x)))
    orders = [_tied(v) for v in x]
    order, starts = _tied(y)
    group = np.empty(len(y), np.int64)
    group[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(y))))
    for at in range(0, len(some), DRAWS):  # a few replicates at a time, side by side in memory
        own = w[:, at : at + DRAWS].astype(np.float64)
        count = np.add.reduceat(own[order], starts, axis=0)
        place = _places(count)
        n, sy, syy = count.sum(0), (count * place).sum(0), (count * place * place).sum(0)
        product = own * place[group]
        for i, (o, s) in enumerate(orders):
            c = np.add.reduceat(own[o], s, axis=0)
            p = _places(c)
            cp = c * p
            out[at : at + own.shape[1], i] = _correlation(n, cp.sum(0), sy, (cp * p).sum(0), syy, (p * np.add.reduceat(product[o], s, axis=0)).sum(0))
    return out


def _shuffled_rhos(x: np.ndarray, y: np.ndarray, keys: list[str], some: range, seed: int) -> np.ndarray:
    def ranks(v: np.ndarray) -> np.ndarray:
        order, starts = _tied(v)
        n, out = np.diff(np.append(starts, len(v))), np.empty(len(v))
        out[order] = np.repeat(_places(n.astype(np.float64)), n)
        return out

    rx, ry, n = np.stack([ranks(v) for v in x]), ranks(y), float(len(y))
    given = np.empty((len(y), len(some)))
    known = [k.encode() for k in keys]
    for i, b in enumerate(some):
        tail = f"{b}/{seed}".encode()
        if b < 0:
            given[:, i] = ry
        else:  # by the digest's two halves; rows are in the order of the key, which the sort keeps for equal digests
            high, low = np.frombuffer(b"".join([md5(k + tail).digest() for k in known]), ">u8").reshape(-1, 2).T
            order = np.argsort(high.astype(np.uint64), kind="stable")
            if (np.diff(high[order].astype(np.uint64)) == 0).any():
                order = np.lexsort((low, high))
            given[order, i] = ry
    sx, sxx = rx.sum(1), (rx * rx).sum(1)
    return _correlation(n, sx[None], ry.sum(), sxx[None], (ry * ry).sum(), (rx @ given).T)


def paired_bootstrap(rows: DataFrame, key: Sequence[str], statistics: Sequence[str], target: str, base: str, replicates: int = 2000, seed: int = 42) -> DataFrame:
    """(statistic, rho, low, high, delta_low, delta_high, differs): rank correlation with the target, and its size less the base's, on the same resamples.

    The whole table is replicate -1 with weights one. Rows with a null in the target or a statistic are left out.
    Up to MOST_HELD rows, a task holds the rows' numbers for SHARE replicates and ranks them there; with more
    rows, each replicate's rows are ranked by windows, which spill.
    """
    own = ordered.written(_complete(rows, key, statistics, target), "pairs")
    if own.count() <= MOST_HELD:
        rho = _by_share(own.withColumn("_key", prefix(key)), statistics, replicates, lambda x, y, keys, some: _paired_rhos(x, y, keys, some, seed))
    else:
        drawn = weighted(own, key, replicates, seed).unionByName(own.select("*", F.lit(-1).alias("_b"), F.lit(1).alias("_w")))
        placed = drawn.withColumn("_ry", _rank("_y", ["_b"]))
        ranked = _long(placed, ["_b", "_w", "_ry"], statistics).withColumn("_rx", _rank("_x", ["_b", "statistic"]))
        rho = ranked.groupBy("_b", "statistic").agg(*_rho("_w", "_rx", "_ry")).select("_b", "statistic", _from_sums().alias("rho"))
    against = F.max(F.when(F.col("statistic") == base, F.abs("rho"))).over(Window.partitionBy("_b"))  # a row for each statistic
    both = rho.withColumn("delta", F.abs("rho") - against)
    q = F.array(F.lit(0.05), F.lit(0.95))
    some = lambda c: F.percentile(F.when(F.col("_b") >= 0, F.col(c)), q)
    out = both.groupBy("statistic").agg(F.max(F.when(F.col("_b") < 0, F.col("rho"))).alias("rho"), some("rho").alias("_r"), some("delta").alias("_d"))
    out = out.select("statistic", "rho", F.col("_r")[0].alias("low"), F.col("_r")[1].alias("high"), F.col("_d")[0].alias("delta_low"), F.col("_d")[1].alias("delta_high"))
    return out.withColumn("differs", (F.col("delta_low") > 0) | (F.col("delta_high") < 0))


def permutation_p(rows: DataFrame, key: Sequence[str], statistics: Sequence[str], target: str, replicates: int = 2000, seed: int = 43) -> DataFrame:
    """One row: the largest |rho| of the statistics, how many shuffles of the target reach it, and (hits + 1) / (replicates + 1).

    A shuffle puts the rows in the order of a digest and hands them the targets in the order of the key.
    Ranks do not change with it, so they are taken once, and a shuffle costs its products alone. Up to
    MOST_HELD rows, a task holds the rows' numbers for SHARE shuffles; with more rows they are sorted and joined.
    """
    own = ordered.written(_complete(rows, key, statistics, target), "pairs")
    if own.count() <= MOST_HELD:
        numbered = ordered.numbered(own.withColumn("_key", prefix(key)), [], list(key), "_k")
        rho = _by_share(numbered, statistics, replicates, lambda x, y, keys, some: _shuffled_rhos(x, y, keys, some, seed))
    else:
        rho = _joined_shuffles(own, key, statistics, replicates, seed)
    top = rho.groupBy("_b").agg(F.max(F.abs("rho")).alias("top"))
    seen = F.max(F.when(F.col("_b") < 0, F.col("top"))).over(Window.partitionBy())  # a row for each replicate
    hits = F.count(F.when((F.col("_b") >= 0) & (F.col("top") >= F.col("seen") - 1e-12), 1))
    return top.withColumn("seen", seen).agg(F.max("seen").alias("max_abs_rho"), hits.alias("hits"), ((hits + 1) / (replicates + 1)).alias("p"))


def _joined_shuffles(own: DataFrame, key: Sequence[str], statistics: Sequence[str], replicates: int, seed: int) -> DataFrame:
    own = own.withColumn("_w", F.lit(1))
    placed = ordered.written(ordered.numbered(own.withColumn("_ry", _rank("_y", ["_w"])), [], list(key), "_k"), "targets")
    shuffles = placed.select(*key, F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("_b"))
    order = Window.partitionBy("_b").orderBy(digest(key, F.col("_b"), seed), *key)
    given = shuffles.withColumn("_k", F.row_number().over(order).cast("long")).join(placed.select("_k", "_ry"), "_k").select("_b", *key, "_ry")
    given = given.unionByName(placed.select(F.lit(-1).alias("_b"), *key, "_ry"))
    ranks = ordered.written(_long(placed, [*key, "_w"], statistics).withColumn("_rx", _rank("_x", ["statistic"])).select(*key, "_w", "statistic", "_rx"), "ranks")
    return given.join(ranks, list(key)).groupBy("_b", "statistic").agg(*_rho("_w", "_rx", "_ry")).withColumn("rho", _from_sums())
