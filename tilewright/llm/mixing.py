"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in native expressions.

Documents of a source lie in blocks by a hash of their id and text. Targets give each source whole passes over
its blocks and a last, partial pass; each pass over a block is one draw, and the source's draws are its
exact quota. The tree splits the quotas among the output shards: a node deals its draws of every source
to its two halves as drawing without replacement would, so each shard gets the mixture of a global
shuffle while nothing but counts moves. The draws of a source, in an order permuted by hash, then go to
the shards in disjoint runs, and each shard is shuffled by itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, materialise, small_or_not, table
from .quality import let, words

WEIGHTS, MOST, SEED = (1, 2, 3), 3, 17
#: Blocks a source has at least, documents a block has at most on average, words of a shard on average.
MIN_BLOCKS, BLOCK_DOCS, SHARD_WORDS = 128, 1 << 16, 1 << 25
MIN_SHARDS = 8
#: Sources that are dealt within one group of a node.
GROUP = 256
#: Rows of a file of the tables with a row or few for each block, and the files that they have at least.
FILE_ROWS, MIN_FILES = 500_000, 8


def targets(totals: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, rank, target) from (source, source_size).

    Sources by code point, null last, weigh as ``weights`` repeat. Shares of the sum stop at ``most``
    times a source's size; by rising room per weight, the sources that stop are a prefix, and what they
    leave is shared by the rest. One row per source goes through one task.
    """
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    ranked = totals.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("w", w)
    room = ranked.withColumn("cap", most * F.col("source_size").cast("double")).withColumn("all", F.sum("source_size").over(Window.partitionBy()).cast("double"))
    by_room = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    left = F.col("all") - F.coalesce(F.sum("cap").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    # What follows a row is the whole less what comes before it: a frame to the end would be added up anew for each row.
    rest = F.sum("w").over(Window.partitionBy()) - F.coalesce(F.sum("w").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = room.withColumn("level", left / rest)
    final = F.max("level").over(Window.partitionBy())
    return level.select("source", "source_size", "rank", F.least(F.col("cap"), final * F.col("w")).alias("target"))


def _uniform(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") * (2.0**-53)


def _deal(counts: Column, take: Column, *salt: Column) -> Column:
    """For each (r, c) of an array how many of its c are among ``take`` drawn without replacement from all: an array of longs."""
    long = lambda x: x.cast("long")
    none = F.array().cast("array<long>")

    def one(state: Column, item: Column) -> Column:
        n = item["c"]
        draw = F.aggregate(
            F.when(n > 0, F.sequence(F.lit(1).cast("long"), n)).otherwise(none),
            F.struct(F.lit(0).cast("long").alias("x"), state["n"].alias("n"), state["l"].alias("l")),
            lambda a, i: let(
                (_uniform(*salt, item["r"], i) * a["n"].cast("double") < a["l"].cast("double")).cast("long"),
                lambda hit: F.struct((a["x"] + hit).alias("x"), (a["n"] - 1).alias("n"), (a["l"] - hit).alias("l")),
            ),
        )
        return let(draw, lambda d: F.struct(d["n"].alias("n"), d["l"].alias("l"), F.concat(state["out"], F.array(d["x"])).alias("out")))

    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x["c"])
    return F.aggregate(counts, F.struct(long(total).alias("n"), long(take).alias("l"), none.alias("out")), one, lambda s: s["out"])


def split(groups: Column, node: Column, take: Column, seed: int) -> Column:
    """The two halves of a node: arrays like ``groups`` of (g, c, items of (r, c)), with ``take`` draws in the left one.

    The draws are dealt among the groups first and within each group then, which is the same law. Cells
    without draws are left out.
    """
    some = lambda x: F.filter(x, lambda y: y["c"] > 0)

    def inside(g: Column, left: Column) -> Column:
        def halves(xs: Column) -> Column:
            mine = F.zip_with(g["items"], xs, lambda i, x: F.struct(i["r"].alias("r"), x.alias("c")))
            rest = F.zip_with(g["items"], xs, lambda i, x: F.struct(i["r"].alias("r"), (i["c"] - x).alias("c")))
            own = lambda c, items: F.struct(g["g"].alias("g"), c.alias("c"), some(items).alias("items"))
            return F.struct(own(left, mine).alias("left"), own(g["c"] - left, rest).alias("right"))

        return let(_deal(g["items"], left, F.lit(seed), node, F.lit(1)), halves)

    totals = F.transform(groups, lambda g: F.struct(g["g"].alias("r"), g["c"].alias("c")))
    both = let(_deal(totals, take, F.lit(seed), node, F.lit(0)), lambda lefts: F.zip_with(groups, lefts, inside))
    return let(both, lambda x: F.array(some(F.transform(x, lambda h: h["left"])), some(F.transform(x, lambda h: h["right"]))))


def splitting_tree(quotas: DataFrame, shards: int, seed: int = SEED, group: int = GROUP) -> DataFrame:
    """(shard, rank, q): exact numbers of draws by shard from (rank, q), where any; ``shards`` is a power of two.

    Shards get equal numbers of draws but for rounding. The tree has one row per node with the cells
    that hold draws; its sums over shards are the quotas, and its joint law is that of cutting a random
    permutation of all draws.
    """
    cells = quotas.where("q > 0").select(F.floor(F.col("rank") / group).alias("g"), F.col("rank").cast("long").alias("r"), F.col("q").cast("long").alias("c"))
    grouped = cells.groupBy("g").agg(F.sum("c").alias("c"), F.sort_array(F.collect_list(F.struct("r", "c"))).alias("items"))
    root = grouped.groupBy().agg(F.sort_array(F.collect_list(F.struct("g", "c", "items"))).alias("groups"), F.coalesce(F.sum("c"), F.lit(0)).alias("all"))
    nodes = root.select("groups", "all", F.lit(0).cast("long").alias("at"))
    edge = lambda s: F.floor(F.col("all") * s / shards).cast("long")
    width = shards
    while width > 1:
        half = width // 2
        take = edge(F.col("at") + half) - edge(F.col("at"))
        halves = split(F.col("groups"), F.col("at") * 64 + F.lit(width.bit_length()), take, seed)
        nodes = nodes.select("all", "at", F.posexplode(halves).alias("side", "groups")).select("all", (F.col("at") + F.col("side") * half).alias("at"), "groups")
        width = half
    found = nodes.select(F.col("at").alias("shard"), F.explode("groups").alias("g")).select("shard", F.explode("g.items").alias("x"))
    return found.select("shard", F.col("x.r").alias("rank"), F.col("x.c").alias("q"))


def _block(u: Column, bits: int) -> Column:
    return F.shiftrightunsigned(u, 64 - bits)


def _gone(picks: Column, me: Column) -> Column:
    """Whether the picks of a source take all rows equal to ``me``: before an end, or as many at an end as there are."""
    before = F.exists(picks, lambda p: (F.col("size") <= p["cap"]) & (me < p["low"]))
    return F.coalesce(before, F.lit(False)) | ((_at_end(picks, me, "t") > 0) & (_at_end(picks, me, "t") >= _at_end(picks, me, "m", F.greatest)))


def _at_end(picks: Column, me: Column, field: str, join=lambda a, x: a + x) -> Column:
    own = F.filter(picks, lambda p: p["low"] == me)
    return F.coalesce(F.aggregate(own, F.lit(0).cast("long"), lambda a, p: join(a, p[field])), F.lit(0))


def _pick(cap: Column, low: Column, t: Column, m: Column) -> Column:
    long = lambda x: x.cast("long")
    return F.struct(long(cap).alias("cap"), low.alias("low"), long(t).alias("t"), long(m).alias("m"))


def _run_up(rows: DataFrame) -> DataFrame:
    """(source, block, last, got) of the rows of a block that fit in its ``room`` by hash, up to the first that does not; last: me, t of m equal rows.

    Equal rows are counted first, so however often one repeats, the window has it once.
    """
    key = ["source", "block", "u", "id", "size"]
    classes = rows.groupBy(*key, "room").agg(F.count("*").alias("m"))
    upto = classes.withColumn("before", F.sum(F.col("size") * F.col("m")).over(Window.partitionBy("source", "block").orderBy("u", "id", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") * F.col("m"))
    fits = F.when(F.col("before") > F.col("room"), 0).when(F.col("size") == 0, F.col("m")).otherwise(F.least(F.col("m"), F.floor((F.col("room") - F.col("before")) / F.col("size"))))
    cut = upto.withColumn("t", fits.cast("long")).where("t > 0")
    last = F.struct(F.struct("block", "u", "id", "size").alias("me"), "t", "m")
    return cut.groupBy("source", "block").agg(F.max(last).alias("last"), F.max(F.col("before") + F.col("size") * F.col("t")).alias("got"))


def fill(left: DataFrame, state: DataFrame, files: int = MIN_FILES) -> DataFrame:
    """``state`` (s, gap, picks, ...) with picks added until what stays open of a source is less than the smallest row left out.

    Each round takes rows of ``left`` (source, block, u, id, size) of at most half the gap, by block and
    hash until one does not fit; the gap halves or such rows run out, so rounds are few. Then one row
    that fills best is added. All sources go through a round at once.
    """
    me, mine = F.struct("block", "u", "id", "size"), F.col("source").eqNullSafe(F.col("s"))
    none = F.lit(None).cast(left.schema["id"].dataType)
    # Places after all blocks, and before all rows of a block.
    place = lambda block, u: F.struct(block.cast("long").alias("block"), F.lit(u).cast("long").alias("u"), none.alias("id"), F.lit(0).cast("long").alias("size"))
    while True:
        free = left.join(state, mine).where(~_gone(F.col("picks"), me))
        some = free.where(F.col("size") <= F.col("gap") / 2)
        sums = some.groupBy("source", "block").agg(F.sum("size").alias("words"), F.max("gap").alias("gap"))
        upto = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("block")))
        over = F.col("upto") > F.col("gap")
        edges = upto.groupBy(F.col("source").alias("s1")).agg(F.min(F.when(over, F.col("block"))).alias("edge"), F.coalesce(F.max(F.when(~over, F.col("upto"))), F.lit(0)).alias("before"))
        edges = materialise(edges, "fill", files)
        if edges.isEmpty():
            break
        inside = some.join(edges, F.col("source").eqNullSafe(F.col("s1")) & (F.col("block") == F.col("edge")))
        ends = _run_up(inside.select("source", "block", "u", "id", "size", (F.col("gap") - F.col("before")).alias("room")))
        ends = ends.select(F.col("source").alias("s2"), "last", "got")
        low = F.when(F.col("edge").isNull(), place(F.lit(1 << 62), 0)).when(F.col("last").isNull(), place(F.col("edge"), -(1 << 63))).otherwise(F.col("last.me"))
        pick = _pick(F.floor(F.col("gap") / 2), low, F.coalesce("last.t", F.lit(0)), F.coalesce("last.m", F.lit(0)))
        now = state.join(edges, F.col("s").eqNullSafe(F.col("s1")), "left").join(ends, F.col("s").eqNullSafe(F.col("s2")), "left")
        now = now.withColumn("picks", F.when(F.col("before").isNull(), F.col("picks")).otherwise(F.concat("picks", F.array(pick))))
        state = materialise(now.withColumn("gap", F.col("gap") - F.coalesce("before", F.lit(0)) - F.coalesce("got", F.lit(0))).select(state.columns), "fill", files)
    miss = F.abs(F.col("gap") - F.col("size"))
    best = free.where(miss < F.col("gap")).groupBy("source").agg(F.min(F.struct(miss.alias("d"), me.alias("me"))).alias("best"))
    best = materialise(best.select(F.col("source").alias("s1"), F.col("best.me").alias("me")), "fill", files)
    equal = left.join(best, F.col("source").eqNullSafe(F.col("s1")) & (me == F.col("me"))).groupBy("s1", "me").agg(F.count("*").alias("m"))
    now = state.join(equal, F.col("s").eqNullSafe(F.col("s1")), "left")
    last = F.when(F.col("m").isNull(), F.col("picks")).otherwise(F.concat("picks", F.array(_pick(F.lit(-1), F.col("me"), F.lit(1), F.col("m")))))
    return materialise(now.withColumn("picks", last).select(state.columns), "fill", files)


def plan(docs: DataFrame, carry: Sequence[str] = (), weights: Sequence[float] = WEIGHTS, most: int = MOST, shards: int | None = None, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: id, source, size, source_size, target, taken, copies, shards, and the carried columns (as c_<name>).

    size: words ``[^\\x20\\x09-\\x0D]+`` of the text, 0 for null. copies: how often the mix takes the row, at
    most ``most`` times, 0 where it is left out; shards: the output shard of each copy. A source's taken
    words miss its target by less than the smallest document left out before the last one was added. The choice depends on the seed, ids, sizes
    and texts, so reruns agree; rows equal in id, source and text are interchangeable and are taken one by one. Null sources are one source,
    the last. An empty table gives an empty plan; sources without words have target 0.
    """
    return _planned(docs, carry, weights, most, shards, seed, id_col, text_col, source_col)[0]


def _planned(docs: DataFrame, carry: Sequence[str] = (), weights: Sequence[float] = WEIGHTS, most: int = MOST, shards: int | None = None, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, int]:
    """The plan, and the number of output shards."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].alias("id"), docs[source_col].cast("string").alias("source"), F.size(words(text)).cast("long").alias("size"), F.xxhash64(docs[id_col], text, F.lit(seed)).alias("u"), *(docs[c].alias(f"c_{c}") for c in carry))
    slim = materialise(rows.select("id", "source", "size", "u"), "sizes")
    sums = slim.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).head()
    blocks = MIN_BLOCKS
    while blocks * BLOCK_DOCS < sums[0]:
        blocks *= 2
    bits = blocks.bit_length() - 1
    if shards is None:
        shards = MIN_SHARDS
        while shards * SHARD_WORDS < sums[1]:
            shards *= 2
    # Partial aggregation leaves a row per source, block and task of a hot source.
    by_block = materialise(slim.groupBy("source", _block(F.col("u"), bits).alias("block")).agg(F.sum("size").alias("words")), "blocks")
    files = max(MIN_FILES, by_block.count() // FILE_ROWS)
    aims = targets(by_block.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.floor(F.col("target") / F.col("source_size") + 1e-9))).otherwise(0.0).cast("int")
    aims = aims.withColumn("whole", whole).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    aims = materialise(aims, "targets", files)
    known = by_block.join(aims, by_block["source"].eqNullSafe(aims["source"])).select(by_block["source"], "block", "words", "source_size", "rank", "target", "whole", "rest")
    known = known.withColumn("upto", F.sum("words").over(Window.partitionBy("rank").orderBy("block")))
    part = F.when(F.col("upto") <= F.col("rest"), F.lit(1)).when(F.col("upto") - F.col("words") < F.col("rest"), F.lit(2)).otherwise(F.lit(0))
    known = materialise(known.withColumn("part", F.when(F.col("whole") >= most, F.lit(0)).otherwise(part)).withColumn("open", F.col("rest") - F.col("upto") + F.col("words")), "known", files)
    # A draw per block and pass: the whole passes, and the partial one where the block has a share in it.
    passes = F.col("whole") + (F.col("part") > 0).cast("int")
    draws = known.where(passes > 0).select("rank", "block", F.explode(F.sequence(F.lit(1), passes)).alias("pass"))
    order = Window.partitionBy("rank").orderBy(F.xxhash64("rank", "block", "pass", F.lit(seed)), "pass", "block")
    draws = materialise(draws.withColumn("k", F.row_number().over(order).cast("long")), "draws", files * most)
    dealt = splitting_tree(draws.groupBy("rank").agg(F.count("*").alias("q")), shards, seed)
    runs = dealt.withColumn("hi", F.sum("q").over(Window.partitionBy("rank").orderBy("shard"))).where("q > 0")
    slots = runs.select("rank", "shard", F.explode(F.sequence(F.col("hi") - F.col("q") + 1, F.col("hi"))).alias("k"))
    placed = draws.join(slots, ["rank", "k"]).groupBy("rank", "block").agg(F.transform(F.sort_array(F.collect_list(F.struct("pass", "shard"))), lambda x: x["shard"]).alias("shards"))
    info = materialise(known.join(placed, ["rank", "block"], "left").select("source", "block", "source_size", "target", "whole", "part", "open", "shards"), "plan", files)
    # In a source's one partly taken block, documents go by their hash while they fit.
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))
    me = F.struct("block", "u", "id", "size")
    info = info.withColumnsRenamed({"source": "s", "block": "b"})
    small = slim.withColumn("block", _block(F.col("u"), bits))
    edge = info.where("part = 2").select("s", "b", "open", F.element_at("shards", -1).alias("fill_shard"))
    last = _run_up(small.join(edge, same).select("source", "block", "u", "id", "size", F.col("open").alias("room"))).withColumnsRenamed({"source": "s1", "block": "b1"})
    first = F.when(F.col("last").isNull(), F.array()).otherwise(F.array(_pick(F.lit((1 << 63) - 1), F.col("last.me"), F.col("last.t"), F.col("last.m"))))
    state = edge.join(last, F.col("s").eqNullSafe(F.col("s1")), "left").select("s", "fill_shard", (F.col("open") - F.coalesce("got", F.lit(0))).alias("gap"), first.alias("picks"))
    state = materialise(state, "edge", files)
    # What is still open is filled from the rest of the source, past what does not fit; this rides in the same draw.
    parts = info.where("part <> 1").select(F.col("s").alias("s1"), "b")
    left = small.join(parts, F.col("source").eqNullSafe(F.col("s1")) & (F.col("block") == F.col("b"))).join(state, F.col("source").eqNullSafe(F.col("s")))
    left = left.where((F.col("size") > 0) & (F.col("size") < 2 * F.col("gap")) & ~_gone(F.col("picks"), me)).select("source", "block", "u", "id", "size")
    state = fill(materialise(left, "left"), state, files).select(F.col("s").alias("s2"), "fill_shard", "picks")
    base = (rows if carry else slim).withColumn("block", _block(F.col("u"), bits))
    met = base.join(info, same).join(state, F.col("source").eqNullSafe(F.col("s2")), "left")
    gone = (F.col("part") == 1) | _gone(F.col("picks"), me)
    few = _at_end(F.col("picks"), me, "t")

    def placed_rows(met: DataFrame, taken: Column) -> DataFrame:
        out = met.withColumn("taken_again", taken.cast("int")).withColumn("copies", F.col("whole") + F.col("taken_again"))
        own = F.coalesce("shards", F.array().cast("array<bigint>"))
        rides = (F.col("part") == 0) & (F.col("taken_again") == 1)
        shards_of = F.when(rides, F.concat(F.slice(own, F.lit(1), F.col("whole")), F.array("fill_shard"))).otherwise(F.slice(own, F.lit(1), F.col("copies")))
        return out.select(
            F.col("id").alias(id_col), "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies",
            shards_of.alias("shards"), *(f"c_{c}" for c in carry),
        )

    # Equal rows of which some are taken are told apart by a row number; only they are dealt out for it.
    torn = state.select("s2", F.explode("picks").alias("p")).groupBy("s2", "p.low").agg(F.sum("p.t").alias("t"), F.max("p.m").alias("m")).where("0 < t and t < m")
    if torn.isEmpty():
        return placed_rows(met, gone), shards
    some = (few > 0) & ~gone
    held = materialise(met.where(some).withColumn("few", few), "torn")
    return placed_rows(met.where(~some), gone).unionByName(placed_rows(numbered(held, ["source", "block", "u", "id", "size"]), F.col("number") <= F.col("few"))), shards


def numbered(rows: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` (written out) with the column number: 1, 2, ... among those with equal keys, nulls equal.

    Rows are numbered within the part of the files they are read from, and parts by their counts, so
    equal rows never meet in one task.
    """
    own = rows.withColumn("part_read", F.spark_partition_id())
    counts = own.groupBy(*key, "part_read").agg(F.count("*").alias("m"))
    base = counts.withColumn("base", F.sum("m").over(Window.partitionBy(*key).orderBy("part_read")) - F.col("m"))
    base = small_or_not(materialise(base.select(*(F.col(k).alias(f"k_{k}") for k in (*key, "part_read")), "base"), "bases"))
    same = None
    for k in (*key, "part_read"):
        one = F.col(k).eqNullSafe(F.col(f"k_{k}"))
        same = one if same is None else same & one
    local = F.row_number().over(Window.partitionBy(*key, "part_read").orderBy("part_read"))
    return own.withColumn("local", local).join(base, same).withColumn("number", F.col("local") + F.col("base"))


def mix(docs: DataFrame, id_col: str = "doc_id", shard_col: str = "shard", **how) -> DataFrame:
    """The mixed corpus: rows of ``docs``, each as often as the plan takes it, with its columns and shard, shuffled within each shard.

    A column of ``docs`` that is named like ``shard_col`` gives way to the mix's own. Tasks hold a shard or
    a part of one: their number is the shards', which follows the words taken, and a shard with many
    short documents spreads over several tasks by ranges of its shuffled order.
    """
    names = [c for c in docs.columns if c != shard_col]
    planned, shards = _planned(docs, names, id_col=id_col, **how)
    copy, key = free_name("copy", [*names, shard_col]), free_name("key", [*names, shard_col])
    copies = planned.select(*(F.col(f"c_{c}").alias(c) for c in names), F.posexplode("shards").alias(copy, shard_col))
    mixed = F.xxhash64(F.col(id_col), copy, F.lit(how.get("seed", SEED) + 1))
    tasks = max(shards, copies.sparkSession.sparkContext.defaultParallelism)
    return copies.withColumn(key, mixed).repartitionByRange(tasks, shard_col, key).sortWithinPartitions(shard_col, key).drop(copy, key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(table(spark, sf_dir, "documents")).drop("shards")
