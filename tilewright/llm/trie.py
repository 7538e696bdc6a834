"""The trie of conversation prefixes by Patricia construction over sorted conversations.

Turns are digests, and a conversation is cut into blocks of BLOCK turns, so no row grows with a
conversation. Equal blocks after equal beginnings are one row with its number of conversations. These
rows are sorted by beginning and digests over the whole cluster; walking each sorted part with a stack
creates only the points of the compressed trie where conversations branch, end or stop, and on an edge
the words of its turns. What a point needs is added up while its subtree is walked:

    saved(point) = S + (n - 1) * words of the point's own turn,
    S = words of all turns below, of every member, less the words of the distinct nodes below,

and both parts of S add up over conversations, so points that several parts share (those on the path of
a part's first or last row, as deep as the neighbouring part shares it) are added up by key afterwards.
A node inside an edge has the members of the point at the edge's end, and its own sum is that of the
point plus (n - 1) times the words from the node to the point: suffix sums expand the edges in the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import at_work, materialise, small_or_not, table
from .quality import words

#: Turns of a block, rows of a part of the sorted turns and of the sorted blocks, ids of a chunk of ends (a power of two).
BLOCK, PART_TURNS, PART_BLOCKS, CHUNK_BITS = 256, 1 << 18, 1 << 14, 10
#: Conversations that take their first turns from the first of so many ids, and the most turns taken and one.
FAMILY, HEADS = 20, 4
NO_ENDS = hashlib.sha256(b"").hexdigest()
_WIDTH = 16  # bytes of a turn's digest


def _parts(rows: int, of: int) -> int:
    return max(1, -(-rows // of))


def placed_turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, part_turns: int) -> tuple[DataFrame, DataFrame]:
    """Turns (conv, digest, words, at) in order, written out, and parts of conversations (conv, part, first, base, len).

    ``at`` is the number of the sorted part and the row in it, so a turn's place is at - first + base. Texts
    are read once and never moved. Turns that are equal in number go by digest; equal rows may lie in
    several parts, as a row's place in the input breaks the tie.
    """
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    slim = conversations.select(conversations[conv_col].cast("long").alias("conv"), conversations[turn_col].alias("turn"), digest.alias("digest"), F.size(words(text)).cast("long").alias("words"), F.monotonically_increasing_id().alias("salt"))
    slim = materialise(slim.where("conv is not null"), "turns")
    order = ["conv", F.col("turn").asc_nulls_first(), "digest", "salt"]
    ordered = slim.repartitionByRange(_parts(slim.count(), part_turns), *order).sortWithinPartitions(*order)
    ordered = materialise(ordered.select("conv", "digest", "words", F.monotonically_increasing_id().alias("at")), "ordered")
    # A row per conversation and part: few even for a conversation that fills many parts.
    seg = ordered.groupBy("conv", F.shiftright("at", 33).alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("conv").orderBy("part"))
    seg = seg.withColumn("base", upto - F.col("n")).withColumn("len", F.sum("n").over(Window.partitionBy("conv")))
    return ordered, materialise(seg.select("conv", "part", "first", "base", "len"), "segments")


def rebuilt(ordered: DataFrame, seg: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations (conv, len, d, digest, words), d from 0, and (conv, len) of every one."""
    place = F.col("at") - F.col("first") + F.col("base")
    parted = ordered.withColumn("part", F.shiftright("at", 33))
    head = parted.where(F.col("conv") % FAMILY == 0).join(seg, ["conv", "part"]).withColumn("d", place).where(F.col("d") < HEADS - 1)
    head = head.groupBy(F.col("conv").alias("family")).agg(F.sort_array(F.collect_list(F.struct("d", "digest", "words"))).alias("head"))
    h = (F.crc32(F.col("conv").cast("string")) % HEADS).cast("long")
    all_ = seg.where("base = 0").select("conv", F.col("len").alias("own"), h.alias("h"), (F.col("conv") - F.col("conv") % FAMILY).alias("family"))
    taken = F.when(F.col("h") > 0, F.slice("head", F.lit(1), F.col("h").cast("int")))
    info = all_.join(head, "family", "left").select("conv", "h", "own", F.coalesce(taken, F.array().cast(head.schema["head"].dataType)).alias("head"))
    k = F.size("head").cast("long")
    info = materialise(info.select("conv", "h", "head", k.alias("k"), (k + F.greatest(F.lit(0), F.col("own") - F.col("h"))).alias("len")), "rebuilt")
    shift = seg.drop("len").join(info.select("conv", "h", "k", "len"), "conv")
    own = parted.join(shift, ["conv", "part"]).where(place >= F.col("h")).select("conv", "len", (place - F.col("h") + F.col("k")).alias("d"), "digest", "words")
    first = info.select("conv", "len", F.explode("head").alias("x")).select("conv", "len", "x.d", "x.digest", "x.words")
    return own.unionByName(first), info.select("conv", "len")


def blocks(turns: DataFrame, block: int) -> DataFrame:
    """(conv, level, n, digests, words, p0, p1, e0, e1, rest, last) of each block, written out.

    p and e name what lies before the block and up to its end: sums without carry of hashes of places and
    digests, so beginnings of any length are named without walking them. rest: words after the block.
    """
    level = F.floor(F.col("d") / block).cast("long")
    name = lambda k: F.bit_xor(F.xxhash64(F.lit(k), "d", "digest"))
    got = turns.groupBy("conv", "len", level.alias("level")).agg(F.sort_array(F.collect_list(F.struct("d", "digest", "words"))).alias("t"), name(1).alias("x0"), name(2).alias("x1"), F.sum("words").alias("own"))
    digests = F.unhex(F.array_join(F.transform("t", lambda x: F.hex(x["digest"])), ""))
    got = materialise(got.select("conv", "len", "level", F.size("t").alias("n"), digests.alias("digests"), F.transform("t", lambda x: x["words"]).alias("words"), "x0", "x1", "own"), "blocks")
    none = F.lit(0).cast("long")
    short = got.where(F.col("len") <= block).select("conv", "level", "n", "digests", "words", none.alias("p0"), none.alias("p1"), F.col("x0").alias("e0"), F.col("x1").alias("e1"), none.alias("rest"), F.lit(True).alias("last"))
    # Longer ones: only names and sums go through the window by conversation, a row for each block.
    w = Window.partitionBy("conv").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("conv").orderBy(F.col("level").desc()).rowsBetween(Window.unboundedPreceding, 0)
    long_ = got.where(F.col("len") > block)
    chain = long_.select("conv", "level", F.bit_xor("x0").over(w).alias("e0"), F.bit_xor("x1").over(w).alias("e1"), (F.sum("own").over(after) - F.col("own")).alias("rest"), (F.floor((F.col("len") - 1) / block) == F.col("level")).alias("last"))
    joined = long_.join(chain, ["conv", "level"]).select("conv", "level", "n", "digests", "words", F.col("e0").bitwiseXOR(F.col("x0")).alias("p0"), F.col("e1").bitwiseXOR(F.col("x1")).alias("p1"), "e0", "e1", "rest", "last")
    return materialise(short.unionByName(joined), "chained")


CLASS = ["level", "p0", "p1", "e0", "e1", "n"]


def sorted_classes(chained: DataFrame, part_blocks: int) -> DataFrame:
    """Distinct blocks in order of level, beginning and digests, written out: CLASS, digests, words, rep, cnt, ends, end_conv, rest, part, at."""
    last = F.when(F.col("last"), F.col("conv"))
    found = chained.groupBy(*CLASS).agg(F.min("conv").alias("rep"), F.count("*").alias("cnt"), F.count(last).alias("ends"), F.min(last).alias("end_conv"), F.sum("rest").alias("rest"), F.min_by(F.struct("digests", "words"), "conv").alias("b"))
    order = ["level", "p0", "p1", "digests"]
    flat = found.select(*CLASS, "b.digests", "b.words", "rep", "cnt", "ends", "end_conv", "rest")
    ranged = flat.repartitionByRange(_parts(chained.count(), part_blocks), *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    return materialise(ranged.withColumn("at", at).withColumn("part", F.shiftright("at", 33)), "classes")


def shared(a: bytes, b: bytes) -> int:
    """Turns that two blocks have in common at their beginnings."""
    low, high = 0, min(len(a), len(b)) // _WIDTH
    while low < high:
        mid = (low + high + 1) // 2
        if a[low * _WIDTH : mid * _WIDTH] == b[low * _WIDTH : mid * _WIDTH]:
            low = mid
        else:
            high = mid - 1
    return low


def borders(classes: DataFrame) -> dict[int, tuple[int, int, bool]]:
    """part -> (turns that its first row shares with the row before it, turns that its last row shares with the next, whether that extends it).

    -1 where the neighbour lies below another beginning. Two rows a part reach the driver.
    """
    key = F.struct("level", "p0", "p1", "digests")
    rows = classes.groupBy("part").agg(F.min(key).alias("low"), F.max(key).alias("high")).orderBy("part").collect()
    same = lambda a, b: tuple(a)[:3] == tuple(b)[:3]
    cut = [shared(a.high.digests, b.low.digests) if same(a.high, b.low) else -1 for a, b in zip(rows, rows[1:], strict=False)]
    before, after = [-1, *cut], [*cut, -1]
    return {r.part: (before[i], after[i], after[i] >= 0 and after[i] * _WIDTH == len(r.high.digests)) for i, r in enumerate(rows)}


def walked(classes: DataFrame) -> DataFrame:
    """``classes`` again in parts of their own and in order."""
    return classes.repartition("part").sortWithinPartitions("part", "at")


def with_below(classes: DataFrame, chained: DataFrame, cuts: dict[int, tuple[int, int, bool]]) -> DataFrame:
    """``classes`` with fresh, leaves and kids of the levels below: words of distinct nodes, leaves, and children of the block's last node.

    Each block is counted for the conversation that stands for it; sums by conversation over its deeper
    blocks, and over the conversations of a class, give what lies below the class.
    """
    none = [F.lit(0).cast("long").alias(c) for c in ("fresh", "leaves", "kids")]
    deep = chained.where((F.col("level") > 0) | ~F.col("last"))
    if deep.isEmpty():
        return classes.select("*", *none)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("trie")
        held, out = None, []

        def done(row, ext: bool) -> None:
            before, (part, level, _, _, digests, own, rep, cnt, ends) = row
            out.append((rep, level, sum(own[before:]), int(cnt == ends and not ext), int(before == 0)))

        def batch_of() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["conv", "level", "fresh", "leaf", "top"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is not None and held[1][0] == row[0]:
                    same = held[1][1:4] == row[1:4]
                    n = shared(held[1][4], row[4]) if same else 0
                    done(held, same and n * _WIDTH == len(held[1][4]))
                else:
                    if held is not None:
                        done(held, cuts[held[1][0]][2])
                    n = max(0, cuts[row[0]][0])
                held = (n, row)
            yield batch_of()
        if held is not None:
            done(held, cuts[held[1][0]][2])
        yield batch_of()

    own = walked(classes.select("part", "at", "level", "p0", "p1", "digests", "words", "rep", "cnt", "ends")).select("part", "level", "p0", "p1", "digests", "words", "rep", "cnt", "ends")
    each = own.mapInArrow(run, "conv long, level long, fresh long, leaf long, top long")
    w = Window.partitionBy("conv").orderBy(F.col("level").desc())
    under = w.rowsBetween(Window.unboundedPreceding, -1)
    sums = deep.select("conv", *CLASS).join(each, ["conv", "level"], "left").select("conv", *CLASS, F.sum("fresh").over(under).alias("fresh"), F.sum("leaf").over(under).alias("leaves"), F.lag("top").over(w).alias("kids"))
    sums = sums.groupBy(*CLASS).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("fresh", "leaves", "kids")))
    got = classes.join(sums, CLASS, "left")
    return got.select(*classes.columns, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("fresh", "leaves", "kids")))


POINT = "depth long, n long, conv long, ends long, end_conv long, s long, leaves long, kids long, suffix array<long>, pconv long, pkey binary, xkey binary, nkey binary"


def node_key(level: int, p0: int, p1: int, digests: bytes) -> bytes:
    return hashlib.blake2b(b"%d,%d,%d:" % (level, p0, p1) + digests, digest_size=16).digest()


ROOT = node_key(0, 0, 0, b"")


class Point:
    """A point of the compressed trie while its subtree is walked."""

    __slots__ = ("children", "conv", "depth", "end_conv", "ends", "inner", "kids", "leaves", "left", "n", "nkey", "s", "shared")

    def __init__(self, depth: int, shared: bool = False, left: bool = False):
        self.depth, self.shared, self.left = depth, shared, left
        self.n = self.ends = self.s = self.leaves = self.kids = 0
        self.conv: int | None = None
        self.end_conv: int | None = None
        self.nkey: bytes | None = None
        self.inner = False  # whether something lies below
        self.children: list[tuple] = []


class Walk:
    """Points of one beginning's blocks in sorted order; ``out`` takes finished ones as rows of POINT."""

    def __init__(self, level: int, p0: int, p1: int, before: int, block: int, out: list[tuple]):
        self.name, self.level, self.top, self.out = (level, p0, p1), level, level * block, out
        # Points that the part before this one shares; its root is merged with other parts' in any case.
        self.stack = [Point(d, True, True) for d in range(before + 1)] or [Point(0, level == 0)]
        self.digests, self.upto = b"", [0]

    def key(self, depth: int) -> bytes:
        return node_key(*self.name, self.digests[: depth * _WIDTH])

    def add(self, digests: bytes, own: list[int], n: int, rep: int, ends: int, end_conv: int | None, rest: int, fresh: int, leaves: int, kids: int, ahead: bytes | None) -> None:
        if self.digests:
            self.back(shared(self.digests, digests))
        self.digests, self.upto = digests, [0]
        for x in own:
            self.upto.append(self.upto[-1] + x)
        p = Point(len(own))
        p.n, p.conv, p.ends, p.end_conv, p.s, p.leaves, p.kids, p.nkey, p.inner = n, rep, ends, end_conv, rest - fresh, leaves, kids, ahead, n > ends
        self.stack.append(p)

    def back(self, depth: int) -> None:
        """Finish all points deeper than ``depth`` and leave one there."""
        while self.stack[-1].depth > depth:
            p = self.stack.pop()
            if self.stack[-1].depth < depth:
                self.stack.append(Point(depth))
            self.join(p, self.stack[-1])

    def join(self, p: Point, up: Point) -> None:
        if not p.inner:
            p.leaves = 1
        along = self.upto[p.depth] - self.upto[up.depth]
        up.n += p.n
        up.conv = p.conv if up.conv is None or p.conv < up.conv else up.conv
        up.leaves += p.leaves
        up.s += p.s + p.n * along - (0 if p.left else along)
        up.kids += not p.left
        up.inner = True
        row = self.row(p, [self.upto[p.depth] - self.upto[i] for i in range(up.depth, p.depth)])
        up.children.append(row)
        if up.shared or up.depth == 0:  # its key is known, so nothing waits
            self.settle(up)

    def row(self, p: Point, suffix: list[int]) -> tuple:
        self.settle(p)
        return (self.top + p.depth, p.n, p.conv, p.ends, p.end_conv, p.s, p.leaves, p.kids, suffix, self.key(p.depth) if p.shared else None, p.nkey)

    def settle(self, up: Point) -> None:
        """Hand on the children of ``up``, with its conversation, or with its key where another part or level decides it."""
        known = up.depth > 0 and not up.shared
        key = None if known or not up.children else self.key(up.depth)
        self.out += [(*c[:9], up.conv if known else None, key, *c[9:]) for c in up.children]
        up.children.clear()

    def close(self, after: int = -1, extended: bool = False) -> None:
        """Finish everything; points down to ``after`` turns of the last row go on in the next part, which may extend that row."""
        if extended:
            self.stack[-1].inner = True
        for depth in range(after, 0, -1):
            self.back(depth)
            self.stack[-1].shared = True
        self.back(0)
        root = self.stack.pop()
        self.settle(root)
        if self.level == 0:
            self.out.append((*self.row(root, [0])[:9], None, None, ROOT, None))


def points(classes: DataFrame, cuts: dict[int, tuple[int, int, bool]], block: int) -> DataFrame:
    """Rows of POINT of every part: points without xkey are whole, those with one are a part's share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("trie")
        walk, now, out = None, None, []

        def batch_of() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [()] * len(types)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

        for batch in batches:
            for part, level, p0, p1, e0, e1, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if walk is None or now != part or walk.name != (level, p0, p1):
                    if walk is not None:
                        walk.close(*(cuts[now][1:] if now != part else ()))
                    walk, now = Walk(level, p0, p1, cuts[part][0] if now != part else -1, block, out), part
                digests, own, n, rep, ends, *more = rest
                walk.add(digests, own, n, rep, ends, *more, node_key(level + 1, e0, e1, b"") if n > ends else None)
            yield batch_of()
        if walk is not None:
            walk.close(*cuts[now][1:])
        yield batch_of()

    kinds = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    names, types = zip(*((c.split(" ")[0], kinds[c.split(" ")[1]]) for c in POINT.split(", ")), strict=True)
    columns = ["part", "level", "p0", "p1", "e0", "e1", "digests", "words", "cnt", "rep", "ends", "end_conv", "rest", "fresh", "leaves", "kids"]
    return walked(classes.select(*columns, "at")).select(*columns).mapInArrow(run, POINT)


def ends_digests(ends: DataFrame) -> DataFrame:
    """(end_conv, ends_sha256) of each (e0, e1, len) of (conv, e0, e1, len), by its least conversation: SHA-256 of all ids in order, comma-joined.

    Ids go to the digest as chunks in order, so a task holds one chunk of a node in which any number of
    conversations end. SHA-256 cannot be split, so the ids of one node, and nothing else, pass one task.
    """
    text = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda x: x.cast("string")), ",")
    chunks = ends.groupBy("e0", "e1", "len", F.shiftright("conv", CHUNK_BITS).alias("chunk")).agg(text.alias("ids"), F.min("conv").alias("low"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("trie")
        now, first, state = None, None, None
        for batch in batches:
            out = []
            for *key, ids, low in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key == now:
                    state.update(b"," + ids.encode())
                else:
                    if now is not None:
                        out.append((first, state.hexdigest()))
                    now, first, state = key, low, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.string())], names=["end_conv", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([state.hexdigest()], pa.string())], names=["end_conv", "ends_sha256"])

    key = ["e0", "e1", "len"]
    return chunks.repartition(*key).sortWithinPartitions(*key, "chunk").select(*key, "ids", "low").mapInArrow(run, "end_conv long, ends_sha256 string")


def merged(found: DataFrame, turnless: DataFrame) -> DataFrame:
    """Shares of points with one xkey added up; conversations without turns are members of the root and end in it."""
    none = lambda t="long": F.lit(None).cast(t)
    zero = F.lit(0).cast("long")
    bare = turnless.agg(F.count("*").alias("n"), F.min("conv").alias("conv")).where("n > 0")
    bare = bare.select(zero.alias("depth"), "n", "conv", F.col("n").alias("ends"), F.col("conv").alias("end_conv"), zero.alias("s"), zero.alias("leaves"), zero.alias("kids"), F.array(zero).alias("suffix"), none().alias("pconv"), none("binary").alias("pkey"), F.lit(ROOT).alias("xkey"), none("binary").alias("nkey"))
    shares = found.where("xkey is not null").unionByName(bare)
    sums = shares.groupBy("depth", "xkey").agg(*(F.sum(c).alias(c) for c in ("n", "ends", "s", "leaves", "kids")), F.min("conv").alias("conv"), F.min("end_conv").alias("end_conv"), F.max(F.col("suffix")[0]).alias("w"), F.max("pkey").alias("pkey"), F.max("nkey").alias("nkey"))
    alone = F.when((F.col("kids") == 0) & (F.col("leaves") == 0), F.lit(1).cast("long")).otherwise(F.col("leaves"))
    return sums.select("depth", "n", "conv", "ends", "end_conv", "s", alone.alias("leaves"), "kids", F.array("w").alias("suffix"), none().alias("pconv"), "pkey", "xkey", "nkey")


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = BLOCK, part_turns: int = PART_TURNS, part_blocks: int = PART_BLOCKS) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns go by number, nulls first, equal numbers by the digest of role and text; a null role or text is
    empty; rows without a conversation belong to none and are left out; repeated rows are turns of their
    own; the remainder of an id by 20 has the id's sign. Texts of any length are read once and whole; further columns are ignored. Without any
    conversation there is no node, not even the root; where no conversation has a turn, the root is alone.
    """
    ordered, seg = placed_turns(conversations, conv_col, turn_col, role_col, text_col, part_turns)
    turns, convs = rebuilt(ordered, seg)
    chained = blocks(turns, block)
    classes = sorted_classes(chained, part_blocks)
    cuts = borders(classes)
    found = materialise(points(with_below(classes, chained, cuts), cuts, block), "points")
    turnless = convs.where("len = 0")
    both = materialise(merged(found, turnless), "shared")
    whole = found.where("xkey is null")
    # Parents that another part or level has a share of are looked up by key: a row for each level's end and each part's border.
    keys = both.select(F.col("xkey").alias("pkey"), F.col("conv").alias("up")).unionByName(whole.where("nkey is not null").select(F.col("nkey").alias("pkey"), F.col("conv").alias("up")))
    keys = small_or_not(materialise(keys, "parents"))
    every = whole.unionByName(both)
    known = every.where("pkey is null").withColumn("up", F.col("pconv"))
    nodes = known.unionByName(every.where("pkey is not null").join(keys, "pkey").select(*known.columns))
    nothing, zero = F.lit(NO_ENDS), F.lit(0).cast("long")
    last = chained.where("last").select("conv", "e0", "e1", (F.col("level") * block + F.col("n")).alias("len")).unionByName(turnless.select("conv", zero.alias("e0"), zero.alias("e1"), "len"))
    few = nodes.where("ends < 2").withColumn("sha", F.when(F.col("ends") == 1, F.sha2(F.col("end_conv").cast("string"), 256)).otherwise(nothing))
    many = nodes.where("ends >= 2").join(ends_digests(last).withColumnRenamed("ends_sha256", "sha"), "end_conv").select(*few.columns)
    size, i = F.size("suffix"), F.col("i")
    spread = few.unionByName(many).select("*", F.posexplode("suffix").alias("i", "words_to_end"))
    end = i == size - 1
    return spread.select(
        F.col("conv").alias("conv_id"), (F.col("depth") - size + 1 + i).alias("depth"), F.when(i == 0, F.col("up")).otherwise(F.col("conv")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(end, F.col("kids")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), (F.col("s") + (F.col("n") - 1) * F.col("words_to_end")).alias("saved_tokens"), F.when(end, F.col("sha")).otherwise(nothing).alias("ends_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: CRC-32 of the decimal digits of c, bit by bit.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda y, k: xor(y >> 1, 3988292384::BIGINT * (y & 1)))), 4294967295::BIGINT)"

#: Every prefix by a digest of its turns, and sums over all members of each.
SQL = f"""WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS g, turn FROM conversations WHERE conv_id IS NOT NULL),
 o AS (SELECT c, g, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS w, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, g) - 1 AS p FROM t),
 ids AS (SELECT c, count(*) AS n, {_CRC} % {HEADS} AS h FROM o GROUP BY c),
 rb AS (SELECT i.c, o.p AS d, g, w FROM ids i JOIN o ON o.c = i.c - i.c % {FAMILY} AND o.p < i.h UNION ALL SELECT i.c, least(i.h, coalesce(b.n, 0)) + o.p - i.h, g, w FROM ids i JOIN o ON o.c = i.c LEFT JOIN ids b ON b.c = i.c - i.c % {FAMILY} WHERE o.p >= i.h),
 l AS (SELECT i.c, coalesce(g, []) AS g, coalesce(w, []) AS w FROM ids i LEFT JOIN (SELECT c, list(g ORDER BY d) AS g, list(w ORDER BY d) AS w FROM rb GROUP BY c) USING (c)),
 pre AS (SELECT c, d, len(g) AS tot, md5(array_to_string(g[1:d], '')) AS k, CASE WHEN d > 0 THEN md5(array_to_string(g[1:d - 1], '')) END AS pk, CASE WHEN d > 0 THEN w[d] ELSE 0 END AS w FROM (SELECT c, g, w, unnest(range(0, len(g) + 1)) AS d FROM l)),
 kids AS (SELECT pk AS k, count(DISTINCT k) AS kids FROM pre WHERE d > 0 GROUP BY 1),
 nd AS (SELECT k, d, min(c) AS conv, count(*) AS n, any_value(pk) AS pk, any_value(w) AS w, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = tot), '')) AS ends FROM pre GROUP BY k, d),
 node AS (SELECT nd.*, coalesce(kids, 0) AS kids FROM nd LEFT JOIN kids USING (k)),
 own AS (SELECT pre.c, pre.d, pre.k, CASE WHEN node.conv = pre.c THEN (node.n - 1) * node.w ELSE 0 END AS v, CASE WHEN node.conv = pre.c AND node.kids = 0 THEN 1 ELSE 0 END AS leaf FROM pre JOIN node ON node.k = pre.k AND node.d = pre.d),
 suf AS (SELECT k, d, sum(v) OVER z AS v, sum(leaf) OVER z AS leaf FROM own WINDOW z AS (PARTITION BY c ORDER BY d DESC)),
 tot AS (SELECT k, d, sum(v) AS saved, sum(leaf) AS leaves FROM suf GROUP BY k, d)
 SELECT node.conv AS conv_id, node.d AS depth, up.conv AS parent_conv_id, node.n AS n_convs, node.kids AS n_children, tot.leaves::BIGINT AS n_leaves, tot.saved::BIGINT AS saved_tokens, node.ends AS ends_sha256
 FROM node JOIN tot ON tot.k = node.k AND tot.d = node.d LEFT JOIN node up ON up.k = node.pk AND up.d = node.d - 1"""
