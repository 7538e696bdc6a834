"""SimHash near-duplicates by covering locality-sensitive hashing.

Each bit position gets a random vector of radius + 1 bits; the mask of a non-zero vector v keeps the
positions whose vector has odd parity with v (Pagh, 2016). For any set of at most ``radius`` differing
positions some v is orthogonal to all of their vectors, so the two fingerprints agree under that mask:
no pair within the radius is missed in the 2^(radius + 1) - 1 tables, whatever the random choice.

Equal fingerprints are one class, so copies cost nothing more. A bucket of two classes is one
comparison of numbers that the aggregate already holds. Larger buckets are solved in numpy without
making all pairs: up to PAIRS members by comparison, larger ones by covering the positions in which
the bucket's members still differ, again and again, as at most a radius of such positions makes all
members neighbours. Buckets above BUCKET are split by further masks in Spark before they are gathered.
Each bucket returns a spanning forest, and links are joined to components by alternating star steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import at_work, digest, free_name, materialise, sliced, small_or_not, space_words, table

BITS, RADIUS, SHINGLE, SEED = 64, 4, 4, 42
#: Members of a bucket that are compared with each other.
PAIRS = 256
#: Members of a bucket that are gathered for one task, and the least that a caller may ask for.
BUCKET, LEAST_BUCKET = 1 << 16, 64


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit i is 1 if it is set in over half of the XXH64 (seed 42) of all shingles; no word gives zero."""
    words = space_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.append(0, ends[:-1] + 1)
    n = max(len(words) - shingle + 1, 1)
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)], np.uint64)
    count = np.zeros(BITS, np.int64)
    for i in range(0, n, 1 << 16):
        part = hashes[i : i + (1 << 16)]
        count += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * count > n).tolist())


def masks(radius: int = RADIUS, seed: int = 7, bits: np.ndarray | None = None) -> np.ndarray:
    """The covering masks over the given positions (all 64 unless given), as unsigned 64-bit numbers."""
    bits = np.arange(BITS) if bits is None else bits
    vectors = np.random.default_rng(seed).integers(0, 1 << (radius + 1), len(bits))
    out = []
    for v in range(1, 1 << (radius + 1)):
        odd = [int(b) for b, x in zip(bits, vectors, strict=True) if bin(v & int(x)).count("1") & 1]
        out.append(sum(1 << b for b in odd))
    return np.array(out, np.uint64)


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def link(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def forest(members: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Edges (m, 2) of a spanning forest of the graph that links members (distinct, unsigned) within the radius."""
    members = np.sort(members)
    f = _Forest(len(members))

    def solve(at: np.ndarray, depth: int) -> None:
        x = members[at]
        differ = int(np.bitwise_or.reduce(x) ^ np.bitwise_and.reduce(x))
        if differ.bit_count() <= radius:
            for i in at[1:].tolist():
                f.link(int(at[0]), i)
        elif len(at) <= PAIRS:
            near = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
            for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
                f.link(int(at[i]), int(at[j]))
        else:
            bits = np.array([b for b in range(BITS) if differ >> b & 1])
            for m in masks(radius, depth + 101, bits):
                key = x & m
                order = np.argsort(key, kind="stable")
                cuts = np.flatnonzero(np.diff(key[order])) + 1
                if not len(cuts):  # this mask keeps all together: halve its positions at the next depth, with other vectors
                    cuts = None
                for part in [order] if cuts is None else np.split(order, cuts):
                    if len(part) > 1 and (cuts is not None or depth < 64):
                        solve(at[part], depth + 1)

    if len(members) > 1:
        solve(np.arange(len(members)), 0)
    roots = np.array([f.root(i) for i in range(len(members))], np.int64)
    child = np.flatnonzero(roots != np.arange(len(members)))
    return np.stack([members[child], members[roots[child]]], 1)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): the fingerprint of each row's whole text as a signed 64-bit number."""
    slim = docs.select(docs[id_col], docs[text_col].cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("simhash")
        for batch in sliced(batches):
            fp = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=[id_col, "fp"])

    return slim.mapInArrow(run, f"`{id_col}` {slim.schema[0].dataType.simpleString()}, fp long")


def _signed(x) -> int:
    return int(np.uint64(x).view(np.int64))


def _keyed(members: DataFrame, seed: int, radius: int) -> DataFrame:
    """(group, t, key, fp): members of each group in every table; ``group`` is what they already agree on."""
    keep = [_signed(m) for m in masks(radius, seed)]
    tables = F.array(*(F.struct(F.lit(i).alias("t"), F.lit(m).alias("m")) for i, m in enumerate(keep)))
    wide = members.select("group", "fp", F.explode(tables).alias("x"))
    return wide.select("group", F.col("x.t").alias("t"), F.col("fp").bitwiseAND(F.col("x.m")).alias("key"), "fp")


def links(classes: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(src, dst), src > dst as unsigned numbers is not implied: a forest per bucket of links between distinct ``fp``."""
    near = F.bit_count(F.col("lo").bitwiseXOR(F.col("hi"))) <= radius
    at = ["group", "t", "key"]
    bucket = max(bucket, LEAST_BUCKET)
    members, out, seed = classes.select(F.lit(0).cast("long").alias("group"), "fp"), None, 7
    while True:
        keyed = _keyed(members, seed, radius)
        # Partial aggregation keeps a hot bucket down to a row per map task.
        counted = materialise(keyed.groupBy(at).agg(F.count("fp").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("n > 1"), "buckets")
        top = counted.agg(F.coalesce(F.max("n"), F.lit(0)), F.count(F.when(F.col("n") > 2, 1))).head()
        two = counted.where((F.col("n") == 2) & near).select(F.col("hi").alias("src"), F.col("lo").alias("dst"))
        out = two if out is None else out.unionByName(two)
        if top[1]:
            some = counted.where((F.col("n") > 2) & (F.col("n") <= bucket)).select(*at, "n")
            gathered = keyed.join(some, at).groupBy(at).agg(F.collect_list("fp").alias("fps"))
            out = out.unionByName(_solved(gathered.select("fps"), radius))
        if top[0] <= bucket:
            return out.distinct()
        # Members of a bucket that is still too large share its key: split it by masks of another seed.
        large = counted.where(F.col("n") > bucket).select(*at)
        members = materialise(keyed.join(large, at).select(F.xxhash64(*at).alias("group"), "fp").distinct(), "large")
        seed += 1


def _solved(gathered: DataFrame, radius: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("simhash")
        for batch in batches:
            found = [forest(np.array(x.values.to_numpy(zero_copy_only=False), np.int64).view(np.uint64), radius) for x in batch.column(0)]
            edges = np.concatenate(found).view(np.int64) if found else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["src", "dst"])

    return gathered.mapInArrow(run, "src long, dst long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of an edge table (src, dst) reaches, by star contraction.

    In each round every node takes the smallest of its neighbours; links between a node and that
    smallest one replace the old ones (large star, then small star). Rounds are written to the shared
    folder and end when nothing changes. Each node's smallest neighbour is aggregated before it is dealt
    out, and written, so that it is broadcast while few, and beyond that a hub's links are split as skew.
    """
    now, files = materialise(edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).where("src <> dst").distinct(), "edges"), None
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = small_or_not(materialise(both.groupBy("src").agg(F.least(F.min("dst"), F.min("src")).alias("low")), "low", files))
        large = both.join(low, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct()
        large = materialise(large, "large-star", files)
        low = small_or_not(materialise(large.groupBy("src").agg(F.min("dst").alias("low")), "low", files))
        small = large.join(low, "src").select(F.when(F.col("dst") == F.col("low"), F.col("src")).otherwise(F.col("dst")).alias("src"), F.col("low").alias("dst")).where("src <> dst").distinct()
        now = materialise(small, "edges", files)
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).head())
        if state == seen:
            return now.groupBy("src").agg(F.min("dst").alias("root")).select(F.col("src").alias("node"), "root")
        seen, files = state, max(8, state[0] // 500_000)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hexadecimal digits), component_id.

    component_id is the smallest id that the row reaches over links of at most ``radius`` differing
    bits, its own included (null where no row of the component has an id). Null, empty and blank texts
    have fingerprint zero and are linked like any other; further columns are ignored.
    """
    own = materialise(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = materialise(own.groupBy("fp").agg(F.min(id_col).alias("low")), "classes")
    roots = components(links(classes, radius, bucket))
    rooted = materialise(classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "rooted")
    # Written out, so that the join below has an exchange of its own on either side and a hot root can be split.
    lows = materialise(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "lows")
    labels = materialise(rooted.join(lows, "root").select("fp", "component_id"), "labels")
    return own.join(labels, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of ``docs`` for each near-duplicate group: that with the smallest id; of rows with equal ids one stays.

    Rows without an id cannot be told apart by it, and all stay. Texts move only where ids repeat.
    """
    found = materialise(near_duplicates(docs, id_col, text_col, **how).select(F.col(id_col).alias("_id"), "component_id"), "groups").where("_id is not null")
    dropped = small_or_not(materialise(found.where("component_id <> _id").select("_id").distinct(), "dropped"))
    kept = docs.join(dropped, docs[id_col] == dropped["_id"], "left_anti")
    again = materialise(found.groupBy("_id").count().where("count > 1").select("_id"), "repeated")
    if again.isEmpty():
        return kept
    once = kept.join(again, kept[id_col] == again["_id"], "left_anti")
    return once.unionByName(kept.join(again, kept[id_col] == again["_id"], "left_semi").dropDuplicates([id_col]))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of ``docs`` for each near-duplicate group, whatever its ids are: that with the smallest id, null ids last.

    Rows are told apart by id and digest of the text, so a row's verdict is that of its own group. Of
    equal ids in a group the smaller digest stays, and of rows equal in both any one. Texts move only
    where such rows repeat.
    """
    mark = lambda d: F.coalesce(digest(d[text_col]), F.lit(b""))
    key = F.struct(docs[id_col].isNull().alias("none"), docs[id_col].alias("id"), mark(docs).alias("digest"))
    slim = docs.select(key.alias("_key"), docs[text_col].cast("string").alias("_text"))
    # With these keys as ids, a group's component_id is the key of the row that stays.
    found = materialise(near_duplicates(slim, "_key", "_text", **how).select("_key", (F.col("_key") == F.col("component_id")).alias("stays")), "groups")
    own = [F.col("_key.id").alias("_id"), F.col("_key.digest").alias("_digest")]
    same = lambda d, k: d[id_col].eqNullSafe(k["_id"]) & (mark(d) == k["_digest"])
    dropped = small_or_not(materialise(found.where("not stays").select(*own).distinct(), "dropped"))
    kept = docs.join(dropped, same(docs, dropped), "left_anti")
    again = materialise(found.where("stays").select(*own).groupBy("_id", "_digest").count().where("count > 1").drop("count"), "repeated")
    if again.isEmpty():
        return kept
    again = small_or_not(again)
    once = kept.join(again, same(kept, again), "left_anti")
    more = kept.join(again, same(kept, again), "left_semi")
    own_mark = free_name("_digest", docs.columns)
    return once.unionByName(more.withColumn(own_mark, mark(more)).dropDuplicates([id_col, own_mark]).drop(own_mark))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
