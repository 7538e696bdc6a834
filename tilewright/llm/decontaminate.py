"""Benchmark decontamination with a distributed positional inverted index.

The index is partitioned by document: each shard row holds the posting lists (term -> ascending word
positions) of all words of about half a million consecutive ones. Positions run through the shard, with a gap
between documents that no phrase can bridge. A phrase is found by intersecting the offset-adjusted
lists of its terms, rarest list of the shard first; the result is exact. Building and searching are
narrow passes: no row of the corpus is shuffled, and no list of a frequent term meets in one task.

The windows of the benchmark lie in block files of bounded size in the shared folder. A search reads a
few shards at a time and takes one block after the other, so its memory does not grow with either side.
"""

from __future__ import annotations

import hashlib
import posixpath
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import alnum_words, at_work, filesystem, keeps, materialise, new_path, sliced, table

WINDOW = 13
#: Words, or documents, after which a shard is closed; a longer document ends its shard.
SHARD_WORDS, SHARD_DOCS = 1 << 19, 1 << 16
#: Words left free between two documents of a shard.
GAP = 64
#: Words of benchmark items in a block file.
BLOCK_WORDS = 1 << 18
#: Shards that are searched together where there are several blocks, and places of rarest terms that are followed at a time.
TOGETHER, PLACES = 4, 1 << 20

INDEX = "starts binary, sizes binary, terms binary, cuts binary, positions binary"
BLOCK = pa.schema([("terms", pa.binary()), ("tokens", pa.binary()), ("begins", pa.binary()), ("sizes", pa.binary()), ("cuts", pa.binary()), ("owners", pa.binary()), ("keys", pa.list_(pa.string()))])


def _pack(a: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(a).tobytes(), 1)


def _unpack(b: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), kind)


class _Shard:
    def __init__(self):
        self.ids, self.sizes, self.starts, self.terms, self.end, self.words = [], [], [], [], 0, 0
        self.lookup: dict[bytes, int] = {}

    def add(self, key, words: list[bytes]) -> None:
        number = self.lookup
        self.terms.append(np.array([number.setdefault(w, len(number)) for w in words], np.int32))
        self.ids.append(key)
        self.sizes.append(len(words))
        self.starts.append(self.end)
        self.end += len(words) + GAP
        self.words += len(words)

    @property
    def full(self) -> bool:
        return self.words >= SHARD_WORDS or len(self.ids) >= SHARD_DOCS

    def row(self) -> tuple:
        starts, sizes = np.array(self.starts, np.int64), np.array(self.sizes, np.int64)
        t = np.concatenate(self.terms)
        p = np.arange(len(t)) + np.repeat(starts - np.append(0, np.cumsum(sizes)[:-1]), sizes)
        order = np.argsort(t, kind="stable")
        t, p = t[order], p[order]
        cuts = np.append(np.flatnonzero(np.diff(t, prepend=-1)), len(t))
        return (self.ids, _pack(starts), _pack(sizes), zstandard.compress(b"\n".join(self.lookup), 1), _pack(cuts), _pack(np.diff(p, prepend=0).astype(np.int32 if self.end < 2**31 else np.int64)))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Index of all words of all texts, one row per shard.

    Every document is in the index, also without words; repeated rows and null ids are documents of their own.
    """
    slim = docs.select(docs[id_col], docs[text_col].cast("string"))
    key_type = slim.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("decontaminate")
        s, fields = _Shard(), []

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(s.row(), fields, strict=True)], schema=pa.schema(fields))

        for batch in sliced(batches):
            fields = fields or [pa.field("ids", pa.list_(batch.schema.field(0).type)), *(pa.field(n, pa.binary()) for n in ("starts", "sizes", "terms", "cuts", "positions"))]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s.add(key, alnum_words(text))
                if s.full:
                    yield emit()
                    s = _Shard()
        if s.ids:
            yield emit()

    return slim.mapInArrow(run, f"ids array<{key_type}>, {INDEX}")


class Postings:
    """The posting lists of a shard. Lists lie one after the other by term; ``keys`` are term * width + position, ascending."""

    def __init__(self, row: dict):
        self.starts = _unpack(row["starts"], np.int64)
        self.sizes = _unpack(row["sizes"], np.int64)
        self.cuts = _unpack(row["cuts"], np.int64)
        raw = zstandard.decompress(row["positions"])
        total = int(self.cuts[-1]) if len(self.cuts) else 0
        self.positions = np.cumsum(np.frombuffer(raw, np.int64 if total and len(raw) == 8 * total else np.int32).astype(np.int64))
        names = zstandard.decompress(row["terms"])
        self.terms = {w: i for i, w in enumerate(names.split(b"\n"))} if total else {}
        self.width = int(self.starts[-1] + self.sizes[-1]) + GAP if len(self.starts) else 1
        self.keys = np.repeat(np.arange(len(self.terms)), np.diff(self.cuts)) * self.width + self.positions if total else np.zeros(0, np.int64)

    def numbers(self, names: Sequence[bytes]) -> np.ndarray:
        """The shard's numbers of the terms, -1 where it lacks one."""
        get = self.terms.get
        return np.array([get(w, -1) for w in names], np.int64)

    def of(self, term: int) -> np.ndarray:
        return self.positions[self.cuts[term] : self.cuts[term + 1]] if term >= 0 else np.zeros(0, np.int64)

    def document(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, "right") - 1

    def phrases(self, terms: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(phrase, start position) of every occurrence of the phrases: term numbers, a row for each phrase of the same length.

        The places of a phrase's rarest term are shifted to where the phrase would begin and looked up
        in the lists of its other terms, the rarer first; PLACES of them are followed at a time.
        """
        there = np.flatnonzero((terms >= 0).all(1))
        if not len(there):
            return
        length = np.diff(self.cuts)
        offsets = np.argsort(length[terms[there]], axis=1, kind="stable")
        sizes = length[np.take_along_axis(terms[there], offsets[:, :1], 1)[:, 0]]
        ends = np.cumsum(sizes)
        low = 0
        while low < len(there):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PLACES, "right")))
            n = sizes[low:high]
            k = np.repeat(np.arange(low, high), n)
            first = self.cuts[terms[there[low:high], offsets[low:high, 0]]]
            at = self.positions[np.repeat(first - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(len(k))] - offsets[k, 0]
            k, at = k[at >= 0], at[at >= 0]
            for step in range(1, terms.shape[1]):
                if not len(k):
                    break
                off = offsets[k, step]
                want = terms[there[k], off] * self.width + at + off
                i = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
                ok = self.keys[i] == want
                k, at = k[ok], at[ok]
            if len(k):
                yield there[k], at
            low = high

    def near(self, terms: Sequence[int], slop: int) -> np.ndarray:
        """Ascending positions of the first term inside some ``slop`` consecutive words of a document that hold all terms.

        Every such stretch can begin at an occurrence of some term; for each term as the first one, the
        nearest later occurrence of all others has to come within the stretch and the document.
        """
        lists = [self.of(t) for t in terms]
        if any(not len(x) for x in lists):
            return np.zeros(0, np.int64)
        told = lists[0]
        inside = np.zeros(len(told) + 1, np.int64)
        for begin in lists:
            last = begin
            for x in lists:
                i = np.searchsorted(x, begin)
                nxt = np.where(i < len(x), x[np.minimum(i, len(x) - 1)], np.iinfo(np.int64).max // 2)
                last = np.maximum(last, nxt)
            d = self.document(begin)
            end = np.minimum(begin + slop, self.starts[d] + self.sizes[d])
            ok = last < end
            np.add.at(inside, np.searchsorted(told, begin[ok]), 1)
            np.add.at(inside, np.searchsorted(told, end[ok]), -1)
        return told[np.cumsum(inside[:-1]) > 0]


class _Block:
    """Items, or stretches of items, until they hold BLOCK_WORDS words; then their distinct windows."""

    def __init__(self):
        self.lookup: dict[bytes, int] = {}
        self.tokens, self.starts, self.sizes, self.owners, self.keys, self.at = [], [], [], [], {}, 0

    def add(self, key: str, words: list[bytes], window: int) -> None:
        n = len(words)
        count = max(1, n - window + 1)
        self.tokens.append(np.array([self.lookup.setdefault(w, len(self.lookup)) for w in words], np.int32))
        self.starts.append(self.at + np.arange(count))
        self.sizes.append(np.full(count, min(n, window)))
        self.owners.append(np.full(count, self.keys.setdefault(key, len(self.keys))))
        self.at += n

    def row(self) -> dict:
        tokens, starts, sizes, owners = map(np.concatenate, (self.tokens, self.starts, self.sizes, self.owners))
        out, pairs, taken = [], [], 0
        for n in np.unique(sizes):
            own = np.flatnonzero(sizes == n)
            rows = np.ascontiguousarray(tokens[starts[own][:, None] + np.arange(n)])
            _, first, which = np.unique(rows.view(np.dtype((np.void, rows.itemsize * int(n)))).ravel(), return_index=True, return_inverse=True)
            out.append((starts[own[first]], np.full(len(first), n)))
            pairs.append(np.unique(np.stack([which + taken, owners[own]], 1), axis=0))
            taken += len(first)
        pairs = np.concatenate(pairs)
        begins, sizes = (np.concatenate(x) for x in zip(*out, strict=True))
        cuts = np.searchsorted(pairs[:, 0], np.arange(taken + 1))
        return {
            "terms": zstandard.compress(b"\n".join(self.lookup), 1), "tokens": _pack(tokens), "begins": _pack(begins.astype(np.int64)), "sizes": _pack(sizes.astype(np.int64)),
            "cuts": _pack(cuts.astype(np.int64)), "owners": _pack(pairs[:, 1].astype(np.int64)), "keys": list(self.keys),
        }


class Windows:
    """The distinct windows of a block, by size, and the items of each."""

    def __init__(self, row: dict):
        self.terms = zstandard.decompress(row["terms"]).split(b"\n")
        tokens, begins, sizes = _unpack(row["tokens"], np.int32), _unpack(row["begins"], np.int64), _unpack(row["sizes"], np.int64)
        self.by_size = [(int(n), np.flatnonzero(sizes == n), tokens[begins[sizes == n][:, None] + np.arange(n)]) for n in np.unique(sizes)]
        self.cuts, self.owners, self.keys = _unpack(row["cuts"], np.int64), _unpack(row["owners"], np.int64), row["keys"]

    def items(self, windows: np.ndarray) -> set[str]:
        return {self.keys[i] for w in windows.tolist() for i in self.owners[self.cuts[w] : self.cuts[w + 1]].tolist()}


@lru_cache(maxsize=1)
def read_block(file: str) -> Windows:
    """A block of the shared folder; the last one is kept, so a benchmark of one block is read once per worker."""
    fs, name = filesystem(file)
    with fs.open_input_file(name) as f:
        return Windows(pa.ipc.open_file(f).read_all().to_pylist()[0])


keeps("decontaminate", read_block.cache_clear)


def write_blocks(items: DataFrame, key_col: str, text_col: str, window: int, block_words: int = BLOCK_WORDS) -> list[str]:
    """Block files with the windows of the distinct items (names; a name for each ``block_words`` words, which is all the driver gets).

    An item that is longer than a block goes on in the next one, over window - 1 common words. Only
    files that a task returns count, so a task that is run again leaves no trace.
    """
    path = new_path(items.sparkSession, "windows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("decontaminate")
        block, done = _Block(), 0
        task = TaskContext.get()
        fs, root = filesystem(path)

        def emit() -> pa.RecordBatch:
            nonlocal done
            name = f"block-{task.partitionId():06d}-{task.taskAttemptId()}-{done:06d}.arrow"
            done += 1
            fs.create_dir(root, recursive=True)
            with fs.open_output_stream(posixpath.join(root, name)) as out, pa.ipc.new_file(out, BLOCK) as w:
                w.write_table(pa.Table.from_pylist([block.row()], BLOCK))
            return pa.RecordBatch.from_arrays([pa.array([f"{path}/{name}"])], names=["file"])

        for batch in sliced(batches):
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = alnum_words(text)
                step = max(block_words, window)
                for low in range(0, max(len(words) - window + 1, 1) if words else 0, step):
                    block.add(key, words[low : low + step + window - 1], window)
                    if block.at >= block_words:
                        yield emit()
                        block = _Block()
        if block.at:
            yield emit()

    own = items.select(F.coalesce(items[key_col].cast("string"), F.lit("")).alias("k"), items[text_col].cast("string").alias("t")).where("t is not null").distinct()
    files = materialise(own.mapInArrow(run, "file string"), "window-files")
    return sorted(r.file for r in files.collect())


def _search(shards: list[dict], files: Sequence[str]) -> list[tuple[Postings, np.ndarray, dict[int, set[str]]]]:
    """For each shard its lists, the words that windows cover, and the items found by document."""
    held = [Postings(row) for row in shards]
    edges = [np.zeros(p.width + 1, np.int32) for p in held]
    found: list[dict[int, set[str]]] = [{} for _ in held]
    for file in files:
        block = read_block(file)
        for p, edge, own in zip(held, edges, found, strict=True):
            number = p.numbers(block.terms)
            for n, windows, tokens in block.by_size:
                for k, at in p.phrases(number[tokens]):
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + n, -1)
                    pairs = np.unique(np.stack([p.document(at), windows[k]], 1), axis=0)
                    cuts = np.flatnonzero(np.diff(pairs[:, 0], prepend=-1))
                    for d, part in zip(pairs[cuts, 0].tolist(), np.split(pairs[:, 1], cuts[1:]), strict=True):
                        own.setdefault(d, set()).update(block.items(part))
    return [(p, np.cumsum(edge[:-1]) > 0, own) for p, edge, own in zip(held, edges, found, strict=True)]


def per_document(index: DataFrame, id_col: str, files: Sequence[str]) -> DataFrame:
    """A row per document of the shards: id, n_words, n_hit, n_items, items_sha256, contaminated, item_ids."""
    key_type = index.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("decontaminate")
        for batch in sliced(batches, TOGETHER if len(files) > 1 else 1):
            rows = [dict(zip(batch.schema.names[1:], x, strict=True)) for x in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)]
            for i, (p, cover, found) in enumerate(_search(rows, files)):
                total = np.append(0, np.cumsum(cover, dtype=np.int64))
                hit = total[p.starts + p.sizes] - total[p.starts]
                items = [sorted(found.get(d, ())) for d in range(len(p.sizes))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i].values, pa.array(p.sizes), pa.array(hit), pa.array([len(x) for x in items], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]), pa.array((hit > 0) & (20 * hit >= p.sizes)), pa.array(items, pa.list_(pa.string()))],
                    names=[id_col, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "item_ids"],
                )

    return index.mapInArrow(run, f"`{id_col}` {key_type}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, item_ids array<string>")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per row of ``docs``: n_words, n_hit, n_items, items_sha256, contaminated, item_ids.

    A word is hit when it lies in an occurrence of a window (``window`` consecutive words of an item, or
    a whole shorter item); a document is contaminated when at least a twentieth of its words are hit.
    The index takes all words of the documents; the items are searched for in blocks of ``block_words``.
    Null or empty texts have no words, on either side; a null item_id counts as the empty string; repeated
    items count once; an empty benchmark hits nothing; further columns are ignored.
    """
    if not 0 < window <= GAP:
        raise ValueError(f"window must be 1 to {GAP}")
    files = write_blocks(items, item_col, item_text_col, window, block_words)
    return per_document(materialise(build_index(docs, id_col, text_col), "index"), id_col, files)


def phrase_search(index: DataFrame, phrases: Sequence[str], id_col: str = "doc_id") -> DataFrame:
    """(id, phrase, position) of every exact occurrence of the phrases' words in an index."""
    return _lookup(index, phrases, id_col, None)


def proximity_search(index: DataFrame, queries: Sequence[str], slop: int, id_col: str = "doc_id") -> DataFrame:
    """(id, phrase, position) of every occurrence of a query's rarest term inside ``slop`` words of a document that hold all terms, in any order.

    The rarest term is that of the whole index, of equally rare ones the first by bytes.
    """
    return _lookup(index, queries, id_col, slop)


def _counts(index: DataFrame, names: Sequence[bytes]) -> dict[bytes, int]:
    """Occurrences of the terms in the whole index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("decontaminate")
        for batch in sliced(batches, 1):
            p = Postings(batch.to_pylist()[0])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(names))), pa.array([len(p.of(t)) for t in p.numbers(names).tolist()], pa.int64())], names=["term", "n"])

    return {names[t]: int(n) for t, n in index.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect()}


def _lookup(index: DataFrame, phrases: Sequence[str], id_col: str, slop: int | None) -> DataFrame:
    words = [alnum_words(p) for p in phrases]
    key_type = index.schema["ids"].dataType.elementType.simpleString()
    total = {} if slop is None else _counts(index, sorted({w for ws in words for w in ws}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("decontaminate")
        for batch in sliced(batches, 1):
            row = batch.to_pylist()[0]
            p = Postings(row)
            for phrase, ws in zip(phrases, words, strict=True):
                if not ws:
                    continue
                if slop is None:
                    found = [at for _, at in p.phrases(p.numbers(ws)[None])]
                else:
                    found = [p.near(p.numbers(sorted(set(ws), key=lambda w: (total.get(w, 0), w))).tolist(), slop)]
                for at in found:
                    d = p.document(at)
                    yield pa.RecordBatch.from_arrays([pa.array([row["ids"][i] for i in d.tolist()], batch.schema.field(0).type.value_type), pa.array([phrase] * len(at), pa.string()), pa.array(at - p.starts[d])], names=[id_col, "phrase", "position"])

    return index.mapInArrow(run, f"`{id_col}` {key_type}, phrase string, position long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("item_ids")


#: Windows of the items and hits of the documents by joins on the windows' words.
SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), win AS (
  SELECT item_id, least(len(ws), 13) AS n, array_to_string(list_slice(ws, i, i + 12), ' ') AS phrase
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM b WHERE len(ws) > 0)
), sizes AS (SELECT DISTINCT n FROM win), phrases AS (SELECT DISTINCT n, phrase FROM win
), occ AS (
  SELECT d.doc_id, d.i, d.n, d.phrase
  FROM (SELECT doc_id, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS phrase
        FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, sizes WHERE len(ws) >= n)) d
  JOIN phrases USING (n, phrase)
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT o.doc_id, win.item_id FROM occ o JOIN win USING (n, phrase)) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)
"""
