"""Token-ID output: sorted-string-table shards, one per range of document identifiers.

File: magic, compressed blocks, block index, Bloom filter, footer. A block holds entries in key order,
each as (length shared with the key before it, rest of the key, value); the first key of a block is
whole. The index has each block's first key, place, entries and the ids before it in the shard. Keys
are order-preserving bytes, values the ids as little-endian unsigned 16- or 32-bit integers.
"""

from __future__ import annotations

import io
import os
import posixpath
import re
import struct
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import at_work, filesystem, keeps, materialise, new_path, sliced, table
from .wordpiece import byte_alphabet

MAGIC = b"TSST0001"
#: Uncompressed bytes after which a block is closed; a larger value has a block of its own.
BLOCK_BYTES = 64 << 10
BLOOM_BITS, BLOOM_HASHES = 10, 7
FOOTER = struct.Struct("<QQQQQQQII8s")
END_ID = 2
#: Bytes of shards that a task reads back on average.
READ_BYTES = 32 << 20
#: Bytes of the input that a shard takes: at least the first, more where there would be more than MANY shards, at most the second; and that a core is put to for the sake of speed alone.
SHARD_BYTES, MANY, LEAST_BYTES = (16 << 20, 256 << 20), 20_000, 1 << 20
#: Distinct words in the new generation of a worker's memory; a text may go beyond it by its own words.
WORD_CACHE = 250_000

KEY_TYPES = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}
MANIFEST = pa.schema([("shard", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64()), ("min_key", pa.binary()), ("max_key", pa.binary())])


def encode_key(key: int | str | None) -> bytes:
    """Bytes that sort as the keys do: nulls first, then numbers, then strings."""
    if key is None:
        return b"\x00"
    if isinstance(key, str):
        return b"\x02" + key.encode()
    return b"\x01" + (key + (1 << 63)).to_bytes(8, "big")


def decode_key(raw: bytes) -> int | str | None:
    if raw[:1] == b"\x00":
        return None
    return raw[1:].decode() if raw[:1] == b"\x02" else int.from_bytes(raw[1:], "big") - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        c = b[at]
        at += 1
        n |= (c & 127) << shift
        if c < 128:
            return n, at
        shift += 7


class Bloom:
    def __init__(self, bits: bytearray | bytes, n_bits: int):
        self.bits, self.n = bits, n_bits

    @staticmethod
    def places(h: int, n: int) -> list[int]:
        a, b = h & 0xFFFFFFFF, h >> 32 | 1
        return [(a + i * b) % n for i in range(BLOOM_HASHES)]

    @classmethod
    def build(cls, hashes: Sequence[int]) -> Bloom:
        n = max(64, BLOOM_BITS * len(hashes))
        bits = np.zeros(n, np.uint8)
        if len(hashes):
            h = np.array(hashes, np.uint64)
            a, b = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
            for i in range(BLOOM_HASHES):
                bits[((a + np.uint64(i) * b) % np.uint64(n)).astype(np.int64)] = 1
        return cls(np.packbits(bits, bitorder="little").tobytes(), n)

    def may_hold(self, key: bytes) -> bool:
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in self.places(xxhash.xxh64_intdigest(key), self.n))


class Writer:
    """Writes one shard to a binary stream; keys have to come in ascending order and may repeat."""

    def __init__(self, out, wide: bool):
        self.out, self.wide, self.at = out, wide, 0
        self.block, self.raw, self.last, self.first, self.entries = [], 0, b"", b"", 0
        self.index, self.hashes, self.docs, self.tokens, self.before = [], [], 0, 0, 0
        self._put(MAGIC)

    def _put(self, b: bytes) -> None:
        self.out.write(b)
        self.at += len(b)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.docs and key < self.top:
            raise ValueError("keys out of order")
        if not self.entries:
            self.first, self.last, self.before = key, b"", self.tokens
        shared = len(os.path.commonprefix([self.last, key]))
        if not self.wide and len(ids) and ids.max() > 0xFFFF:
            raise ValueError("an id does not fit in 16 bits")
        value = ids.astype("<u4" if self.wide else "<u2").tobytes()
        head = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:]
        self.block += (head, value)
        self.raw += len(head) + len(value)
        self.last = self.top = key
        self.entries += 1
        self.docs += 1
        self.tokens += len(ids)
        self.hashes.append(xxhash.xxh64_intdigest(key))
        if self.raw >= BLOCK_BYTES:
            self._close_block()

    def _close_block(self) -> None:
        if self.entries:
            data = zstandard.compress(b"".join(self.block), 1)
            self.index.append(_varint(len(self.first)) + self.first + b"".join(map(_varint, (self.at, len(data), self.entries, self.before))))
            self._put(data)
            self.block, self.raw, self.entries = [], 0, 0

    def close(self) -> None:
        self._close_block()
        index, bloom = b"".join(self.index), Bloom.build(self.hashes)
        i, b = self.at, self.at + len(index)
        self._put(index)
        self._put(bloom.bits)
        self._put(FOOTER.pack(i, len(index), b, len(bloom.bits), bloom.n, self.docs, self.tokens, len(self.index), zlib.crc32(index), MAGIC[:7] + (b"4" if self.wide else b"2")))


class Reader:
    """Reads one shard from a seekable binary stream."""

    def __init__(self, f):
        self.f = f
        f.seek(0, io.SEEK_END)
        f.seek(f.tell() - FOOTER.size)
        i, i_len, b, b_len, bits, self.docs, self.tokens, n, crc, magic = FOOTER.unpack(f.read(FOOTER.size))
        if magic[:7] != MAGIC[:7]:
            raise ValueError("not a shard")
        self.kind = "<u4" if magic[7:] == b"4" else "<u2"
        raw = self._at(i, i_len)
        if zlib.crc32(raw) != crc:
            raise ValueError("the block index is damaged")
        self.bloom = Bloom(self._at(b, b_len), bits)
        self.first, self.blocks, at = [], [], 0
        for _ in range(n):
            k, at = _read_varint(raw, at)
            self.first.append(raw[at : at + k])
            at += k
            place = []
            for _ in range(4):
                v, at = _read_varint(raw, at)
                place.append(v)
            self.blocks.append(place)

    def _at(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        return self.f.read(n)

    def block(self, k: int) -> Iterator[tuple[bytes, np.ndarray, int]]:
        """(key, ids, ids before it in the shard) of the entries of block ``k``."""
        at, n, entries, before = self.blocks[k]
        raw, p, key = zstandard.decompress(self._at(at, n)), 0, b""
        for _ in range(entries):
            shared, p = _read_varint(raw, p)
            rest, p = _read_varint(raw, p)
            size, p = _read_varint(raw, p)
            key = key[:shared] + raw[p : p + rest]
            p += rest
            ids = np.frombuffer(raw, self.kind, size // int(self.kind[2]), p)
            p += size
            yield key, ids, before
            before += len(ids)

    def scan(self) -> Iterator[tuple[bytes, np.ndarray, int]]:
        for k in range(len(self.blocks)):
            yield from self.block(k)

    def get(self, key: bytes) -> list[np.ndarray]:
        """Ids of all entries of the key: Bloom filter, binary search in the block index, one or few blocks."""
        if not self.blocks or not self.bloom.may_hold(key):
            return []
        out = []
        for k in range(max(bisect_left(self.first, key) - 1, 0), len(self.blocks)):
            if self.first[k] > key:
                break
            out += [ids for own, ids, _ in self.block(k) if own == key]
        return out


#: Characters on which every Unicode version and the usual regular-expression engines agree; of white space only space and line feed.
_SETTLED = r"[\n\x20-\x7e\u00a1-\u024f\u0391-\u03a1\u03a3-\u03ce\u0410-\u044f\u2010-\u2027\u20ac]*+"


class Encoder:
    """The tokenizers library with a memory of words.

    A byte-level vocabulary splits a text into pieces before it merges, and no piece crosses the place
    before a space that a visible character follows. Where all spaces of a text are such, its ids are
    those of its words, each with the space before it, one after the other. Texts with other spaces,
    with characters outside the settled ones or with an added token in them go to the library whole.
    The memory has two generations: words met again move to the new one, and the old one is let go.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(definition)
        self.merge = self.tokenizer.model.tokenize
        self.written = {b: c for c, b in byte_alphabet().items()}
        self.settled = re.compile(_SETTLED).fullmatch
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.marks = {m: self.whole(m) for m in ".,;:!?"}
        self.feed = self.whole("\n")
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str) -> np.ndarray:
        if "  " in text or " \n" in text or text[-1:] == " " or not self.settled(text) or any(a in text for a in self.added):
            return np.frombuffer(self.whole(text), np.uint32)
        words = text.split(" ")
        new, old, marks = self.new, self.old, self.marks
        parts = list(map(new.get, words))
        parts[0] = self.whole(words[0])  # no space before it
        if None in parts:
            hard: list[int] = []
            for i in [i for i, p in enumerate(parts) if p is None]:
                w = words[i]
                # A word of letters is one piece, which the library's model merges, and so is a mark that ends it.
                if (own := new.get(w) or old.get(w)) is None:
                    if w.isalpha():
                        own = self.letters(w)
                    elif w[-1:] in marks and (core := w[:-1]).isalpha():
                        own = self.known(core) + marks[w[-1]]
                    elif w.count("\n") == 1 and (end := w.index("\n")) > 1 and w[end - 1] in marks and w[: end - 1].isalpha() and w[end + 1 :].isalpha():
                        # Sentence end, line feed, and a word without a space: seen once as a whole, so only its parts are kept.
                        parts[i] = self.known(w[: end - 1]) + marks[w[end - 1]] + self.feed + self.known(w[end:])
                        continue
                    else:
                        hard.append(i)
                        continue
                new[w] = parts[i] = own
            if hard:
                names = list({words[i] for i in hard})
                for w, e in zip(names, self.tokenizer.encode_batch_fast([" " + w for w in names], add_special_tokens=False), strict=True):
                    new[w] = array("I", e.ids).tobytes()
                for i in hard:
                    parts[i] = new[words[i]]
            if len(new) > WORD_CACHE:
                self.old, self.new = new, {}
        return np.frombuffer(b"".join(parts), np.uint32)

    def known(self, word: str) -> bytes:
        """Ids of a word of letters from the memory, else merged and kept."""
        if (own := self.new.get(word)) is None:
            own = self.new[word] = self.old.get(word) or self.letters(word)
        return own

    def letters(self, word: str) -> bytes:
        """Ids of a word of letters and the space before it (none where a line feed stands for it), merged by the library's model as one piece."""
        word = word[1:] if (bare := word[0] == "\n") else word
        raw = word if word.isascii() else word.encode().decode("latin-1").translate(self.written)
        return array("I", [t.id for t in self.merge(raw if bare else "\u0120" + raw)]).tobytes()


@lru_cache(maxsize=1)
def encoder_of(definition: str) -> Encoder:
    """One encoder per worker: its memory of pieces serves all tasks that the worker runs."""
    return Encoder(definition)


keeps("sstable", encoder_of.cache_clear)


def needs_wide(definition: str, end_id: int) -> bool:
    """Whether an id of the tokenizer, or ``end_id``, does not fit in 16 bits."""
    from tokenizers import Tokenizer

    return max(end_id, *Tokenizer.from_str(definition).get_vocab().values(), 0) > 0xFFFF


def shard_count(docs: DataFrame, text_col: str = "text") -> int:
    """How many shards the bytes of ``docs`` make, by SHARD_BYTES of its files each, or of its texts where it is no table of files.

    Of small tables every core gets one, while it has LEAST_BYTES to do.
    """
    try:
        sizes = docs.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")).distinct().agg(F.sum("size"))
        size = sizes.head()[0]
    except AnalysisException:  # not read from files
        size = docs.agg(F.sum(F.octet_length(docs[text_col].cast("string")))).head()[0]
    each = min(SHARD_BYTES[1], max(SHARD_BYTES[0], (size or 0) // MANY))
    cores = min(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-(size or 0) // LEAST_BYTES))
    return max(1, cores, -(-(size or 0) // each))


def write_shards(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID, wide: bool | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode all texts and write them as shards in key order; returns the manifest, one row per shard.

    Documents are dealt by range of their id, nulls first, and sorted within a range, repeated ids by
    text; each task writes one file under a name of its own attempt. Only files that the manifest names
    count, so a task that is run again or twice leaves no trace in the result. A null text is empty;
    further columns are ignored; an empty table gives an empty manifest; ids of other types than whole
    numbers and strings are a TypeError. Ids take 32 bits where ``wide``
    says so or, unless given, where the vocabulary or ``end_id`` goes beyond 16.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    if kind not in KEY_TYPES:
        raise TypeError(f"keys are whole numbers or strings, not {kind}")
    # Equal ids are told apart by text, and rows equal in both by their place in the input, which changes no result.
    slim = docs.select(docs[id_col].alias("k"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("t"), F.monotonically_increasing_id().alias("salt"))
    dealt = slim.repartitionByRange(shard_count(docs, text_col), "k", F.xxhash64("t"), "salt").sortWithinPartitions("k", "t").drop("salt")
    with open(tokenizer, encoding="utf-8") as f:
        definition = f.read()
    wide = needs_wide(definition, end_id) if wide is None else wide

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("sstable")
        task = TaskContext.get()
        name, writer, low, key = f"shard-{task.partitionId():06d}-{task.taskAttemptId()}.sst", None, None, None
        fs, root = filesystem(path)
        for batch in sliced(batches):
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                key = encode_key(k)
                if writer is None:
                    fs.create_dir(root, recursive=True)
                    low, encoder = key, encoder_of(definition)
                    out = fs.open_output_stream(posixpath.join(root, f"_{name}"))
                    writer = Writer(out, wide)
                writer.add(key, np.append(encoder.ids(t), np.uint32(end_id)))
        if writer is not None:
            writer.close()
            out.close()
            fs.move(posixpath.join(root, f"_{name}"), posixpath.join(root, name))
            yield pa.RecordBatch.from_pylist([{"shard": task.partitionId(), "file": f"{path}/{name}", "n_docs": writer.docs, "n_tokens": writer.tokens, "n_bytes": writer.at, "min_key": low, "max_key": key}], schema=MANIFEST)

    # A row per shard, in one file: the tasks themselves write nothing but their shards.
    return materialise(dealt.mapInArrow(run, "shard int, file string, n_docs long, n_tokens long, n_bytes long, min_key binary, max_key binary").repartition(1), "manifest")


def read_shards(manifest: DataFrame, id_type: str = "bigint", id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """A row per document from the files: id, start, n_tokens, ids_crc32, shard (and ids).

    The running total goes over the manifest, one row per shard; documents are read where their shard is.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.select("shard", "file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    n, size = manifest.agg(F.count("*"), F.coalesce(F.sum("n_bytes"), F.lit(0))).head()
    shards = based.repartition(max(1, min(n, max(size // READ_BYTES, manifest.sparkSession.sparkContext.defaultParallelism))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("sstable")
        for batch in batches:
            for row in batch.to_pylist():
                fs, name = filesystem(row["file"])
                with fs.open_input_file(name) as f:
                    reader = Reader(f)
                    for k in range(len(reader.blocks)):
                        rows = []
                        for key, ids, at in reader.block(k):
                            wide = ids.astype("<u4")
                            rows.append((decode_key(key), row["base"] + at, len(ids), zlib.crc32(wide.tobytes()), row["shard"], wide.tolist() if with_ids else None))
                        cols = list(zip(*rows, strict=True))[: len(names)]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    names = [id_col, "start", "n_tokens", "ids_crc32", "shard"] + ["ids"] * with_ids
    types = [KEY_TYPES[id_type], pa.int64(), pa.int64(), pa.int64(), pa.int32()] + [pa.list_(pa.int64())] * with_ids
    return shards.mapInArrow(run, f"`{id_col}` {id_type}, start long, n_tokens long, ids_crc32 long, shard int" + ", ids array<bigint>" * with_ids)


def lookup(manifest: DataFrame, keys: Sequence[int | str | None]) -> dict[int | str | None, list[list[int]]]:
    """Ids of the stated keys by key range, Bloom filter and binary search, read from the few shards that may hold them."""
    want = sorted((encode_key(k), k) for k in keys)
    out: dict = {k: [] for k in keys}
    if not want:
        return out
    for row in manifest.where((F.col("min_key") <= F.lit(want[-1][0])) & (F.col("max_key") >= F.lit(want[0][0]))).orderBy("shard").toLocalIterator():
        fs, name = filesystem(row["file"])
        with fs.open_input_file(name) as f:
            reader = Reader(f)
            for raw, k in want:
                if bytes(row["min_key"]) <= raw <= bytes(row["max_key"]):
                    out[k] += [x.tolist() for x in reader.get(raw)]
    return out


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_corpus(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents to shards in the shared folder and read them back: id, start, n_tokens, ids_crc32, shard."""
    manifest = write_shards(docs, tokenizer or default_tokenizer(), new_path(docs.sparkSession, "shards"), id_col=id_col, text_col=text_col)
    return read_shards(manifest, docs.schema[id_col].dataType.simpleString(), id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))
