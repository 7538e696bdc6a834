"""Token counts: greedy longest-match word pieces by a linear automaton that never builds a piece.

The vocabulary is a trie over bytes. Where a word cannot go on from a node, the node's failure link
leads to where the rest of the word stands after the pieces that are certain by then; how many those
are is stored with the link. A word so takes time in proportion to its length, whatever the pieces.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import BROADCAST_LIMIT_BYTES, sliced, table, utf8

#: Distinct words whose count is remembered per worker; the memory is emptied beyond it, which costs time only.
WORD_CACHE = 500_000


class Automaton:
    """``first``: pieces that may start a word; ``rest``: pieces that may follow. ``unknown`` is the count of a word that has no split."""

    def __init__(self, first: Iterable[bytes], rest: Iterable[bytes], unknown: int = 1):
        self.unknown = unknown
        self.go: dict[int, int] = {}
        self.fail, self.pops, piece = [-1, -1], [0, 0], [False, False]  # node 0: a word's start, node 1: after a piece
        for root, pieces in ((0, first), (1, rest)):
            for p in pieces:
                at = root
                for c in p:
                    nxt = self.go.get(at << 8 | c)
                    if nxt is None:
                        nxt = self.go[at << 8 | c] = len(piece)
                        piece.append(False)
                        self.fail.append(-1)
                        self.pops.append(0)
                    at = nxt
                piece[at] = piece[at] or at > 1
        below: dict[int, list[tuple[int, int]]] = {}
        for edge, node in self.go.items():
            below.setdefault(edge >> 8, []).append((edge & 255, node))
        queue = deque((0, 1))
        go, fail, pops = self.go, self.fail, self.pops
        while queue:
            v = queue.popleft()
            for c, u in below.get(v, ()):
                if piece[u]:
                    fail[u], pops[u] = 1, 1
                else:
                    z, n = fail[v], pops[v]
                    while z >= 0 and (z << 8 | c) not in go:
                        n += pops[z]
                        z = fail[z]
                    if z >= 0:
                        fail[u], pops[u] = go[z << 8 | c], n
                queue.append(u)

    def count(self, word: bytes) -> int:
        """Pieces of the greedy longest-match split, ``unknown`` where a part of the word matches nothing."""
        go, fail, pops = self.go, self.fail, self.pops
        at = n = 0
        for c in word:
            while (nxt := go.get(at << 8 | c)) is None:
                if fail[at] < 0:
                    return self.unknown
                n += pops[at]
                at = fail[at]
            at = nxt
        while at != 1:
            if fail[at] < 0:
                return self.unknown if word else 0
            n += pops[at]
            at = fail[at]
        return n


def byte_alphabet() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write for the 256 bytes."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


def byte_level_pieces(path: str) -> tuple[list[bytes], list[bytes]]:
    """(first, rest) of a byte-level vocabulary file: pieces that begin with a space start words, the space taken off."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    code = byte_alphabet()
    pieces = [bytes(code[c] for c in p) for p in vocabulary if all(c in code for c in p)]
    return [p[1:] for p in pieces if p[:1] == b" " and len(p) > 1], [p for p in pieces if p[:1] != b" "]


class _Counts(dict):
    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self[word] = self.automaton.count(word)
        return n


def count_pieces(docs: DataFrame, first: Iterable[bytes], rest: Iterable[bytes], unknown: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_pieces, n_unknown (words without a split, counted as ``unknown`` pieces).

    Words are runs of other than the six ASCII white-space characters. Null and empty texts have none;
    repeated rows and null ids each give their own row; further columns are ignored. The vocabulary is
    shipped to the tasks and has to stay under BROADCAST_LIMIT_BYTES; it does not grow with the documents.
    """
    first, rest = list(first), list(rest)
    if sum(map(len, first)) + sum(map(len, rest)) > BROADCAST_LIMIT_BYTES:
        raise ValueError("vocabulary too large to ship to every task")
    slim = docs.select(docs[id_col], docs[text_col].cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(Automaton(first, rest, -1))
        for batch in sliced(batches):
            n_words, n_pieces, n_unknown = [], [], []
            for text in batch.column(1).to_pylist():
                words = utf8(text).split() if text else []
                if len(counts) > WORD_CACHE:
                    counts.clear()
                got = [counts[w] for w in words]
                bad = got.count(-1)
                n_words.append(len(words))
                n_pieces.append(sum(got) + bad * (1 + unknown))
                n_unknown.append(bad)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n_pieces, n_unknown))], names=[id_col, "n_words", "n_pieces", "n_unknown"])

    return slim.mapInArrow(run, f"`{id_col}` {slim.schema[0].dataType.simpleString()}, n_words long, n_pieces long, n_unknown long")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return count_pieces(table(spark, sf_dir, "documents"), *byte_level_pieces(path or default_vocabulary()))
