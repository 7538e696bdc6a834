"""Language identification by rank-order profiles of character n-grams (Cavnar and Trenkle, 1994).

A language's profile is the order of its most frequent n-grams over all documents it may be learned from.
A document's own order is compared with each profile: every n-gram of the document costs the number of
places it is out of place, or the length of a profile where the profile lacks it, and the language with
the least sum wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_LIMIT_BYTES, at_work, sliced, table
from .toxicity import learnable

#: Places of a profile; n-grams have one to three characters.
PLACES = 400
UNKNOWN = "und"
#: Characters that are cut into n-grams at a time, and distinct n-grams that a task counts before it hands the counts on.
PIECE, COUNT_GRAMS = 1 << 20, 1 << 19
#: Numbers of possible n-grams up to which they are counted by place instead of by sorting.
DENSE = 1 << 18

_WORD = re.compile(r"[^\W\d_]+")
_EDGE, _BITS = ord("_"), 21
Counts = tuple[np.ndarray, np.ndarray]


def marked_words(text: str | None) -> str:
    """Runs of letters in lower case with a mark before, between and after them; a text without letters has nothing."""
    words = _WORD.findall(text.lower()) if text else []
    return "_".join(("", *words, "")) if words else ""


def added(parts: Sequence[Counts]) -> Counts:
    """Counts of several tables as one, in the order of the n-grams' numbers."""
    if len(parts) == 1:
        return parts[0]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return grams, np.bincount(at, np.concatenate([n for _, n in parts]), len(grams)).astype(np.int64)


def gram_counts(marked: str) -> Counts:
    """(n-grams as numbers, ascending; how often each occurs) of words with marks, the mark alone left out.

    An n-gram lies within a word and the marks at its ends. Its number orders n-grams by length, then
    by code points.
    """
    codes = np.frombuffer(marked.encode("utf-32-le"), np.uint32)
    return added([_piece(codes[at : at + PIECE + 2], min(PIECE, len(codes) - at)) for at in range(0, len(codes), PIECE)])


def _piece(codes: np.ndarray, own: int) -> Counts:
    """Counts of the n-grams that begin at the first ``own`` places."""
    top = int(codes.max()) + 1
    if top <= DENSE:
        here = np.zeros(top, bool)
        here[codes] = True
        letters = np.flatnonzero(here)
        at = (np.cumsum(here) - 1)[codes]
    else:
        letters, at = np.unique(codes, return_inverse=True)
    size, mark = len(letters), int(np.searchsorted(letters, _EDGE))
    mark = mark if mark < size and letters[mark] == _EDGE else -1
    found = []
    grams = at
    for n in (1, 2, 3):
        if n > 1:
            grams = grams[: len(at) - n + 1] * size + at[n - 1 :]
        # No mark may lie inside, and a mark alone is no n-gram; two marks are never neighbours.
        keep = at[: len(grams)] != mark if n == 1 else at[1 : 1 + len(grams)] != mark if n == 3 else slice(None)
        some = grams[:own][keep[:own] if n != 2 else keep]
        if size**n <= DENSE:
            count = np.bincount(some)
            which = np.flatnonzero(count)
            count = count[which]
        else:
            which, count = np.unique(some, return_counts=True)
        number = np.zeros(len(which), np.int64)
        for k in range(n):
            number |= letters[which // size**k % size].astype(np.int64) << (_BITS * k)
        found.append((number, count.astype(np.int64)))
    return np.concatenate([g for g, _ in found]), np.concatenate([n for _, n in found])


def ranked(counts: Counts, places: int) -> np.ndarray:
    """The most frequent n-grams in order, equal counts by the n-gram's number."""
    grams, n = counts
    return grams[np.argsort(-n, kind="stable")[:places]]


class Profiles:
    """The order of n-grams of each language."""

    def __init__(self, orders: dict[str, Sequence[int]], places: int = PLACES):
        self.languages, self.places = sorted(orders), places
        index: dict[int, int] = {}
        at, col, rank = [], [], []
        for k, lang in enumerate(self.languages):
            for r, g in enumerate(orders[lang]):
                at.append(index.setdefault(int(g), len(index)))
                col.append(k)
                rank.append(r)
        self.index = index
        # The last row is that of n-grams in no profile; -1 marks what a profile lacks.
        self.rank = np.full((len(index) + 1, len(self.languages)), -1, np.int32)
        self.rank[at, col] = rank

    def distances(self, order: np.ndarray) -> np.ndarray:
        """The out-of-place distance of an order of n-grams to each profile, as a share of the largest there can be."""
        own = self.rank[[self.index.get(g, len(self.index)) for g in order.tolist()]]
        off = np.where(own < 0, self.places, np.abs(own - np.arange(len(order))[:, None]))
        return off.sum(0) / (self.places * len(order))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, 1 - distance); the first by name of equal ones, and ``und`` with 0 for texts without letters."""
        words = marked_words(text)
        if not words or not self.languages:
            return UNKNOWN, 0.0
        d = self.distances(ranked(gram_counts(words), self.places))
        k = int(d.argmin())
        return self.languages[k], float(1 - d[k])


def counted(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of (lang, text): n-grams are counted where the texts are, and only counts move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("language")
        parts: dict[str, list[Counts]] = {}

        def emit() -> Iterator[pa.RecordBatch]:
            for lang, own in parts.items():
                grams, n = added(own)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n)], names=["lang", "gram", "n"])
            parts.clear()

        for batch in sliced(batches):
            texts: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                texts.setdefault(lang, []).append(text or "")
            for lang, own in texts.items():
                parts[lang] = [added([*parts.get(lang, ()), gram_counts(marked_words("\n".join(own)))])]
            if sum(len(own[0][0]) for own in parts.values()) >= COUNT_GRAMS:
                yield from emit()
        yield from emit()

    return docs.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", places: int = PLACES) -> Profiles:
    """Profiles from all learnable rows with a language; a language whose texts have no letter has none.

    Each task passes on at most ``places`` candidates of a language after the counts are summed, so no
    language is gathered. What reaches the driver is ``places`` rows a language; profiles that would not
    fit the bound for what is shipped to tasks are an error.
    """
    rows = docs.where(learnable(docs[id_col]) & docs[lang_col].isNotNull()).select(docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text"))
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    top = counted(rows).withColumn("place", F.row_number().over(order)).where(F.col("place") <= places)
    most = BROADCAST_LIMIT_BYTES // (places * 16)
    orders: dict[str, list[tuple[int, int]]] = {}
    for lang, gram, place in top.select("lang", "gram", "place").toLocalIterator():
        orders.setdefault(lang, []).append((place, gram))
        if len(orders) > most:
            raise ValueError(f"profiles of more than {most} languages do not fit the tasks")
    return Profiles({lang: [g for _, g in sorted(own)] for lang, own in orders.items()}, places)


def identify(docs: DataFrame, model: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, lang_pred, score; a narrow pass over whole texts."""
    slim = docs.select(docs[id_col], docs[text_col].cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("language")
        for batch in sliced(batches):
            got = [model.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], names=[id_col, "lang_pred", "score"])

    return slim.mapInArrow(run, f"`{id_col}` {slim.schema[0].dataType.simpleString()}, lang_pred string, score double")


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", places: int = PLACES) -> DataFrame:
    """One row per row of ``docs``: id, held_out, lang_pred, score (1 less the distance as a share of the largest).

    held_out: crc32 of the id as text leaves 2 by 4; those rows, rows with a null id or language are not
    learned from. Null, empty and letterless texts are ``und`` with score 0, and so is every text where
    nothing could be learned. Repeated rows each count and each give a row; equal distances go to the
    first language by name; further columns are ignored; an empty table gives an empty one.
    """
    out = identify(docs, fit(docs, id_col, text_col, lang_col, places), id_col, text_col)
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
    return out.select(id_col, held.alias("held_out"), "lang_pred", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"))
