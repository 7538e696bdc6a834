"""Toxicity by non-negative positive-unlabelled learning in numpy.

Positives are confirmed toxic documents, the rest of the training sample is unlabelled text. With the
class prior ``p`` and the logistic loss, the risk is ``p * R(P, +) + max(0, R(U, -) - p * R(P, -))``; where
the bracket falls under zero in a batch, the step goes against it (Kiryo et al., 2017).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import at_work, digest, materialise, sliced, table, utf8

#: Bounds of the training sample: confirmed toxic documents and unlabelled ones, by a hash of the id.
MAX_POSITIVE, MAX_UNLABELLED = 3_000, 9_000
#: Ranges of the hash of which each gives one unlabelled id at most, however often ids repeat.
DRAW_RANGES = 1 << 16
#: A feature is learned from that two positive documents and this share of them have, and whose lift is above this; it counts for more the larger its lift, up to MOST_LIFT.
SHARE, MIN_LIFT, MOST_LIFT = 1 / 200, 1.5, 9.5
#: A stem's words in so many words are its rate.
RATE_WORDS = 256
#: Words that a task counts before it hands the counts on.
COUNT_WORDS = 100_000
THRESHOLD = 0.3

# ASCII letters in lower case, digits and bytes of other scripts stay; all else separates words.
_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b == 0x27 else 0x20 for b in range(256))


def words_of(text: str | None) -> set[bytes]:
    """The distinct words of a text, and the stems of longer ones (^ and five bytes) with marks of how often they are met.

    A stem that is met again has the mark 2, and a mark r1, r2, ... for each power of two, from 1 on, that
    its words in RATE_WORDS words of the text reach.
    """
    words = utf8(text).translate(_WORDS).split() if text else []
    own = Counter(words)
    stems: dict[bytes, int] = {}
    for w, n in own.items():
        if len(w) > 5:
            stems[w[:5]] = stems.get(w[:5], 0) + n
    out = set(own)
    for stem, n in stems.items():
        out.add(b"^" + stem)
        if n >= 2:
            out.add(b"^" + stem + b"2")
            out.update(b"^%sr%d" % (stem, k) for k in range(1, (n * RATE_WORDS // len(words)).bit_length() + 1))
    return out


class Classifier:
    def __init__(self, weights: dict[bytes, float], bias: float):
        self.weights, self.bias = weights, bias
        self.names = weights.keys()

    def __getstate__(self):
        return self.weights, self.bias

    def __setstate__(self, state):
        self.__init__(*state)

    def score(self, text: str | None) -> float:
        z = self.bias + sum(sorted(self.weights[w] for w in self.names & words_of(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def risk(w: np.ndarray, cols: np.ndarray, at: np.ndarray, n: int, m: int, prior: float) -> tuple[float, float, np.ndarray]:
    """(estimate of the risk, the bracket that must not be negative, gradient of the step) for one batch.

    Rows 0 to n - 1 are positive, the next m unlabelled; row at[i] has word cols[i], and the last weight
    is the bias. The estimate is prior * R(P, +) + max(0, bracket) with the bracket R(U, -) - prior * R(P, -)
    and logistic losses. Where the bracket is negative the step goes up its own gradient instead.
    """
    z = np.bincount(at, w[cols], n + m) + w[-1]
    s = 1 / (1 + np.exp(-z))
    # log(1 + exp(z)) is the loss of calling a document clean, log(1 + exp(-z)) that of calling it toxic.
    bracket = float(np.logaddexp(0, z[n:]).mean() - prior * np.logaddexp(0, z[:n]).mean())
    value = prior * float(np.logaddexp(0, -z[:n]).mean()) + max(0.0, bracket)
    g = np.zeros(n + m)
    if bracket >= 0:
        g[:n] = (prior * (s[:n] - 1) - prior * s[:n]) / n
        g[n:] = s[n:] / m
    else:
        g[:n] = prior * s[:n] / n
        g[n:] = -s[n:] / m
    return value, bracket, np.append(np.bincount(cols, g[at], len(w) - 1), g.sum())


def train(positive: Sequence[np.ndarray], unlabelled: Sequence[np.ndarray], names: Sequence[bytes], prior: float, rounds: int = 40, rate: float = 0.05, l2: float = 1e-4, batch: int = 2_048, seed: int = 3, runs: int = 2) -> Classifier:
    """nnPU with the logistic loss on the presence of features: the mean of ``runs`` fits with batches of their own.

    A document is the numbers of its features among ``names``, each scaled by its lift between the two
    samples, so that the penalty on the weights holds back what is more likely chance. Each fit goes by
    Adam over batches that mix both samples, with a falling rate, and averages its last third.
    """
    prior = min(max(prior, 1e-4), 0.9)
    base = float(np.log(prior / (1 - prior)))
    if not len(positive) or not len(unlabelled) or not len(names):
        return Classifier({}, base)
    docs = [np.sort(np.asarray(d, np.int64)) for d in (*positive, *unlabelled)]
    n, m = len(positive), len(unlabelled)
    count = lambda some: np.bincount(np.concatenate(some), minlength=len(names))
    scale = np.clip(lift(count(docs[:n]), count(docs[n:]), n, m) - MIN_LIFT, 0, MOST_LIFT - MIN_LIFT) / 4
    fits = [_descend(docs, n, scale, prior, rounds, rate, l2, batch, seed + k) for k in range(runs)]
    w = np.mean(fits, 0)
    w[:-1] *= scale
    return Classifier({x: float(v) for x, v in zip(names, w[:-1], strict=True) if v}, float(w[-1]))


def lift(p: np.ndarray, u: np.ndarray, n: int, m: int) -> np.ndarray:
    """By how many standard errors a feature's share of the n positives is above that of the m unlabelled."""
    both = (p + u) / (n + m)
    return (p / n - u / m) / np.sqrt(both * (1 - both) * (1 / n + 1 / m) + 1e-12)


def _descend(docs: Sequence[np.ndarray], n: int, scale: np.ndarray, prior: float, rounds: int, rate: float, l2: float, batch: int, seed: int) -> np.ndarray:
    m = len(docs) - n
    r = np.random.default_rng(seed)
    w, scale = np.zeros(len(scale) + 1), np.append(scale, 1.0)
    w[-1] = np.log(prior / (1 - prior))
    m1, m2 = np.zeros_like(w), np.zeros_like(w)
    steps = max(5, (n + m) // batch)  # small samples are gone through in as many steps
    step, mean, taken = 0, np.zeros_like(w), 0
    for k in range(rounds):
        now = rate / (1 + 4 * k / rounds)
        po, uo = np.array_split(r.permutation(n), steps), np.array_split(r.permutation(m) + n, steps)
        for a, b in zip(po, uo, strict=True):
            if not len(a) or not len(b):
                continue
            step += 1
            rows = np.concatenate([a, b])
            cols = np.concatenate([docs[i] for i in rows])
            at = np.repeat(np.arange(len(rows)), [len(docs[i]) for i in rows])
            grad = risk(w * scale, cols, at, len(a), len(b), prior)[2] * scale
            grad[:-1] += l2 * w[:-1]
            m1 = 0.9 * m1 + 0.1 * grad
            m2 = 0.999 * m2 + 0.001 * grad * grad
            w -= now * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        if 3 * k >= 2 * rounds:
            mean += w
            taken += 1
    return mean / max(taken, 1)


def draw(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(positive, text): the training sample, one text for each drawn id, written out.

    Drawn are the MAX_POSITIVE first toxic ids by hash, and MAX_UNLABELLED ids that are each the first of
    one of DRAW_RANGES ranges of another hash, so repeated ids count once and only the ranges' firsts
    are gathered. Of several texts of an id the one with the least digest counts. Ids go to the tasks
    as 64-bit hashes: 12,000 of them at most, whatever the type of the ids.
    """
    key = F.xxhash64(F.lit("toxicity"), id_col)
    pos = labels.where("y = 1").select(key.alias("h")).orderBy("h").limit(MAX_POSITIVE).withColumn("positive", F.lit(True))
    mixed = F.xxhash64(F.lit("draw"), id_col)
    firsts = docs.select(docs[id_col]).where(learnable(F.col(id_col))).groupBy(F.pmod(mixed, F.lit(DRAW_RANGES)).alias("part")).agg(F.min(F.struct(mixed.alias("m"), key.alias("h"))).alias("x"))
    unl = firsts.orderBy(F.xxhash64("part"), "part").limit(MAX_UNLABELLED).select("x.h", F.lit(False).alias("positive"))
    ids = materialise(pos.unionByName(unl), "drawn", 1)
    slim = docs.select(key.alias("key"), docs[text_col].cast("string").alias("text")).where(learnable(docs[id_col]))
    rows = slim.join(F.broadcast(ids), F.col("key") == F.col("h"))
    mark = F.coalesce(digest(F.col("text")), F.lit(b""))
    one = materialise(rows.groupBy("h", "positive").agg(F.min(F.struct(mark.alias("mark"), "text")).alias("x")).select("h", "positive", "x.text"), "sample")
    return one


def select_words(sample: DataFrame, n: int, m: int) -> list[bytes]:
    """The features with a lift above MIN_LIFT that two positives and a SHARE of them have, in order.

    They are counted where the texts are; only counts move, and only the chosen ones reach the driver. No
    number of them is set: a document adds to at most 1 / SHARE of them for each that it has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("toxicity")
        counts: dict[bytes, list[int]] = {}

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], names=["word", "p", "u"])

        for batch in sliced(batches):
            for positive, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w in words_of(text):
                    counts.setdefault(w, [0, 0])[0 if positive else 1] += 1
                if len(counts) >= COUNT_WORDS:
                    yield emit()
                    counts.clear()
        yield emit()

    n, m = max(n, 1), max(m, 1)
    found = sample.select("positive", "text").mapInArrow(run, "word binary, p long, u long").groupBy("word").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).where(F.col("p") >= max(2, n * SHARE))
    both = (F.col("p") + F.col("u")) / F.lit(float(n + m))
    above = (F.col("p") / F.lit(float(n)) - F.col("u") / F.lit(float(m))) / F.sqrt(both * (1 - both) * F.lit(1 / n + 1 / m) + F.lit(1e-12))
    return sorted(bytes(x.word) for x in found.where(above > MIN_LIFT).select("word").collect())


def word_numbers(sample: DataFrame, names: Sequence[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The numbers of the features of each sampled text: positives, and the others; four bytes for each that it has of ``names``."""
    index = {w: i for i, w in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("toxicity")
        for batch in sliced(batches):
            out = [np.array(sorted(index[w] for w in words_of(t) & index.keys()), "<u4").tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["h", "positive", "at"])

    got = sorted((h, bytes(at), p) for h, p, at in sample.select("h", "positive", "text").mapInArrow(run, "h long, positive boolean, at binary").collect())
    own = [(p, np.frombuffer(at, "<u4")) for _, at, p in got]
    return [x for p, x in own if p], [x for p, x in own if not p]


def learnable(id_column: Column) -> Column:
    """Rows whose labels may be learned from: crc32 of the id as text leaves other than 2 by 4."""
    return F.coalesce(F.crc32(id_column.cast("string")) % 4 != 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", prior: float | None = None) -> Classifier:
    """Fit from labels of learnable rows only.

    The class prior is the share of toxic ids among all learnable labels unless given. Unlabelled text
    is drawn from all learnable documents without looking at their labels. Reruns agree and the
    sample is the same at every cluster size; ids count once however often they repeat.
    """
    some = labels.select(labels[id_col], labels[label_col].alias("y")).where(learnable(F.col(id_col)) & F.col("y").isNotNull())
    by_id = some.groupBy(id_col).agg(F.max((F.col("y") == 1).cast("int")).alias("y"))
    if prior is None:
        got = by_id.agg(F.avg("y")).head()[0]
        prior = 0.01 if got is None else float(got)
    sample = draw(docs, by_id, id_col, text_col)
    counts = dict(sample.groupBy("positive").count().collect())
    names = select_words(sample, counts.get(True, 0), counts.get(False, 0))
    return train(*word_numbers(sample, names), names, prior)


def score(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """All columns of ``docs`` but those with one of ``names``, plus score and predicted under these; a narrow pass over whole texts.

    Null and empty texts get the score of a text without words.
    """
    keep = [c for c in docs.columns if c not in names]
    slim = docs.select(*(docs[c] for c in keep))
    at = keep.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("toxicity")
        for batch in sliced(batches):
            s = np.array([model.score(t) for t in batch.column(at).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*keep, *names])

    schema = T.StructType([*slim.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])
    return slim.mapInArrow(run, schema)


def detect(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted.

    held_out: crc32 of the id as text leaves 2 by 4 (a null id is not held out). Nulls in labels are no
    labels; of several labels of an id one toxic suffices; without positives the score is the prior.
    """
    model = fit(docs, labels, id_col, text_col, label_col)
    out = score(docs.select(docs[id_col], docs[text_col].cast("string").alias(text_col)), model, id_col, text_col)
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
    return out.select(id_col, held.alias("held_out"), "score", "predicted")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
