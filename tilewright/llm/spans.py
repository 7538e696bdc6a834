"""What the secret and the personal-data scan share: running patterns and a field over whole texts."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from . import crf
from .common import at_work, sliced

Span = tuple[str, int, int]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def uncovered(extra: list[Span], base: list[Span]) -> list[Span]:
    """The spans of ``extra`` that share no character with any of ``base``; by bisection in the sorted starts of ``base``."""
    spans = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in spans]
    reach = list(accumulate((b for _, b in spans), max))  # how far the spans up to each one go
    before = ((x, bisect_left(starts, x[2])) for x in extra)
    return [x for x, n in before if not n or reach[n - 1] <= x[1]]


def scan(
    docs: DataFrame,
    base: Callable[[str], list[Span]],
    base_kinds: tuple[str, ...],
    model: crf.Model,
    file_features: Callable[[str], list[str]],
    order: Callable[[list[Span]], list[Span]],
    text_col: str,
    id_col: str,
    accept: Callable[[str, str], bool] = lambda kind, value: True,
) -> DataFrame:
    """One row per row of ``docs``: id, a count for each base kind, base_sha256, spans, n_added, found.

    A narrow pass without any shuffle: each Arrow batch is scanned where it was read, so an executor
    that is lost costs its unfinished batches only. Spans of the field that meet a base span or that
    ``accept`` (kind, value) rules out are left out.
    """
    labels = model.labels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("spans")
        for batch in sliced(batches):
            ids = batch.column(0)
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tagged = model.decode([(t.split(), file_features(t)) for t in texts])
            rows = []
            for text, tags in zip(texts, tagged, strict=True):
                own = base(text)
                more = crf.token_spans(text, tags, lambda t: labels[t][0] == "B", lambda t: labels[t][2:])
                more = [x for x in uncovered(more, own) if accept(x[0], text[x[1] : x[2]])]
                every = order(own + more)
                rows.append((
                    *(sum(k == s[0] for s in own) for k in base_kinds),
                    hashlib.sha256(joined(order(own)).encode()).hexdigest(),
                    joined(every),
                    len(more),
                    [{"kind": k, "start": a, "end": b, "value": text[a:b]} for k, a, b in every],
                ))
            cols = list(zip(*rows, strict=True)) if rows else [()] * (len(base_kinds) + 4)
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names)

    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())])
    types = [pa.int64()] * len(base_kinds) + [pa.string(), pa.string(), pa.int64(), pa.list_(span)]
    names = [id_col, *(f"n_{k}" for k in base_kinds), "base_sha256", "spans", "n_added", "found"]
    slim = docs.select(docs[id_col], docs[text_col].cast("string"))
    kinds = ", ".join(f"n_{k} long" for k in base_kinds)
    schema = f"`{id_col}` {slim.schema[0].dataType.simpleString()}, {kinds}, base_sha256 string, spans string, n_added long, found array<struct<kind:string,start:int,end:int,value:string>>"
    return slim.mapInArrow(run, schema)
