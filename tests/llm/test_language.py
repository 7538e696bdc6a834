"""Rank-order profiles against a plain version, on held-out documents and on odd inputs."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tilewright.llm import language

SMALL = "/root/testdata/sf0.001"


def plain_counts(text):
    out = Counter()
    for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
        word = f"_{word}_"
        out.update(word[i : i + n] for n in (1, 2, 3) for i in range(len(word) - n + 1) if word[i : i + n] != "_")
    return out


def number(gram):
    x = 0
    for c in gram:
        x = x << 21 | ord(c)
    return x


def plain_order(counts, places):
    return sorted(counts, key=lambda g: (-counts[g], len(g), g))[:places]


def plain_detect(rows, places):
    """(held_out, lang, score) of each (id, text, lang), by dictionaries."""
    held = [k is not None and zlib.crc32(str(k).encode()) % 4 == 2 for k, _, _ in rows]
    total = {}
    for (k, text, lang), h in zip(rows, held, strict=True):
        if k is not None and not h and lang is not None:
            total.setdefault(lang, Counter()).update(plain_counts(text))
    profiles = {lang: {g: r for r, g in enumerate(plain_order(c, places))} for lang, c in sorted(total.items()) if c}
    out = []
    for (_, text, _), h in zip(rows, held, strict=True):
        own = plain_order(plain_counts(text), places)
        if not own or not profiles:
            out.append((h, "und", 0.0))
            continue
        cost = {lang: sum(abs(r - p[g]) if g in p else places for r, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(cost, key=lambda x: (cost[x], x))
        out.append((h, best, 1 - cost[best] / (places * len(own))))
    return out


@pytest.mark.parametrize("text", ["", "1 2 _", "a", "A b_c é ß", "漢字 かな ab", "İstanbul Ǆ", "x" * 5000, "ab" * 3000 + " 𝒳𝒴 z"])
def test_counts_are_those_of_plain_slices(text, monkeypatch):
    want = {number(g): n for g, n in plain_counts(text).items()}
    for piece, dense in ((1 << 20, 1 << 18), (7, 1 << 18), (64, 2)):
        monkeypatch.setattr(language, "PIECE", piece)
        monkeypatch.setattr(language, "DENSE", dense)
        marked = language.marked_words(text)
        if not marked:
            assert not want
            continue
        grams, n = language.gram_counts(marked)
        assert dict(zip(grams.tolist(), n.tolist(), strict=True)) == want
        assert (np.diff(grams) > 0).all()


@pytest.mark.parametrize("places", [400, 25])
def test_query_equals_the_plain_version(spark, places, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    monkeypatch.setattr(language, "COUNT_GRAMS", 500)
    got = {r.doc_id: r for r in language.detect(docs.repartition(5), places=places).collect()}
    assert len(got) == len(rows)
    for (k, _, _), (held, lang, score) in zip(rows, plain_detect(rows, places), strict=True):
        assert (got[k].held_out, got[k].lang_pred) == (held, lang)
        assert abs(got[k].score - score) < 1e-12


def test_held_out_documents_are_told(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.detect(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.count() > 100
    assert got.where("lang = lang_pred").count() >= 0.98 * got.count()


def test_language_odd_rows(spark):
    """Nulls, empty and letterless texts, repeated rows and ids, ties of profiles, long texts, clashing columns, an empty table."""
    rows = [
        (1, "the one and the other", "en", "x", 1), (1, "the one and the other", "en", "x", 1), (2, None, None, None, None), (3, "", "en", "x", 0), (4, "12 _ !!", "de", None, 4),
        (None, "der die das", "de", "y", 2), (5, "x" * 50_000, "zz", "x", 3), (7, "w " * 30_000, "zz", "y", 4), (8, "漢字 漢", "ja", "z", 5), (9, "abc", "t2", "z", 5), (10, "abc", "t1", "z", 5), (11, "the other", None, "z", 6),
    ]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score int")
    got = sorted((str(r.doc_id), r.held_out, r.lang_pred, round(r.score, 12)) for r in language.detect(odd).collect())
    want = plain_detect([r[:3] for r in rows], language.PLACES)
    assert got == sorted((str(r[0]), h, lang, round(s, 12)) for r, (h, lang, s) in zip(rows, want, strict=True))
    empty = language.detect(odd.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "held_out", "lang_pred", "score"]
    unlabelled = language.detect(odd.selectExpr("doc_id", "text", "cast(null as string) as lang"))
    assert {(r.lang_pred, r.score) for r in unlabelled.collect()} == {("und", 0.0)}


def test_profiles_that_do_not_fit_are_an_error(spark, monkeypatch):
    docs = spark.range(40).selectExpr("id as doc_id", "'some words' as text", "cast(id as string) as lang")
    monkeypatch.setattr(language, "BROADCAST_LIMIT_BYTES", 400 * 16 * 5)
    with pytest.raises(ValueError, match="languages"):
        language.fit(docs)
