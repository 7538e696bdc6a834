"""The whole toxicity query against a plain version, its results at every size, and labels with nulls."""

import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from tilewright.llm import toxicity

SMALL = "/root/testdata/sf0.001"


def plain_features(text):
    words = "".join(c if c.isalnum() or c == "'" or ord(c) > 127 else " " for c in (text or "")).split()
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w).encode() for w in words]
    out = set(words)
    for stem, n in Counter(w[:5] for w in words if len(w) > 5).items():
        out.add(b"^" + stem)
        if n > 1:
            out.add(b"^" + stem + b"2")
            k = 1
            while n * 256 // len(words) >= 2 ** (k - 1):
                out.add(b"^" + stem + b"r" + str(k).encode())
                k += 1
    return out


def plain_scores(docs, labels):
    """id -> score, with dense matrices: the samples are all learnable documents but those that share a range, which is so for small tables."""
    learn = lambda k: zlib.crc32(str(k).encode()) % 4 != 2

    def mixed(word, k):
        h = xxhash.xxh64(int(k).to_bytes(8, "little"), seed=xxhash.xxh64(word, seed=42).intdigest()).intdigest()
        return h - (1 << 64 if h >= 1 << 63 else 0)

    known = {k: y for k, y in labels.items() if learn(k) and y is not None}
    prior = min(max(sum(known.values()) / len(known), 1e-4), 0.9)
    ids = sorted((k for k in docs if learn(k)), key=lambda k: mixed(b"toxicity", k))
    first = {}
    for k in ids:  # of each range of a hash the first
        part = mixed(b"draw", k) % toxicity.DRAW_RANGES
        first[part] = min(first.get(part, (1 << 64, k)), (mixed(b"draw", k), k))
    drawn = {k for _, k in first.values()}
    feats = {k: plain_features(t) for k, t in docs.items()}
    pos, unl = [feats[k] for k in ids if known.get(k) == 1], [feats[k] for k in ids if k in drawn]
    n, m = len(pos), len(unl)
    p, u = Counter(f for x in pos for f in x), Counter(f for x in unl for f in x)

    def above(f):
        q = (p[f] + u[f]) / (n + m)
        return (p[f] / n - u[f] / m) / (q * (1 - q) * (1 / n + 1 / m) + 1e-12) ** 0.5

    names = sorted(f for f in p if p[f] >= max(2, n / 200) and above(f) > 1.5)
    scale = np.array([min(above(f) - 1.5, 8) / 4 for f in names])
    x = np.array([[f in d for f in names] for d in pos + unl]) * scale
    w = np.zeros(len(names) + 1)
    for seed in (3, 4):
        r, v = np.random.default_rng(seed), np.append(np.zeros(len(names)), np.log(prior / (1 - prior)))
        m1, m2, total, step = 0, 0, 0, 0
        for k in range(40):
            for a, b in zip(np.array_split(r.permutation(n), 5), np.array_split(r.permutation(m) + n, 5), strict=True):
                if not len(a) or not len(b):
                    continue
                step += 1
                za, zb = x[a] @ v[:-1] + v[-1], x[b] @ v[:-1] + v[-1]
                sa, sb = 1 / (1 + np.exp(-za)), 1 / (1 + np.exp(-zb))
                flip = np.log1p(np.exp(zb)).mean() < prior * np.log1p(np.exp(za)).mean()
                ga = (prior * sa if flip else -prior * np.ones(len(a))) / len(a)
                gb = (-sb if flip else sb) / len(b)
                g = np.append(x[a].T @ ga + x[b].T @ gb + 1e-4 * v[:-1], ga.sum() + gb.sum())
                m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
                v = v - 0.05 / (1 + 4 * k / 40) * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
            if 3 * k >= 80:
                total = total + v
        w += total / sum(3 * k >= 80 for k in range(40)) / 2
    weight = dict(zip(names, w[:-1] * scale, strict=True))
    return {k: 1 / (1 + np.exp(-(w[-1] + sum(weight.get(f, 0) for f in feats[k])))) for k in docs}


def test_query_equals_the_plain_version(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    got = {r.doc_id: r for r in toxicity.query(spark, SMALL).collect()}
    want = plain_scores(docs, labels)
    assert got.keys() == want.keys()
    for k, r in got.items():
        assert r.score == pytest.approx(want[k], abs=1e-6)
        assert (r.held_out, r.predicted) == (zlib.crc32(str(k).encode()) % 4 == 2, int(r.score >= 0.3))


@pytest.mark.parametrize(("sf", "recall", "precision"), [("sf0.001", None, None), ("sf0.01", 0.75, 0.95), ("sf0.1", 0.9, 0.95)])
def test_toxic_documents_are_found_at_every_size(spark, sf, recall, precision):
    """Of 9, 37 and 329 learnable positives: nearly all of them are found again, and most of the held-out ones."""
    labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")
    rows = toxicity.query(spark, f"/root/testdata/{sf}").join(labels, "doc_id").select("held_out", "toxic", "predicted").collect()
    own = [r for r in rows if not r.held_out and r.toxic]
    assert sum(r.predicted for r in own) >= 0.88 * len(own)
    if recall:
        held = [r for r in rows if r.held_out]
        hits = sum(r.predicted and r.toxic for r in held)
        assert hits >= recall * sum(r.toxic for r in held) and hits >= precision * sum(r.predicted for r in held)


def test_labels_with_nulls_and_repeated_ids(spark):
    docs = spark.createDataFrame([(i, ("vile " if i % 2 else "") + f"w{i} x{i}") for i in range(400)], "doc_id long, text string")
    rows = [(i, i % 2) for i in range(300)]
    odd = [*rows, *[(i, None) for i in range(0, 300, 3)], (None, 1), (None, None), *rows[:50], (10**6, 1)]
    a = toxicity.detect(docs, spark.createDataFrame(rows + [(10**6, 1)], "doc_id long, toxic int")).orderBy("doc_id").collect()
    b = toxicity.detect(docs, spark.createDataFrame(odd, "doc_id long, toxic int")).orderBy("doc_id").collect()
    assert a == b and sum(r.predicted for r in a) == 200
    nothing = toxicity.detect(docs, spark.createDataFrame([(1, None)], "doc_id long, toxic int"))
    assert {r.predicted for r in nothing.collect()} == {0}
