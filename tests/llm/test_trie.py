"""The trie of conversation prefixes against one built node by node, in one part and in many, and against SQL."""

import hashlib
import random
import zlib

import duckdb
import pytest

from tilewright.llm import trie

SMALL = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def plain_trie(rows):
    """Rows of the result, by a dictionary from each prefix to its members."""
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v, key=lambda x: x[:3])] for c, v in own.items()}
    members, ends = {}, {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole = (*own.get(c - (abs(c) % 20) * (1 if c > 0 else -1), ())[:h], *mine[h:])
        for d in range(len(whole) + 1):
            members.setdefault(whole[:d], []).append(c)
        ends.setdefault(whole, []).append(c)
    saved, leaves, kids = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        gain = (len(m) - 1) * len(p[-1][1].split()) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += gain
            leaves[p[:d]] += not kids[p]
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends.get(p, ())))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], sha(p)) for p, m in members.items())


def rows_of(df):
    return sorted(tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


def family(seed, n, most, alphabet=2):
    """Conversations with long common beginnings: a turn is one of few texts, and some are whole copies or continuations."""
    r = random.Random(seed)
    out, seen = [], []
    for c in r.sample(range(3 * n), n):
        turns = [("u" if i % 2 else "a", " ".join("w" * r.randint(1, 3) for _ in range(r.randint(0, alphabet)))) for i in range(r.randint(1, most))]
        if seen and r.random() < 0.6:
            turns = r.choice(seen)[: r.choice((most, r.randint(1, most)))] + turns[: r.choice((0, 0, 1, 4))]
        seen.append(turns)
        out += [(c, i, *t) for i, t in enumerate(turns)]
    return out


@pytest.mark.parametrize(("block", "part"), [(256, 1 << 14), (256, 7), (4, 1 << 14), (3, 5), (1, 9)])
@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_one_built_node_by_node(spark, block, part, seed):
    rows = family(seed, 120, 9)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert rows_of(trie.prefix_trie(df, block=block, part_turns=11, part_blocks=part)) == plain_trie(rows)


def test_walk_of_many_parts_equals_one_part():
    """The stack alone, cut at every place: shares of points added up are those of the whole."""
    r = random.Random(5)
    for _ in range(60):
        rows = sorted({bytes(b for x in (r.randint(0, 1) for _ in range(r.randint(1, 7))) for b in [x] * 16) for _ in range(12)})
        cuts = sorted(r.sample(range(1, len(rows)), min(3, len(rows) - 1))) if len(rows) > 1 else []

        def walked(cuts, rows=rows):
            out, low = [], 0
            for high in [*cuts, len(rows)]:
                before = trie.shared(rows[low - 1], rows[low]) if low else -1
                after = trie.shared(rows[high - 1], rows[high]) if high < len(rows) else -1
                walk = trie.Walk(0, 0, 0, before, 256, out)
                for i in range(low, high):
                    walk.add(rows[i], [1] * (len(rows[i]) // 16), 1, i, 1, i, 0, 0, 0, 0, None)
                walk.close(after, after >= 0 and after * 16 == len(rows[high - 1]))
                low = high
            total = {}
            for d, n, conv, ends, _, s, leaves, kids, suffix, *_ in out:
                for i, w in enumerate(suffix):
                    at = (d - len(suffix) + 1 + i, bytes(rows[conv][: 16 * (d - len(suffix) + 1 + i)]))
                    last = i == len(suffix) - 1
                    old = total.get(at, (0, 0, 0, 0, 0))
                    total[at] = tuple(a + b for a, b in zip(old, (n, ends if last else 0, s + (n - 1) * max(w - 1, 0), leaves, kids if last else 1), strict=True))
            return total

        one, many = walked([]), walked(cuts)
        assert one.keys() == many.keys()
        assert one == many


def test_trie_of_a_hot_first_turn_copies_and_a_dominating_conversation(spark):
    rows = [(c, 0, "u", "same start") for c in range(300)] + [(c, 1, "a", f"reply {c % 7}") for c in range(200)] + [(1000, t, "u", f"t {t % 50}") for t in range(700)] + [(1005, t, "u", f"t {t % 50}") for t in range(690)]
    rows += [(c, t, "u", "copy") for c in range(2000, 2400) for t in range(2)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert rows_of(trie.prefix_trie(df, block=64, part_turns=100, part_blocks=16)) == plain_trie(rows)


def test_trie_odd_rows(spark):
    """Nulls in every column, empty and long texts, equal turns and rows, absent families, turnless conversations, negative ids, clashing columns."""
    rows = [
        (None, 0, "u", "x"), (0, None, "u", "first"), (0, 0, None, None), (0, 0, "", ""), (0, 1, "a", "b c"), (0, 1, "a", "b c"), (3, 5, "u", "y" * 50_000), (3, 7, "u", "w " * 30_000), (4, 0, "ua", "b"), (5, 0, "u", "ab"),
        (27, 0, "u", "alone"), (29, 0, "u", "one"), (29, 1, "a", "two"), (41, 0, "u", "z"), (42, 0, "u", "z"), (43, 0, "u", "z"), (-7, 0, "u", "z"), (-7, 1, "u", "é ß 漢"), (2**62, 1, None, " \n\t "), (2**62 + 1, 1, None, " \n\t "),
    ]
    df = spark.createDataFrame([(*r, "x", 1, b"d") for r in rows], SCHEMA + ", depth string, n int, digest binary")
    got = rows_of(trie.prefix_trie(df))
    assert got == plain_trie(rows)
    assert trie.prefix_trie(df.limit(0)).count() == 0
    assert trie.prefix_trie(df.where("conv_id is null")).count() == 0
    bare = [(c, 0, "u", "gone") for c in (41, 42, 47, 61, 62) if zlib.crc32(str(c).encode()) % 4]
    assert rows_of(trie.prefix_trie(spark.createDataFrame(bare, SCHEMA))) == plain_trie(bare)
    assert len(plain_trie(bare)) == 1 and plain_trie(bare)[0][5] == 1


def test_trie_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SMALL}/conversations.parquet'")
    want = con.execute(f"select conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 from ({trie.SQL})").fetchall()
    assert rows_of(trie.query(spark, SMALL)) == sorted(want)
    for c in (0, 7, 20, 12345, -3):
        assert con.execute(f"select {trie._CRC} from (select {c}::BIGINT as c)").fetchall()[0][0] == zlib.crc32(str(c).encode())
