"""Secret scan: fixed patterns plus a linear-chain conditional random field over the words of a file."""

from __future__ import annotations

import random
import re
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crf, spans
from .common import table

LABELS = ("O", "B-crf", "I-crf")
KINDS = ("assign", "access", "hex")
#: Most rows of the labelled table that a fit reads.
MAX_LABELLED = 2_000

_ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_CUE = re.compile(r"(?ai:passw|secret|token|api_?key)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")


def base_spans(text: str) -> list[spans.Span]:
    """Leftmost non-overlapping matches per kind that pass the kind's length rule, in no set order.

    A match of the whole ``[0-9a-f]+`` starts where its run starts, so asking for 24 at once is the same.
    """
    out = []
    if _CUE.search(text):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]


def in_order(found: list[spans.Span]) -> list[spans.Span]:
    rank = {k: i for i, k in enumerate((*KINDS, "crf"))}
    return sorted(found, key=lambda s: (s[1], rank[s[0]], s[2]))


def file_features(text: str) -> list[str]:
    """What the whole file looks like: code-like punctuation, settings lines, key blocks."""
    out = []
    if text.count("=") * 200 > len(text):
        out.append("settings")
    if (text.count("{") + text.count(";")) * 100 > len(text):
        out.append("code")
    if "-----BEGIN" in text:
        out.append("key-block")
    return out


def labelled_rows(seed: int = 11, n: int = 1_000) -> list[tuple[list[str], list[str], list[str]]]:
    """The small labelled table: invented lines with and without secrets, as (words, tags, file features)."""
    r = random.Random(seed)
    pick = lambda chars, lo, hi: "".join(r.choice(chars) for _ in range(r.randint(lo, hi)))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    b62 = low + up + dig

    def secret() -> str:
        return r.choice((
            lambda: "gh" + r.choice("pous") + "_" + pick(b62, 36, 36), lambda: "sk-" + pick(b62, 24, 48), lambda: "xox" + r.choice("bp") + "-" + pick(dig, 10, 12) + "-" + pick(b62, 20, 24),
            lambda: "AKIA" + pick(up + dig, 16, 16), lambda: "AIza" + pick(b62 + "_-", 35, 35), lambda: "eyJ" + pick(b62, 20, 30) + "." + pick(b62, 20, 40) + "." + pick(b62 + "_-", 20, 40),
            lambda: pick("0123456789abcdef", 32, 64), lambda: pick(b62, 20, 44), lambda: pick(b62 + "+/", 30, 60) + "=",
        ))()

    def phrase() -> str:
        """A secret of letters only, or of digits only, as it is told after a cue."""
        title = lambda: "".join(pick(low, 3, 8).capitalize() for _ in range(r.randint(2, 4)))
        return r.choice((title, title, lambda: pick(low + up, 10, 24), lambda: pick(dig, 8, 16), lambda: "-".join(pick(low, 3, 7) for _ in range(r.randint(3, 5)))))()

    def word() -> str:
        if r.random() < 0.02:  # a name in a program
            return "".join(pick(low, 3, 9).capitalize() for _ in range(r.randint(2, 4)))
        w = pick(low, 1, 11)
        return w.capitalize() if r.random() < 0.12 else w + r.choice(("", "", "", ",", "."))

    def plain() -> str:
        x = r.random()
        if x < 0.86:
            return word()
        return r.choice((
            lambda: pick(dig, 1, 6), lambda: f"{r.randint(1900, 2040)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", lambda: f"v{r.randint(0, 9)}.{r.randint(0, 20)}", lambda: pick(low, 3, 9) + r.choice(("", "." + pick(dig, 1, 3))) + "@" + pick(low, 3, 8) + r.choice(("", str(r.randint(1, 9)))) + r.choice((".com", ".example.com")), lambda: pick(low, 2, 16) + "." + pick(dig, 1, 3) + "@" + pick(low, 3, 8) + pick(dig, 1, 1) + r.choice((".com", ".example.com")), lambda: "+1", lambda: f"({pick(dig, 3, 3)})", lambda: f"{pick(dig, 3, 3)}-{pick(dig, 4, 4)}",
            lambda: pick(dig, 16, 16), lambda: ".".join(pick(dig, 1, 3) for _ in range(4)), lambda: "https://" + pick(low, 4, 9) + ".org/" + pick(low, 3, 8) + str(r.randint(1, 99)), lambda: pick(low, 3, 8) + "_" + pick(low, 3, 8), lambda: pick(up, 2, 9) + "!!", lambda: "|", lambda: pick(low, 2, 18) + r.choice(("", ".", ",")) + r.choice(("###", "$$$", "%%%", "&&&", "***")), lambda: pick(low, 2, 6).capitalize() + r.choice(("(", "[")) + str(r.randint(1, 99)) + ")",
            lambda: pick(low, 2, 10).capitalize() + r.choice(("", "s", "'s")), lambda: pick(low, 2, 9) + pick(up, 1, 1) + pick(low, 2, 9),
            lambda: pick(low, 3, 8) + "=" + str(r.randint(0, 999)), lambda: pick(low, 2, 7) + "-" + pick(low, 2, 7), lambda: pick(up, 2, 6) + "-" + pick(dig, 1, 6), lambda: pick(low, 14, 26), lambda: "4.0", lambda: pick(up, 1, 1) + pick(low, 2, 6) + str(r.randint(1, 9)),
        ))()

    rows = []
    cues = ("password", "passwd", "pwd", "secret", "token", "key", "credential", "bearer", "api_key", "passphrase")
    for i in range(n):
        names = [x for x, p in (("settings", 0.15), ("code", 0.1), ("key-block", 0.03)) if r.random() < p]
        words: list[str] = [plain() for _ in range(r.randint(2, 9))]
        tags = ["O"] * len(words)
        if i % 2:
            form, s = r.randrange(8), secret()
            hard = pick(b62, 6, 10) + pick(dig, 2, 3) + r.choice(("", "x", "Q"))
            new = {
                0: ([s], ["B"]), 1: ([r.choice(cues), r.choice("=:"), r.choice(("", '"')) + s], ["O", "O", "B"]), 2: ([f"{r.choice(cues)}={s}"], ["B"]),
                3: ([r.choice(cues), "is", hard], ["O", "O", "B"]), 4: (["Authorization:", "Bearer", s], ["O", "O", "B"]), 6: ([r.choice(cues), "is", phrase()], ["O", "O", "B"]), 7: ([r.choice(cues) + ":", phrase()], ["O", "B"]), 5: (["-----BEGIN", "PRIVATE", "KEY-----", s, secret(), secret()], ["O", "O", "O", "B", "I", "I"]),
            }[form]
            words += new[0]
            tags += [t if t == "O" else f"{t}-crf" for t in new[1]]
        elif r.random() < 0.3:  # cues without a secret
            words += [r.choice(cues), r.choice(("is", "of", "the", "was")), word()]
            tags += ["O"] * 3
        tail = [plain() for _ in range(r.randint(1, 7))]
        rows.append((words + tail, tags + ["O"] * len(tail), names))
    return rows


@lru_cache(maxsize=1)
def default_model() -> crf.Model:
    return crf.train(labelled_rows(), LABELS)


def fit(labelled: DataFrame) -> crf.Model:
    """Fit from a table (words array, tags array of O, B-crf, I-crf, files array); at most MAX_LABELLED rows, the first by a hash of the row."""
    rows = labelled.select("words", "tags", "files").orderBy(F.xxhash64("words", "tags", "files")).limit(MAX_LABELLED).collect()
    return crf.train([(list(w), list(t), list(f or ())) for w, t, f in rows if w], LABELS)


def labelled_table(spark: SparkSession, rows: Sequence | None = None) -> DataFrame:
    return spark.createDataFrame(rows or labelled_rows(), "words array<string>, tags array<string>, files array<string>")


def scan_secrets(docs: DataFrame, model: crf.Model | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Secrets of every text: id, n_assign, n_access, n_hex, base_sha256, spans, n_added, found.

    Spans of the fixed patterns stay; the field adds spans of kind crf that meet no pattern span.
    A null or empty text has no spans (base_sha256 is that of the empty string). Repeated rows and
    null ids each give their own row; further columns of ``docs`` are ignored; an empty table gives
    an empty one; texts of any length are read whole.
    """
    return spans.scan(docs, base_spans, KINDS, model or default_model(), file_features, in_order, text_col, id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents")).drop("found")
