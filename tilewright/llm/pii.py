"""Personal data: fixed patterns plus a linear-chain conditional random field over word shapes."""

from __future__ import annotations

import random
import re
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crf, spans
from .common import table

KINDS = ("email", "ip", "card", "phone")
ADDED = ("crf_email", "crf_ip", "crf_card", "crf_phone", "crf_id")
LABELS = ("O", *(f"{p}-{k}" for k in ADDED for p in "BI"))
#: Most rows of the labelled table that a fit reads.
MAX_LABELLED = 2_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Parts cannot overlap: a later start inside the same digits matches only where the first one does.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_CARD_CUE = re.compile(r"[0-9](?:[\x20-]?[0-9]){15}")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``.

    Each @ is tried once, with the longest local part to its left, so long runs cost linear time.
    """
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and text[a - 1] in _LOCAL:
            a -= 1
        if a < at and (m := _HOST.match(text, at + 1)):
            out.append((a, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def luhn(digits: str) -> bool:
    odd = digits[-1::-2]
    even = digits[-2::-2]
    return (sum(map(int, odd)) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in even)) % 10 == 0


def checked(kind: str, value: str) -> bool:
    """Whether a span that the field adds passes what its kind can be checked by: a card's last digit, an address' parts, a phone number's length."""
    digits = _NOT_DIGIT.sub("", value)
    if kind == "crf_card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "crf_phone":
        return 7 <= len(digits) <= 15
    if kind == "crf_ip" and _IP.fullmatch(value):
        return all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in value.split("."))
    return True


def base_spans(text: str) -> list[spans.Span]:
    """Leftmost non-overlapping matches per kind that pass the kind's own rule; others are dropped, without retries."""
    out: list[spans.Span] = [("email", a, b) for a, b in emails(text)]
    if text.count(".") >= 3:
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))]
    if _CARD_CUE.search(text):
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                d = _NOT_DIGIT.sub("", m[0])
                if 16 <= len(d) <= 19 and luhn(d):
                    out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def in_order(found: list[spans.Span]) -> list[spans.Span]:
    rank = {k: i for i, k in enumerate((*KINDS, *ADDED))}
    return sorted(found, key=lambda s: (rank[s[0]], s[1], s[2]))


def labelled_rows(seed: int = 5, n: int = 900) -> list[tuple[list[str], list[str], list[str]]]:
    """The small labelled table: invented sentences with and without personal data, as (words, tags, file features)."""
    r = random.Random(seed)
    low, dig, up = "abcdefghijklmnopqrstuvwxyz", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    pick = lambda chars, lo, hi: "".join(r.choice(chars) for _ in range(r.randint(lo, hi)))
    bare = lambda n: pick(dig, n, n)

    def card(n: int, good: bool = True) -> str:
        while luhn(d := bare(n)) != good:
            pass
        return d

    fours = lambda d: [d[i : i + 4] for i in range(0, len(d), 4)]
    host = lambda: pick(low, 3, 9) + str(r.randint(1, 9)) * (r.random() < 0.4) + r.choice((".com", ".org", ".example.com", ".de"))

    def item() -> tuple[list[str], str]:
        return r.choice((
            lambda: ([pick(low, 3, 8) + r.choice((".", "_", "")) + pick(low + dig, 2, 6) + "@" + host()], "email"),
            lambda: ([pick(low, 3, 8), r.choice(("(at)", "[at]", "at")), pick(low, 3, 8), r.choice(("(dot)", "[dot]", "dot")), "com"], "email"),
            lambda: ([".".join(str(r.randint(0, 255)) for _ in range(4))], "ip"),
            lambda: ([":".join(pick("0123456789abcdef", 1, 4) for _ in range(8))], "ip"),
            lambda: ([card(r.choice((13, 15, 16, 16)))], "card"), lambda: (fours(card(16)), "card"), lambda: (["-".join(fours(card(16)))], "card"), lambda: ([".".join(fours(card(16)))], "card"),
            lambda: (["+" + pick(dig, 1, 2), f"({pick(dig, 3, 3)})", f"{pick(dig, 3, 3)}-{pick(dig, 4, 4)}"], "phone"), lambda: ([f"({pick(dig, 3, 3)})", f"{pick(dig, 3, 3)}-{pick(dig, 4, 4)}"], "phone"),
            lambda: ([f"{pick(dig, 3, 3)}-{pick(dig, 3, 3)}-{pick(dig, 4, 4)}"], "phone"), lambda: (["+" + pick(dig, 2, 2), pick(dig, 3, 3), pick(dig, 7, 8)], "phone"),
            lambda: ([f"{pick(dig, 3, 3)}-{pick(dig, 2, 2)}-{pick(dig, 4, 4)}"], "id"), lambda: ([pick(up, 2, 2) + pick(dig, 2, 2), *(pick(dig, 4, 4) for _ in range(4)), pick(dig, 2, 2)], "id"), lambda: ([pick(up, 2, 2) + pick(dig, 20, 20)], "id"),
        ))()

    def plain() -> str:
        x = r.random()
        if x < 0.84:
            w = pick(low, 1, 11)
            return w.capitalize() if r.random() < 0.12 else w + r.choice(("", "", "", ",", "."))
        return r.choice((
            lambda: pick(dig, 1, 4), lambda: f"{r.randint(1900, 2040)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", lambda: f"{r.randint(0, 23)}:{r.randint(0, 59):02d}", lambda: f"{r.randint(1, 99)},{pick(dig, 3, 3)}.{pick(dig, 2, 2)}", lambda: f"{r.randint(1, 9)}.{r.randint(0, 9)}", lambda: f"{r.randint(1, 9)}.0.", lambda: pick("0123456789abcdef", 24, 40), lambda: "AKIA" + pick(up + dig, 16, 16),
            lambda: card(r.choice((13, 15, 16, 16)), False), lambda: "-".join(fours(card(16, False))), lambda: "password=" + pick("0123456789abcdef", 18, 18), lambda: "|", lambda: pick(up, 2, 8) + "!!", lambda: pick(low, 2, 8) + r.choice(("", ".", ",")) + r.choice(("###", "$$$", "%%%", "&&&", "***")), lambda: pick(low, 9, 20) + r.choice(("", ".", ",")) + r.choice(("###", "$$$", "%%%", "&&&", "***")), lambda: "at", lambda: "https://" + host() + "/" + pick(low, 2, 8), lambda: pick(low, 2, 7) + "-" + pick(low, 2, 7), lambda: pick(up, 2, 4) + "-" + str(r.randint(1, 99)), lambda: "#" + pick(dig, 1, 6), lambda: r.choice(("=", "-", "*")), lambda: f"({pick(dig, 1, 2)})", lambda: f"{r.randint(1, 999)}%",
        ))()

    rows = []
    cues = ("call", "phone", "mail", "email", "card", "ip", "address", "ssn", "account", "tel", "contact")
    for i in range(n):
        words: list[str] = [plain() for _ in range(r.randint(1, 8))]
        if r.random() < 0.35:
            words.append(r.choice(cues) + r.choice(("", ":")))
        tags = ["O"] * len(words)
        if i % 5 < 3:
            own, kind = item()
            own = [*own[:-1], own[-1] + r.choice(("", "", "", ".", ","))]
            words += own
            tags += [f"{'B' if j == 0 else 'I'}-crf_{kind}" for j in range(len(own))]
        elif i % 5 == 3 and r.random() < 0.4:  # one word again and again, or loose "at" and "dot"
            words += [r.choice(("at", "dot", plain()))] * r.randint(2, 9) if r.random() < 0.6 else [plain(), r.choice(("at", "dot")), plain(), plain()]
            tags = ["O"] * len(words)
        tail = [plain() for _ in range(r.randint(1, 7))]
        rows.append((words + tail, tags + ["O"] * len(tail), []))
    return rows


@lru_cache(maxsize=1)
def default_model() -> crf.Model:
    return crf.train(labelled_rows(), LABELS, rounds=60)


def fit(labelled: DataFrame) -> crf.Model:
    """Fit from a table (words array, tags array, files array); at most MAX_LABELLED rows, the first by a hash of the row."""
    rows = labelled.select("words", "tags", "files").orderBy(F.xxhash64("words", "tags", "files")).limit(MAX_LABELLED).collect()
    return crf.train([(list(w), list(t), list(f or ())) for w, t, f in rows if w], LABELS)


def labelled_table(spark: SparkSession, rows: Sequence | None = None) -> DataFrame:
    return spark.createDataFrame(rows or labelled_rows(), "words array<string>, tags array<string>, files array<string>")


def no_file_features(text: str) -> list[str]:
    return []


def scan_pii(docs: DataFrame, model: crf.Model | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Personal data of every text: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, found.

    Spans of the fixed patterns stay; the field adds spans of its kinds (crf_...) that meet no pattern span
    and that :func:`checked` does not rule out. A null or empty text has no spans. Repeated rows and null ids each give their own row;
    further columns are ignored; an empty table gives an empty one; texts are read whole.
    """
    return spans.scan(docs, base_spans, KINDS, model or default_model(), no_file_features, in_order, text_col, id_col, checked)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_pii(table(spark, sf_dir, "documents")).drop("found")
