"""Linear-chain conditional random field in numpy: training, and exact Viterbi over whole corpora.

A token's score for a label is a sum of weights of features of the token, its two predecessors, its
successor and its file. Sequences begin and end in the outside label, so a file is one sequence.

Decoding is exact and cheap. With ``D[y]`` the most that the two transitions around a token can gain
by label ``y`` instead of outside, a token whose emission for every ``y`` stays below outside by more
than ``D[y]`` is outside on the best path, whatever its neighbours are. Such tokens cut the sequence;
Viterbi runs over the short pieces that remain, batched by length.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence

import numpy as np

OUTSIDE = 0
PUNCT = "\"'`.,;:!?()[]{}<>"
ROLES = ("0", "-1", "-2", "+1")
#: Distinct words and rows that are remembered per worker; between pieces of half as many words the memory is emptied, which costs time only.
WORD_CACHE = 400_000

#: Marks that are strung to words as noise, and the runs up to which a shape is written out.
MARKS = "#$%&*|~^"
SHAPE_RUNS = 16


def shape(word: str) -> str:
    """The whole word's shape with runs merged: letters A or a, digits 9, other characters as they are; of more than SHAPE_RUNS runs, their kinds."""
    out = []
    for c in word:
        k = "A" if "A" <= c <= "Z" else "9" if "0" <= c <= "9" else "a" if c.isalpha() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out) if len(out) <= SHAPE_RUNS else "many:" + "".join(sorted(set(out)))


def _last_digit(word: str) -> bool:
    """Whether the digits of a word pass the check that cards' last digits are made for."""
    d = [int(c) for c in word if c.isdecimal()]
    return (sum(d[-1::-2]) + sum(2 * x - 9 * (x > 4) for x in d[-2::-2])) % 10 == 0


def signature(word: str) -> tuple[str, ...]:
    """Features of a word beside its identity."""
    core = word.strip(PUNCT)
    end = "end=" + word[-1] if word[-1] in PUNCT else "end="
    if core.isalpha() and (core.islower() or not core.isascii()):
        return ("plain", end)
    bare = core.strip(MARKS + PUNCT)
    if bare != core and (not bare or bare.isalpha() and (bare[1:].islower() or not bare.isascii())):
        return ("plain", "marked", end)
    digits = sum(c.isdigit() for c in core)
    n = len(core)
    out = ["s=" + shape(core), "full=" + shape(word), f"n={min(n, 8) if n < 8 else 8 + min(n - 8, 32) // 8}"]
    if digits:
        out += ["dig", f"nd={min(digits, 20)}", f"share={4 * digits // n}"]
    elif bare.isalpha():
        out.append("title" if bare[1:].islower() else "capitals" if bare.isupper() else "mixed")
    if any(c.isupper() for c in core) and any(c.islower() for c in core) and digits:
        out.append("mix3")
    if n >= 16:
        out += ["long", f"kinds={min(len(set(core)) // 4, 5)}"]
        if digits and all(c in "0123456789abcdefABCDEF" for c in core):
            out.append("hex")
    if n <= 3 and digits == n:
        out.append("short-number")
    if n <= 24 and 13 <= digits <= 19 and not core.strip("0123456789-."):
        out.append("luhn" if _last_digit(core) else "no-luhn")
    out += ["has=" + c for c in "@=:/\\._-+()" if c in core]
    if "=" in core or ":" in core:
        out.append("key=" + re.split("[=:]", core, maxsplit=1)[0].lower())
    return tuple(out)


def features(word: str, lexicon: frozenset[str] | None) -> tuple[str, ...]:
    """Signature and, for words of the lexicon (None: any word), the word itself."""
    low = word.strip(PUNCT).lower()
    sig = signature(word)
    return (*sig, "w=" + low) if low and (lexicon is None or low in lexicon) else sig


class Model:
    """labels[0] is outside. emit: feature -> weights by label; move: transitions; files: names of file features."""

    def __init__(self, labels: Sequence[str], emit: dict[str, np.ndarray], move: np.ndarray, lexicon: frozenset[str]):
        self.labels, self.emit, self.move, self.lexicon = list(labels), emit, move, lexicon
        gain = (move - move[:, :1]).max(0) + (move - move[:1, :]).max(1)
        self.slack = np.maximum(gain, 0)
        self.slack[OUTSIDE] = 0
        self.reset()

    def __getstate__(self):
        return self.labels, self.emit, self.move, self.lexicon

    def __setstate__(self, state):
        self.__init__(*state)

    def reset(self) -> None:
        self.words: dict[str | None, int] = {None: 0}
        self.rows: dict[tuple[str, ...], int] = {}
        self.plain: dict[str, int] = {}
        self.score = {r: np.zeros((1024, len(self.labels)), np.float64) for r in ROLES}
        self.bound = {r: np.zeros(1024, np.float64) for r in ROLES}
        self.row(())  # row 0 stands for what lies beyond a file's ends

    def row(self, feats: tuple[str, ...]) -> int:
        if (at := self.rows.get(feats)) is not None:
            return at
        at = self.rows[feats] = len(self.rows)
        if at >= len(self.bound["0"]):
            for d in (self.score, self.bound):
                for r in ROLES:
                    d[r] = np.concatenate([d[r], np.zeros_like(d[r])])
        for r in ROLES:
            for f in feats:
                if (w := self.emit.get(f"{r}:{f}")) is not None:
                    self.score[r][at] += w
            over = self.score[r][at] - self.score[r][at][OUTSIDE]
            if r == "0":
                over = over + self.slack
            self.bound[r][at] = over[1:].max() if len(feats) else -np.inf if r == "0" else 0
        return at

    def lookup(self, word: str) -> int:
        if len(self.words) >= WORD_CACHE:
            self.words.clear()
            self.words[None] = 0
        # Most words are plain and not in the lexicon: their features are those of all such words.
        end = word[-1] if word[-1] in PUNCT else ""
        core = word[:-1] if end else word
        if core.isalpha() and (core.islower() or not core.isascii()) and core.lower() not in self.lexicon:
            at = self.plain.get(end)
            if at is None:
                at = self.plain[end] = self.row(("plain", "end=" + end))
        else:
            at = self.row(features(word, self.lexicon))
        self.words[word] = at
        return at

    def file_scores(self, names: Iterable[str]) -> np.ndarray:
        return sum((self.emit.get(f"file:{f}", 0) for f in names), np.zeros(len(self.labels)))

    def decode(self, files: Sequence[tuple[Sequence[str], Iterable[str]]]) -> list[list[tuple[int, int]]]:
        """For each (words, file features): (position, label) of every word that is not outside, in order."""
        out: list[list[tuple[int, int]]] = [[] for _ in files]
        chunk, size = [], 0
        for k, (words, names) in enumerate(files):
            chunk.append((k, words, self.file_scores(names)))
            size += len(words)
            if size > 200_000:
                self._decode(chunk, out)
                chunk, size = [], 0
        if chunk:
            self._decode(chunk, out)
        return out

    def _decode(self, chunk, out) -> None:
        flat, starts = [None, None], []  # None stands for what lies beyond a file's ends
        for _, words, _ in chunk:
            starts.append(len(flat))
            flat += words
            flat += (None, None)
        starts = np.array(starts)
        extra = np.stack([s for _, _, s in chunk])
        most = (extra - extra[:, :1])[:, 1:].max(1)
        size = max(WORD_CACHE // 2, 1)
        found = [self._open(flat, at, min(at + size, len(flat)), starts, extra, most) for at in range(0, len(flat), size)]
        open_, e = (np.concatenate(x) for x in zip(*found, strict=True))
        if not len(open_):
            return None
        first = np.flatnonzero(np.diff(open_, prepend=-9) != 1)
        length = np.diff(first, append=len(open_))
        tags = np.zeros(len(open_), np.int64)
        for n in np.unique(length):
            at = first[length == n][:, None] + np.arange(n)
            tags[at] = viterbi(e[at], self.move)
        at = open_[tags > 0]
        files = np.searchsorted(starts, at, "right") - 1
        for p, t, f in zip(at.tolist(), tags[tags > 0].tolist(), files.tolist(), strict=True):
            out[chunk[f][0]].append((p - int(starts[f]), t))
        return None

    def _open(self, flat, low: int, high: int, starts, extra, most) -> tuple[np.ndarray, np.ndarray]:
        """Positions from ``low`` to ``high`` that may be other than outside, and their emissions; only here tables are emptied."""
        if len(self.rows) >= WORD_CACHE // 2:
            self.reset()
        before = min(low, 2)
        get, look, ids = self.words.get, self.lookup, []
        for w in flat[low - before : high + 1]:
            at = get(w)
            ids.append(look(w) if at is None else at)
        v = np.array(ids, np.int64)
        files = np.searchsorted(starts, np.arange(low - before, low - before + len(v)), "right") - 1
        b = self.bound["0"][v]
        b[1:] += self.bound["-1"][v[:-1]]
        b[2:] += self.bound["-2"][v[:-2]]
        b[:-1] += self.bound["+1"][v[1:]]
        b += np.where(files >= 0, most[files], 0)
        own = np.flatnonzero(b[before : high - low + before] >= -1e-9) + before
        e = self.score["0"][v[own]] + self.score["-1"][v[own - 1]] + self.score["-2"][v[own - 2]]
        e += self.score["+1"][v[np.minimum(own + 1, len(v) - 1)]] + extra[files[own]]
        return own + low - before, e


def viterbi(e: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Best labels (n, t) for emissions (n, t, k) of pieces that have outside on both sides."""
    n, t, _ = e.shape
    best = move[OUTSIDE] + e[:, 0]
    back = np.zeros((n, t, e.shape[2]), np.int8 if e.shape[2] < 128 else np.int64)
    for i in range(1, t):
        s = best[:, :, None] + move
        back[:, i] = s.argmax(1)
        best = s.max(1) + e[:, i]
    tags = np.zeros((n, t), np.int64)
    tags[:, -1] = (best + move[:, OUTSIDE]).argmax(1)
    for i in range(t - 1, 0, -1):
        tags[:, i - 1] = back[np.arange(n), i, tags[:, i]]
    return tags


def sequence_features(words: Sequence[str], names: Iterable[str], lexicon: frozenset[str] | None) -> list[list[str]]:
    own = [features(w, lexicon) for w in words]
    at = lambda i: own[i] if 0 <= i < len(own) else ()
    near = {"0": 0, "-1": -1, "-2": -2, "+1": 1}
    return [[f"{r}:{f}" for r, d in near.items() for f in at(i + d)] + [f"file:{f}" for f in names] for i in range(len(own))]


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def train(rows: Sequence[tuple[Sequence[str], Sequence[str], Sequence[str]]], labels: Sequence[str], rounds: int = 120, l2: float = 0.02, rate: float = 0.15) -> Model:
    """Fit by Adam on the L2-regularised log-likelihood. rows: (words, tags, file features)."""
    lexicon = frozenset(low for words, _, _ in rows for w in words if (low := w.strip(PUNCT).lower()).isalpha())
    index: dict[str, int] = {}
    flat, feats, ys, lens = [], [], [], []
    for words, tags, names in rows:
        lens.append(len(words))
        for fs, y in zip(sequence_features(words, names, lexicon), tags, strict=True):
            flat += [len(ys)] * len(fs)
            feats += [index.setdefault(f, len(index)) for f in fs]
            ys.append(labels.index(y))
    k, n, big = len(labels), len(rows), max(lens)
    flat, feats, y = np.array(flat), np.array(feats), np.array(ys)
    at = np.full((n, big), -1)
    mask = np.arange(big)[None] < np.array(lens)[:, None]
    at[mask] = np.arange(len(y))
    tags = np.where(mask, y[at], OUTSIDE)
    w, move = np.zeros((len(index), k)), np.zeros((k, k))
    order = np.argsort(feats, kind="stable")
    cuts = np.flatnonzero(np.diff(feats[order], prepend=-1))
    token_order = np.argsort(flat, kind="stable")
    token_cuts = np.flatnonzero(np.diff(flat[token_order], prepend=-1))
    m = [np.zeros_like(w), np.zeros_like(move)]
    s = [np.zeros_like(w), np.zeros_like(move)]
    for step in range(1, rounds + 1):
        e = np.add.reduceat(w[feats[token_order]], token_cuts)[at]
        _, p, grad_move = likelihood(e, mask, tags, move)
        grads = [np.add.reduceat(p[mask][flat[order]], cuts) + l2 * w, grad_move + l2 * move]
        for i, (x, g) in enumerate(zip((w, move), grads, strict=True)):
            m[i] = 0.9 * m[i] + 0.1 * g
            s[i] = 0.99 * s[i] + 0.01 * g * g
            x -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.99**step)) + 1e-6)
    return Model(labels, {f: w[i] for f, i in index.items()}, move, lexicon)


def likelihood(e: np.ndarray, mask: np.ndarray, tags: np.ndarray, move: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Minus the log-likelihood of the tags, and its gradients by the emissions (n, t, k) and by the transitions.

    mask marks the tokens of each sequence, which lie at its beginning; sequences begin and end outside.
    """
    n, big, k = e.shape
    e = np.where(mask[:, :, None], e, 0)
    last = mask.sum(1) - 1
    rows = np.arange(n)
    a = np.zeros((n, big, k))
    a[:, 0] = move[OUTSIDE] + e[:, 0]
    for t in range(1, big):
        a[:, t] = _lse(a[:, t - 1][:, :, None] + move, 1) + e[:, t]
    z = _lse(a[rows, last] + move[:, OUTSIDE], 1)
    b = np.zeros((n, big, k))
    b[rows, last] = move[:, OUTSIDE]
    by_move = np.zeros((k, k))
    for t in range(big - 2, -1, -1):
        on = t < last
        nxt = (b[:, t + 1] + e[:, t + 1])[:, None, :] + move
        b[:, t] = np.where(on[:, None], _lse(nxt, 2), b[:, t])
        by_move += np.exp(a[:, t][:, :, None] + nxt - z[:, None, None])[on].sum(0)
    p = np.where(mask[:, :, None], np.exp(a + b - z[:, None, None]), 0)
    by_move[OUTSIDE] += p[:, 0].sum(0)
    by_move[:, OUTSIDE] += p[rows, last].sum(0)
    full = np.concatenate([np.zeros((n, 1), int), tags], 1)
    gold = np.zeros((k, k))
    np.add.at(gold, (full[:, :-1][mask], full[:, 1:][mask]), 1)
    np.add.at(gold, (tags[rows, last], np.zeros(n, int)), 1)
    i, t = np.nonzero(mask)
    own = e[i, t, tags[i, t]].sum() + (gold * move).sum()
    p[i, t, tags[i, t]] -= 1
    return float(z.sum() - own), p, by_move - gold


_BEFORE, _AFTER = frozenset((PUNCT + MARKS).replace("(", "")), frozenset(PUNCT + MARKS)


def token_spans(text: str, tagged: Sequence[tuple[int, int]], begins: Callable[[int], bool], kind: Callable[[int], str]) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points for runs of tagged words; punctuation and marks around a run are left out."""
    if not tagged:
        return []
    want = {p: t for p, t in tagged}
    out: list[list] = []
    last, high = -2, max(want)
    for i, m in enumerate(re.finditer(r"\S+", text)):
        if i in want:
            t = want[i]
            if begins(t) or last != i - 1 or not out or out[-1][0] != kind(t):
                out.append([kind(t), m.start(), m.end()])
            else:
                out[-1][2] = m.end()
            last = i
        if i >= high:
            break
    spans = []
    for k, a, b in out:
        while a < b and text[a] in _BEFORE:
            a += 1
        while b > a and text[b - 1] in _AFTER:
            b -= 1
        if b > a:
            spans.append((k, a, b))
    return spans
