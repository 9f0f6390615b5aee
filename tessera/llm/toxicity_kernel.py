"""Toxicity by a gap-weighted subsequence string kernel.

Instances are short pieces of sentences: windows of ``WINDOW`` tokens that
follow each other. A window is a bag of words (space-separated tokens without
outer punctuation, runs of single letters joined, long tokens in overlapping
parts). The kernel of two windows is the sum over their words of the word
kernel: two words are as alike as the subsequences of three to five characters
that they share, each weighted by a decay for every character that it skips; so
letters inserted into an insult, or other endings, cost little.

Landmark words give a Nyström map, and a linear support vector machine (squared
hinge) is trained on the windows of labelled documents. A label says of a
document, not which of its sentences is meant: at first the windows of toxic
documents with a word that is found in them only, beyond chance, are positive
(all of their windows, if there is no such word), then, turn by turn, those that
the machine itself finds beyond its margin.
Windows of both kinds are also learned with characters inserted into all words,
which teaches the machine that gaps alone mean nothing. Kernel, map and machine
together are one weight per hashed subsequence, so scoring a word is a sum of
table values; a bounded cache holds words already scored. A logistic regression
on the largest margin of a text's windows turns it into a score.

Defined results: a null or empty text, or one without words, scores as a text
of neutral words; without labels of both kinds every score is 0; labels that
repeat count once, and an id with two different labels has none; rows are scored
one by one, so repeated rows score alike; columns besides id and text are not
read; a text of any length, with spaces or without, is scored in parts of
bounded size.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _learn
from tessera.llm._common import remainder, small_batches

PER_LABEL, LANDMARKS, TABLE, DECAY, LONGEST = 1500, 300, 1 << 18, 0.5, 32
CACHE = 200_000
#: Tokens of a window; windows of either label that are learned from; words
#: scored at once.
WINDOW, LEARNED, BATCH = 3, 10_000, 8192
TURNS, PENALTY = 4, 5.0
#: Chance, at most, that a word is in toxic documents only by luck.
ODDS = 1e-7
#: Offsets of the characters of a subsequence; at most two are skipped.
SHAPES = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4), (0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4), (0, 1, 2, 3, 4))
_OUTER = " \t\n\r\x0b\x0c.,;:!?\"'()[]{}<>|#$%&*+-_=/\\~`^@«»“”„…"
#: Digits and signs that stand for letters.
_LOOKALIKE = str.maketrans("01345@$!", "oieasasi")
_SINGLES = re.compile(r"(?<!\S)(?:\w[.\-*_]? ){2,}\w(?!\w)")


def units(token: str) -> list[str]:
    """The words of a token: as it stands, and by its letters alone if there are
    other characters within; in overlapping parts if it is long."""
    w = token.strip(_OUTER).lower()
    words = [w]
    if not w.isalpha() and sum(map(str.isalpha, w)) > 2:
        words.append("".join(filter(str.isalpha, w.translate(_LOOKALIKE))))
    return [p for w in words for p in ([w] if len(w) <= LONGEST else [w[i : i + LONGEST] for i in range(0, len(w) - 8, LONGEST - 8)])]


def spaced(word: str, rng: np.random.Generator) -> list[str]:
    """The word with characters inserted: between all letters, and at one place."""
    at, mark = int(rng.integers(1, len(word))), ".-*_'"[int(rng.integers(5))]
    letter = "abcdefghijklmnopqrstuvwxyz0123456789"[int(rng.integers(36))]
    return [mark.join(word), word[:at] + mark + word[at:], word[:at] + letter + word[at:], word[:at] + word[at - 1] + word[at:]]


def joined(text: str) -> list[str]:
    """Words spelled with spaces between their letters."""
    return [re.sub(r"[\s.\-*_]", "", m) for m in _SINGLES.findall(text)]


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, table place, weight) of all subsequences; the weights of a
    word have norm 1, taking its subsequences as distinct."""
    sizes = np.array([len(w) + 2 for w in words])
    wide = int(sizes.max()) + 4 if len(words) else 4
    flat = np.frombuffer("".join(f"^{w}$".ljust(wide, "\x00") for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), wide).astype(np.int64)
    owners, places, weights = [], [], []
    for shape in SHAPES:
        m = wide - shape[-1]
        h = np.full((len(words), m), 7919 * len(shape), np.int64)
        for o in shape:
            h = h * 1000003 + flat[:, o : o + m]
        r, c = np.nonzero(np.arange(m)[None, :] + shape[-1] < sizes[:, None])
        owners.append(r)
        places.append((h[r, c] * 0x9E3779B97F4A7C1 >> 20) & (TABLE - 1))
        weights.append(np.full(len(r), DECAY ** (shape[-1] + 1 - len(shape))))
    o, p, w = np.concatenate(owners), np.concatenate(places), np.concatenate(weights)
    norm = np.sqrt(np.bincount(o, w * w, minlength=len(words)))
    return o, p, w / np.maximum(norm[o], 1e-9)


def kernel(a: list[str], b: list[str]) -> np.ndarray:
    """Kernel values of two lists of words, in blocks of landmarks."""
    oa, pa_, wa = subsequences(a)
    ob, pb, wb = subsequences(b)
    used, inverse = np.unique(pb, return_inverse=True)
    place = np.full(TABLE, -1, np.int64)
    place[used] = np.arange(len(used))
    z = np.zeros((len(used), len(b)), np.float32)
    np.add.at(z, (inverse, ob), wb)
    hit = place[pa_] >= 0
    out = np.zeros((len(a), len(b)), np.float32)
    o, c, w = oa[hit], place[pa_[hit]], wa[hit].astype(np.float32)
    for at in range(0, len(o), 1 << 16):
        s = slice(at, at + (1 << 16))
        first = np.flatnonzero(np.diff(o[s], prepend=-1))
        np.add.at(out, o[s][first], np.add.reduceat(z[c[s]] * w[s, None], first))
    return out


def machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 50.0, steps: int = 25) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    b, penalty = np.zeros(x.shape[1]), np.ones(x.shape[1])
    penalty[-1] = 1e-3
    for _ in range(steps):
        active = y * (x @ b) < 1
        xa, wa = x[active], weight[active]
        new = np.linalg.solve(np.diag(penalty) + 2 * c * (xa.T * wa) @ xa, 2 * c * (xa.T * wa) @ y[active])
        if np.abs(new - b).max() < 1e-6:
            break
        b = new
    return b[:-1], float(b[-1])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (p - y) + ridge * b
        b = b - np.linalg.solve((x.T * (p * (1 - p) + 1e-6)) @ x + ridge * np.eye(len(b)), g)
    return b


def windows(text: str) -> list[list[str]]:
    """The words of each window of a text; one token at least."""
    own = [[u for u in units(t) if u] for t in text.split()]
    out = [[u for t in own[i : i + WINDOW] for u in t] for i in range(max(1, len(own) - WINDOW + 1) if own else 0)]
    return [x for x in [*out, *([u] for u in joined(text))] if x]


@dataclass
class Model:
    table: np.ndarray
    bias: float
    final: np.ndarray
    new: dict[str, float] = field(default_factory=dict)
    old: dict[str, float] = field(default_factory=dict)

    def values(self, words: list[str]) -> np.ndarray:
        """What each word adds to the margin of its window."""
        out = np.zeros(len(words))
        for at in range(0, len(words), BATCH):
            part = words[at : at + BATCH]
            o, p, w = subsequences(part)
            out[at : at + BATCH] = np.bincount(o, self.table[p] * w, minlength=len(part))
        return out

    def _learn_tokens(self, tokens: list[str]) -> None:
        if len(self.new) + len(tokens) > CACHE:
            self.old, self.new = self.new, {}
        own, of = [], []
        for t in tokens:
            mine = [u for u in units(t) if u]
            own += mine
            of += [t] * len(mine)
        best = dict.fromkeys(tokens, 0.0)
        seen = set()
        for t, v in zip(of, self.values(own).tolist(), strict=True):
            best[t] = max(best[t], v) if t in seen else v
            seen.add(t)
        self.new |= best

    def margin(self, text: str) -> float:
        """The largest margin of the windows of a text."""
        tokens = text.split()
        if not tokens:
            return -2.0
        try:
            v = np.fromiter(map(self.new.__getitem__, tokens), np.float64, len(tokens))
        except KeyError:
            todo = []
            for t in set(tokens):
                if t not in self.new:
                    if (x := self.old.get(t)) is not None:
                        self.new[t] = x
                    else:
                        todo.append(t)
            if len(self.new) + len(todo) > CACHE:
                todo = list(set(tokens))
            self._learn_tokens(todo)
            v = np.fromiter(map(self.new.__getitem__, tokens), np.float64, len(tokens))
        sums = np.cumsum(np.concatenate([[0.0], v]))
        best = (sums[WINDOW:] - sums[:-WINDOW]).max() if len(v) > WINDOW else v.sum()
        if " " in text and (more := joined(text)):
            best = max(best, self.values(more).max())
        return float(np.clip(best + self.bias, -20, 20))

    def score(self, text: str | None) -> float:
        z = float(np.array([self.margin(text or ""), 1.0]) @ self.final)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _landmarks(pos: Counter, neg: Counter, n_pos: int, n_neg: int, number: int, rng: np.random.Generator) -> list[str]:
    """Words that stand for the others: a third whose share of documents differs
    most between the labels, a third the most common, a third any. They are
    places of the map; what they mean is left to the machine."""
    words = sorted(set(pos) | set(neg))
    p, q = np.array([pos[w] for w in words]) / max(n_pos, 1), np.array([neg[w] for w in words]) / max(n_neg, 1)
    contrast = (p - q) / np.sqrt((p + q) / max(n_pos, 1) + 1.0 / max(n_pos, 1) ** 2)
    third = number // 3
    first = np.argsort(-contrast, kind="stable")[:third]
    common = np.argsort(-(p + q), kind="stable")[:third]
    every = np.concatenate([first, common, rng.permutation(len(words))[: number - 2 * third]])
    return [words[i] for i in dict.fromkeys(every.tolist())]


def _bags(found: list[list[str]], number: dict[str, int], x: np.ndarray) -> np.ndarray:
    """Feature rows of windows: sums of their words' rows."""
    flat = np.array([number[w] for s in found for w in s])
    size = np.array([len(s) for s in found])
    first = np.cumsum(size) - size
    out = np.zeros((len(found), x.shape[1]), np.float32)
    for at in range(0, len(found), 2048):
        s = slice(at, at + 2048)
        here = flat[first[at] : first[at] + size[s].sum()]
        out[s] = np.add.reduceat(x[here], first[s] - first[at])
    return out


def fit(rows: list[tuple[str, int]], landmarks: int = LANDMARKS, learned: int = LEARNED, c: float = PENALTY) -> Model | None:
    """Train on (text, 0 or 1)."""
    if len({y for _, y in rows}) < 2:
        return None
    rng = np.random.default_rng(5)
    found, y = [], []
    pos, neg = Counter(), Counter()
    for text, label in rows:
        mine = windows(text)
        found += mine
        y += [label] * len(mine)
        (pos if label else neg).update({w for s in mine for w in s if len(w) > 1})
    n_pos = sum(label for _, label in rows)
    # so many toxic documents and hardly another that chance is ruled out
    least = max(3, int(np.ceil(np.log(ODDS) / np.log(n_pos / len(rows)))))
    telling = {w for w, n in pos.items() if n >= least and n >= 50 * neg[w]}
    y = np.array(y)
    hot = np.array([any(w in telling for w in s) for s in found], bool) & (y == 1)
    # of either label as many as are wanted, those with such words first
    chosen = np.sort(np.concatenate([np.concatenate([rng.permutation(np.flatnonzero(hot & (y == k))), rng.permutation(np.flatnonzero(~hot & (y == k)))])[:learned] for k in (0, 1)]))
    y, hot, found = y[chosen], hot[chosen], [found[i] for i in chosen.tolist()]
    if len(set(y.tolist())) < 2:
        return None
    # the same with characters inserted into every word, for some of either label
    again = np.concatenate([rng.permutation(np.flatnonzero(y == k))[: learned // 4] for k in (0, 1)])
    other = [[spaced(w, rng)[int(rng.integers(4))] if len(w) > 3 else w for w in found[i]] for i in again.tolist()]
    origin = np.concatenate([np.arange(len(found)), again])
    found, y = found + other, y[origin]
    z = _landmarks(pos, neg, n_pos, len(rows) - n_pos, landmarks, rng)
    z = list(dict.fromkeys(z + [v for w in z[: landmarks // 6] if len(w) > 3 for v in spaced(w, rng)[1:2]]))
    words = sorted({w for s in found for w in s})
    e, u = np.linalg.eigh(kernel(z, z).astype(np.float64))
    root = u[:, e > 1e-4] / np.sqrt(e[e > 1e-4])
    x = np.concatenate([kernel(words[at : at + BATCH], z) @ root for at in range(0, len(words), BATCH)]).astype(np.float32)
    bags = _bags(found, {w: i for i, w in enumerate(words)}, x)
    del x
    plus = (hot if hot.any() else y == 1)[origin]
    for turn in range(TURNS):
        use = plus | (y == 0)
        weight = np.where(plus[use], 0.5 / plus.sum(), 0.5 / (y == 0).sum()) * use.sum()
        b, bias = machine(bags[use].astype(np.float64), np.where(plus[use], 1.0, -1.0), weight, c)
        margin = bags @ b + bias
        # a window and its copies with characters inserted go together
        own = (margin[: len(chosen)] > 1)[origin] & (y == 1)
        if turn == TURNS - 1 or not own.any() or (own == plus).all():
            break
        plus = own
    o, p, w = subsequences(z)
    model = Model(np.bincount(p, w * (root @ b)[o], minlength=TABLE).astype(np.float32), bias, np.zeros(2))
    feats = np.array([[model.margin(t)] for t, _ in rows])
    model.final = logistic(feats, np.array([k for _, k in rows], float))
    model.new, model.old = {}, {}
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = PER_LABEL) -> Model | None:
    """Fit on at most ``per_label`` texts of either label, among rows whose
    crc32(id) mod 3 is not 1."""
    rows = _learn.sample(*_learn.labelled(docs, labels, label_col, id_col, text_col), per_label, _learn.learnable("k", 3, 1))
    return fit([(t, int(y)) for t, y in rows if y in (0, 1)])


def score(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [model.score(t) if model else 0.0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
