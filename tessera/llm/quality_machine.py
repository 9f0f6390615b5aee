"""Quality classifier: a factorisation machine.

A text becomes hashed word frequencies, structure statistics and metadata (the
lengths), each between 0 and 1. The machine adds to the linear terms an
interaction of every pair of features, of low rank: with factors v_i, the sum
over pairs <v_i, v_j> x_i x_j is half of the sum over the rank of
(sum v x)^2 - sum (v x)^2, so a text is scored in time linear in its features.

Defined results: a null or empty text has zero word features and the statistics
of an empty text, and is scored as such; without labels of both kinds every
score is 0. Rows are scored one by one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _learn
from tessera.llm._common import remainder, small_batches

PER_LABEL, BUCKETS, RANK, EPOCHS = 1500, 4096, 8, 30
CACHE = 400_000
#: Kinds of bytes: lower, upper, digit, space, line end, closing marks, symbols, other ASCII, beyond ASCII.
_KIND = np.full(256, 8, np.int8)
_KIND[:128] = 7
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 0, 1, 2
_KIND[[9, 11, 12, 13, 32]], _KIND[10] = 3, 4
_KIND[list(b".,;:!?")], _KIND[list(b"#*$%&|<>@{}[]=_~^+\\/")] = 5, 6
STATISTICS = 20


class Features:
    """Texts to rows of features. The cache of word places is bounded."""

    def __init__(self) -> None:
        self.place: dict[str, int] = {}

    def words(self, tokens: list[str]) -> np.ndarray:
        try:
            return np.fromiter(map(self.place.__getitem__, tokens), np.int64, len(tokens))
        except KeyError:
            if len(self.place) > CACHE:
                self.place = {}
            for t in set(tokens):
                if t not in self.place:
                    self.place[t] = zlib.crc32(t.strip(".,;:!?").lower().encode("utf-8", "replace")) % BUCKETS
            return np.fromiter(map(self.place.__getitem__, tokens), np.int64, len(tokens))

    def row(self, text: str | None, n_chars: int | None = None) -> np.ndarray:
        text = text or ""
        out = np.zeros(BUCKETS + STATISTICS, np.float32)
        tokens, n = text.split(), len(text)
        m = len(tokens)
        if m:
            count = np.bincount(self.words(tokens), minlength=BUCKETS)
            tf = np.log1p(count)
            out[:BUCKETS] = tf / np.sqrt((tf * tf).sum())
        kinds = np.bincount(_KIND[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)], minlength=9) / max(1, n)
        lines = [x for x in text.split("\n") if x.strip()]
        different = len(set(tokens))
        repeats = sum(a == b for a, b in zip(tokens, tokens[1:], strict=False))
        pairs = len(set(zip(tokens, tokens[1:], strict=False)))
        out[BUCKETS:] = np.clip(
            [
                *kinds,
                np.log1p(m) / 12,
                np.log1p(n_chars if n_chars is not None else n) / 14,
                m < 10,
                (n / m - 1) / 20 if m else 0,
                different / m if m else 0,
                repeats / m if m else 0,
                pairs / (m - 1) if m > 1 else 0,
                len(set(lines)) / len(lines) if lines else 0,
                np.log1p(len(lines)) / 10,
                sum(x[-1] in ".!?" for x in lines) / len(lines) if lines else 0,
                text.count("!!") / m if m else 0,
            ],
            0,
            1,
        )
        return out


@dataclass
class Model:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    features: Features = field(default_factory=Features)

    def margins(self, x: np.ndarray) -> np.ndarray:
        s = x @ self.factors
        return self.bias + x @ self.linear + 0.5 * (s * s - (x * x) @ (self.factors * self.factors)).sum(1)


def fit(x: np.ndarray, y: np.ndarray, rank: int = RANK, epochs: int = EPOCHS, rate: float = 0.02, decay: float = 1e-4) -> Model:
    """Logistic loss, Adam, both labels weighing alike."""
    rng = np.random.default_rng(11)
    bias, w, v = np.zeros(1), np.zeros(x.shape[1]), rng.normal(0, 0.02, (x.shape[1], rank))
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (bias, w, v)]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 256):
            rows = order[at : at + 256]
            b, t = x[rows].astype(np.float64), y[rows]
            s = b @ v
            z = bias[0] + b @ w + 0.5 * (s * s - (b * b) @ (v * v)).sum(1)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - t) * weight[rows] / len(rows)
            grads = (np.array([g.sum()]), b.T @ g + decay * w, b.T @ (g[:, None] * s) - v * ((b * b).T @ g)[:, None] + decay * v)
            step += 1
            for p, d, (m, q) in zip((bias, w, v), grads, state, strict=True):
                m += 0.1 * (d - m)
                q += 0.001 * (d * d - q)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.999**step)) + 1e-8)
    return Model(float(bias[0]), w.astype(np.float32), v.astype(np.float32))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_label: int = PER_LABEL) -> Model | None:
    """Fit on at most ``per_label`` texts of either label, among rows whose
    crc32(id) mod 3 is not 1."""
    rows = [(t, int(y)) for t, y in _learn.sample(*_learn.labelled(docs, labels, label_col, id_col, text_col), per_label, _learn.learnable("k", 3, 1)) if y in (0, 1)]
    if len({y for _, y in rows}) < 2:
        return None
    own = Features()
    return fit(np.stack([own.row(t) for t, _ in rows]), np.array([y for _, y in rows], float))


def score(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, s = b.column("text").to_pylist(), np.zeros(b.num_rows)
            if model:
                for at in range(0, len(texts), 128):
                    x = np.stack([model.features.row(t) for t in texts[at : at + 128]])
                    s[at : at + 128] = 1 / (1 + np.exp(-np.clip(model.margins(x), -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
