"""Language identification by a blended-spectrum string kernel.

The kernel of two texts counts the character n-grams (n = 1, 2, 3) that are
present in both, over the geometric mean of how many each has. Texts are taken
in blocks of a fixed number of characters, so that presence does not saturate
in long ones; landmark blocks give a Nyström map, and one ridge regression per
language is fitted on it. Scoring a batch is two matrix products: block
presence by landmarks, and kernel values by coefficients. The scores of a text
are the means over all its blocks.

Defined results: a null text, and a text without letters (Unicode category L),
is ``und`` with score 0; ties go to the language first in order; if nothing can
be learned (no rows with a language) every text is ``und``; repeated rows are
labelled one by one, and rows that repeat with two languages are learned with
both; columns besides id, text and language are not read; a long text is taken
in pieces of bounded size, all of which count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _learn
from tessera.llm._common import remainder, small_batches

BLOCK, LANDMARKS, PER_LANGUAGE, RIDGE = 1500, 48, 300, 1e-2
#: Places for n-grams of each n, and the weight of each n in the kernel.
SPECTRUM = ((1, 512, 0.5), (2, 2048, 1.0), (3, 4096, 1.0))
WIDTH = sum(w for _, w, _ in SPECTRUM)
#: Characters of a long text that are taken at once.
PIECE = 1 << 18
_IS_LETTER = np.array([chr(i).isalpha() for i in range(0x110000)])


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _codes(text: str) -> np.ndarray:
    """Lower-case code points with runs of non-letters as one zero."""
    low = text.lower()
    c = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = _IS_LETTER[c]
    c = np.where(letter, c, 0)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return c[keep]


def presence(texts: list[str], block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(presence rows, text number of each row); a row is a unit vector."""
    rows, owner = [], []
    for i, t in enumerate(texts):
        c = _codes(t)
        n = max(1, -(-len(c) // block))
        size = -(-len(c) // n) if len(c) else 1
        out = np.zeros((n, WIDTH), np.float32)
        which, base = np.arange(len(c)) // size, 0
        for k, wide, weight in SPECTRUM:
            m = len(c) - k + 1
            if m > 0:
                h = c[:m]
                for j in range(1, k):
                    h = h * 8191 + c[j : m + j]
                h = (h * 0x9E3779B1 >> 15) % wide
                out[which[:m], base + h] = np.sqrt(weight)
            base += wide
        rows.append(out)
        owner += [i] * n
    x = np.concatenate(rows) if rows else np.zeros((0, WIDTH), np.float32)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9), np.array(owner, np.int64)


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray
    coefficients: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        total, blocks = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        pieces = [(i, t[at : at + PIECE]) for i, t in enumerate(texts) for at in range(0, max(1, len(t)), PIECE)]
        load = np.cumsum([len(t) for _, t in pieces]) // (2 * PIECE)
        for first, last in zip(*(np.flatnonzero(np.diff(load, **{end: -1})) for end in ("prepend", "append")), strict=True):
            x, owner = presence([t for _, t in pieces[first : last + 1]])
            owner = np.array([i for i, _ in pieces[first : last + 1]])[owner]
            np.add.at(total, owner, (x @ self.landmarks.T) @ self.coefficients)
            blocks += np.bincount(owner, minlength=len(texts))
        return total / np.maximum(blocks, 1)[:, None]


def fit(rows: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Nyström landmarks from every language in turn, then one-versus-rest
    kernel ridge regression."""
    languages = sorted({y for _, y in rows})
    texts = [t for t, _ in rows]
    x, owner = presence(texts)
    y = np.array([languages.index(rows[i][1]) for i in owner], np.int64)
    rng = np.random.default_rng(7)
    chosen = [rng.permutation(np.flatnonzero(y == k))[:landmarks] for k in range(len(languages))]
    z = x[np.concatenate(chosen)] if languages else x[:0]
    w, u = np.linalg.eigh((z @ z.T).astype(np.float64))
    w = np.maximum(w, 1e-6)
    root = u / np.sqrt(w)  # K(., z) @ root are the Nyström coordinates
    phi = (x @ z.T) @ root
    target = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
    beta = np.linalg.solve(phi.T @ phi + ridge * len(phi) * np.eye(phi.shape[1]), phi.T @ target)
    return Model(languages, z.astype(np.float32), (root @ beta).astype(np.float32))


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model | None:
    """Fit on at most ``per_language`` texts of each language, among rows whose
    crc32(id) mod 5 is not 0."""
    keyed = df.select(F.col(f"`{id_col}`").alias("k"), F.col(f"`{lang_col}`").alias("y"), F.col(f"`{text_col}`").alias("t"))
    rows = [(t, y) for t, y in _learn.sample(keyed, None, per_language, _learn.learnable("k", 5, 0)) if has_letter(t)]
    return fit(rows) if rows else None


def predict(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every whole text."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            langs, scores = ["und"] * len(texts), np.zeros(len(texts))
            ok = [i for i, t in enumerate(texts) if t and model and has_letter(t)]
            at = 0
            while at < len(ok):  # some 4 MB of text at once
                stop, size = at, 0
                while stop < len(ok) and (stop == at or size < 1 << 20):
                    size += len(texts[ok[stop]])
                    stop += 1
                s = model.scores([texts[i] for i in ok[at:stop]])
                e = np.exp(4 * (s - s.max(1, keepdims=True)))
                p = e / e.sum(1, keepdims=True)
                for i, k, v in zip(ok[at:stop], s.argmax(1).tolist(), p.max(1).tolist(), strict=True):
                    langs[i], scores[i] = model.languages[k], v
                at = stop
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(langs), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")
