"""Whole-text tokenization with public tokenizers, at the cost of distinct words.

A byte-pair tokenizer splits a text into pieces before it merges anything, so a
text may be cut at places where a piece always begins, and every distinct chunk
needs to be encoded once only. ``ChunkEncoder`` cuts at such places, keeps a
bounded cache of chunk -> ids, and joins the ids of a text from it. The ids are
those of ``Tokenizer.encode(text, add_special_tokens=False)``, as the library
gives them by default: the string of an added token, such as an end mark that
stands in a text, becomes that token's id. A text with one is encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Chunks in one generation of the cache; two generations are kept.
CACHE = 500_000

_SPACES = r"\s\x1c-\x1f\x85\xa0 ᠎ -‏ -  ⁠　﻿"
#: Texts in which white space is only single spaces and line ends between other
#: characters; all others take the general way.
_ODD = re.compile(rf"[^\S \n]|[\x1c-\x1f\x85\xa0 ᠎ -‏ -  ⁠　﻿]|[ \n][ \n]|\A[ \n]|[ \n]\Z")
_BEFORE_WORD = re.compile(rf" (?=[^{_SPACES}])")
#: One piece of either way of cutting: a Latin word.
_WORD = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: A Latin word and the punctuation after it: a piece begins at the punctuation.
#: Latin-1 only: beyond it a letter may become two when lowered.
_WORD_POINT = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,:;!?*#$%&|)\"]+)")
_ASCII_WHITE = re.compile(r"[ \t\n\r\x0b\x0c]+")


def load(path: str):
    """The tokenizer of a file. Names without a folder are looked up among the
    installed public tokenizers."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    if os.sep not in path:
        import public_tokenizers

        path = public_tokenizers.path(path)
    return Tokenizer.from_file(path)


def bytes_to_letters() -> dict[int, int]:
    """How byte-level tokenizers spell bytes: printable Latin-1 as itself, the
    others, in order, from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(others)}


class ChunkEncoder:
    """Encodes whole texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str, cache: int = CACHE):
        self.tok = load(path)
        spec = json.loads(self.tok.to_str())
        pre, norm = json.dumps(spec.get("pre_tokenizer")), json.dumps(spec.get("normalizer"))
        if spec["pre_tokenizer"] and spec["pre_tokenizer"].get("type") == "ByteLevel" and spec["normalizer"] is None and not spec["pre_tokenizer"]["add_prefix_space"]:
            self.cut = self._cut_byte_level
        elif '"Removed"' in pre and "\\\\s+" in norm:  # white space separates pieces and is dropped
            self.cut = self._cut_white if "Lowercase" in norm else lambda text: self._cut_white(text, False)
        else:
            self.cut = lambda text: [text]
        letters = bytes_to_letters()
        if self.cut == self._cut_byte_level:
            self.spell = lambda w: w.encode().decode("latin-1").translate(letters)
        elif self.cut == self._cut_white and "Lowercase" in norm:
            self.spell = lambda w: w.lower().encode().decode("latin-1").translate(letters)
        else:
            self.spell = None
        self.model = self.tok.model
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.limit, self.new, self.old = cache, {}, {}

    @staticmethod
    def _cut_white(text: str, lower: bool = True) -> list[str]:
        if lower:
            try:  # in Latin-1, lowering first changes no id, and fewer chunks differ
                text.encode("latin-1")
                text = text.lower()
            except UnicodeEncodeError:
                pass
        return [w for w in _ASCII_WHITE.split(text) if w]

    @staticmethod
    def _cut_byte_level(text: str) -> list[str]:
        """A piece begins at every space before a non-space, and a lone line end
        between non-spaces is a piece."""
        if not _ODD.search(text):
            return text.replace("\n", " \n ").replace(" ", "\x00 ").replace("\x00 \n\x00 ", "\x00\n\x00").split("\x00") if "\x00" not in text else [text]
        first, *rest = _BEFORE_WORD.split(text)
        return [first, *(" " + x for x in rest)]

    def _lookup(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids of the given chunks; what is met again stays cached."""
        missing = [c for c in chunks if c not in self.new]
        if len(self.new) + len(missing) > self.limit:
            self.old, self.new = self.new, {}
            missing = list(chunks)
        todo, both = {}, {}
        for c in missing:
            if (ids := self.old.get(c)) is not None:
                self.new[c] = ids
            elif m := _WORD_POINT.fullmatch(c):
                both[c] = m.groups()
            else:
                todo[c] = None
        for parts in both.values():
            for c in parts:
                if c not in self.new:
                    if (ids := self.old.get(c)) is not None:
                        self.new[c] = ids
                    else:
                        todo[c] = None
        if self.spell:  # words are one piece: the merges alone are needed
            words, todo = [c for c in todo if _WORD.fullmatch(c)], [c for c in todo if not _WORD.fullmatch(c)]
            for w in words:
                self.new[w] = np.array([x.id for x in self.model.tokenize(self.spell(w))], "<u4").tobytes()
        todo = list(todo)
        for at in range(0, len(todo), 4096):
            part = todo[at : at + 4096]
            for c, e in zip(part, self.tok.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.new[c] = np.asarray(e.ids, "<u4").tobytes()
        for c, (word, point) in both.items():
            self.new[c] = self.new[word] + self.new[point]
        return self.new

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            if any(a in text for a in self.added):
                yield np.asarray(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
                continue
            chunks = self.cut(text)
            ids = self.new
            try:
                yield b"".join(map(ids.__getitem__, chunks))
            except KeyError:
                ids = self._lookup(set(chunks))
                yield b"".join(map(ids.__getitem__, chunks))


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder per Python worker and tokenizer; its cache outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Texts of a batch, null as empty; lone surrogates cannot occur in Arrow."""
    return [t if t is not None else "" for t in batch.column(column).to_pylist()]


def tokenize(df: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of every whole text and then ``end_id``, as
    little-endian unsigned 32-bit integers. A null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.asarray([end_id], "<u4").tobytes()
        for b in batches:
            ids = [x + end for x in enc.encode(texts_of(b))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "doc_id long, ids binary")
