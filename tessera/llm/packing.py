"""Packing documents into windows of a fixed number of tokens.

A document is cut into full windows and a remainder. Remainders are packed
online, whole and in the order of their documents, by the sum-of-squares rule:
the level array counts the open windows at each fill level, and a remainder goes
where the sum of the squared counts becomes smallest; a full window leaves the
array. Windows that are open at the end are closed up: the emptiest give their
pieces to the fullest, and only here a remainder is cut, at a multiple of a
grain, where it does not fit as a whole. Packing runs in groups of bounded size
dealt by hash, so no task and no level array grows with the corpus.

Ids do not move: a remainder carries the checksums of its beginnings at every
grain, from which that of any cut follows.

Defined results: a null or empty text is the end id alone; repeated rows are
packed one by one; ids may be null; an empty table gives no pieces; a text of any
length is cut into as many full windows as it has; columns besides id and text
are not read, so their names cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import materialize, small_batches
from tessera.llm.tokens import encoder, texts_of

#: Documents in one group, and the tokens that a remainder may be cut at.
GROUP_ROWS, GRAIN = 8192, 16

PIECES = "doc_id long, row long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, begins binary"


def cut(df: DataFrame, tokenizer: str, end_id: int, window: int = 1024, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, grain: int = GRAIN) -> DataFrame:
    """The pieces of every whole text: full windows, then what is left. ``row``
    numbers the rows of a task; ``ids`` are the piece's own (null without
    ``with_ids``); ``begins`` has the checksums of a remainder's beginnings of
    grain, 2 grain, ... tokens."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, row, wide, step = encoder(tokenizer), np.asarray([end_id], "<u4").tobytes(), 0, 4 * window, 4 * grain
        for b in batches:
            out: list[list] = [[] for _ in range(8)]
            for doc, ids in zip(b.column("doc_id").to_pylist(), enc.encode(texts_of(b)), strict=True):
                ids += end
                n, row = len(ids) // 4, row + 1
                for at in range(0, 4 * n, wide):
                    piece = ids[at : at + wide]
                    begins, crc = [], 0
                    if len(piece) < wide:
                        for k in range(step, len(piece), step):
                            crc = zlib.crc32(piece[k - step : k], crc)
                            begins.append(crc)
                        crc = zlib.crc32(piece[len(begins) * step :], crc)
                    else:
                        crc = zlib.crc32(piece)
                    begun = np.array(begins, "<u4").tobytes() if begins else None
                    for column, v in zip(out, (doc, row, at // 4, len(piece) // 4, crc, n, piece if with_ids else None, begun), strict=True):
                        column.append(v)
            columns = [*(pa.array(c, pa.int64()) for c in out[:6]), *(pa.array(c, pa.binary()) for c in out[6:])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "start", "length", "ids_crc32", "doc_tokens", "ids", "begins"])

    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, PIECES)


_POLYNOMIAL = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of polynomials modulo that of CRC-32, lowest power in bit 31."""
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = b >> 1 ^ (_POLYNOMIAL if b & 1 else 0)
    return out


def crc_of_rest(whole: int, begin: int, n_bytes: int) -> int:
    """The checksum of the last ``n_bytes`` bytes, by those of all and of the rest
    before: the latter is moved on by as many zero bytes and taken off."""
    power, moved, n = 1 << 23, begin, n_bytes  # x to the 8
    while n:
        if n & 1:
            moved = _times(power, moved)
        power, n = _times(power, power), n >> 1
    return whole ^ moved


def sum_of_squares(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(window number, offset) of each item, in the order given.

    Moving a window from level l to l + n changes the sum of squares by
    2 (N[l+n] - N[l]) + 2, opening one by 2 N[n] + 1, filling one by 1 - 2 N[l];
    only levels that hold a window are open. Ties go to the fullest level.
    """
    count = np.zeros(window + 1, np.int64)
    at_level: list[list[int]] = [[] for _ in range(window + 1)]
    number, offset, opened = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i, n in enumerate(lengths.tolist()):
        if n >= window:
            number[i], opened = opened, opened + 1
            continue
        here = count[1 : window - n + 1]
        change = 2 * (count[n + 1 : window + 1] - here) + 2
        change[-1] = 1 - 2 * here[-1]
        change[here == 0] = np.iinfo(np.int64).max
        best = len(change) - 1 - int(np.argmin(change[::-1]))
        if change[best] <= 2 * count[n] + 1:
            level = best + 1
            w = at_level[level].pop()
            count[level] -= 1
        else:
            level, w, opened = 0, opened, opened + 1
        number[i], offset[i] = w, level
        if level + n < window:
            at_level[level + n].append(w)
            count[level + n] += 1
    return number, offset


def close_up(number: np.ndarray, lengths: np.ndarray, window: int, grain: int = GRAIN) -> list[tuple[int, int, int, int]]:
    """(item, first token, tokens, window) of every piece, after the windows that
    are still open have been closed up. Windows keep their numbers."""
    fill = np.bincount(number, lengths, minlength=0).astype(np.int64) if len(number) else np.zeros(0, np.int64)
    still = np.flatnonzero((fill < window) & (fill > 0))
    mine: dict[int, list[tuple[int, int, int]]] = {w: [] for w in still.tolist()}
    out = []
    for i, (w, n) in enumerate(zip(number.tolist(), lengths.tolist(), strict=True)):
        if w in mine:
            mine[w].append((i, 0, n))
        else:
            out.append((i, 0, n, w))
    order = sorted(mine, key=lambda w: (-fill[w], w))
    i, j = 0, len(order) - 1
    while i < j:
        to, source = order[i], order[j]
        gap = window - int(fill[to])
        if gap < grain:
            i += 1
            continue
        if not mine[source]:
            j -= 1
            continue
        item, first, n = mine[source].pop()
        part = n if n <= gap else gap // grain * grain
        if part < n:
            mine[source].append((item, first + part, n - part))
        mine[to].append((item, first, part))
        fill[to] += part
        fill[source] -= part
    return out + [(*piece, w) for w in order for piece in mine[w]]


def pack(pieces: DataFrame, window: int = 1024, rows: int | None = None, group_rows: int = GROUP_ROWS, grain: int = GRAIN) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces; remainders that are cut become
    two pieces and more, with ``ids`` cut likewise if they are there.

    A full piece is a sequence by itself and does not move. ``rows``: about how
    many remainders there are (documents); counted if not given.
    """
    pieces = materialize(pieces)  # read twice below, tokenized once
    cols = [c for c in pieces.columns if c != "begins"]
    full = pieces.where(F.col("length") >= window).withColumns({"sequence_id": F.monotonically_increasing_id().bitwiseOR(F.lit(1 << 62)), "offset": F.lit(0).cast("long")})
    tails = pieces.where(F.col("length") < window)
    groups = max(1, -(-(tails.count() if rows is None else rows) // group_rows))
    tails = tails.withColumn("_pk_group", F.pmod(F.xxhash64("doc_id", "row"), F.lit(groups)).cast("long"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "row", "ids_crc32"], kind="stable", ignore_index=True)
        length = pdf["length"].to_numpy()
        number, _ = sum_of_squares(length, window)
        item, first, n, w = (np.array(x, np.int64) for x in zip(*close_up(number, length, window, grain), strict=True))
        order = np.lexsort((first, item, w))
        item, first, n, w = item[order], first[order], n[order], w[order]
        before = np.cumsum(n) - n
        new = np.diff(w, prepend=-1) != 0
        out = pdf.iloc[item].reset_index(drop=True)
        crc, whole, begins, ids = out["ids_crc32"].tolist(), n == length[item], out["begins"].tolist(), out["ids"].tolist() if "ids" in cols else None
        for k in np.flatnonzero(~whole).tolist():
            a, z = int(first[k]), int(first[k] + n[k])
            at = lambda t: 0 if t == 0 else int(crc_whole) if t == total else int(known[t // grain - 1])  # noqa: B023, E731
            crc_whole, total, known = crc[k], int(length[item[k]]), np.frombuffer(begins[k], "<u4")
            crc[k] = crc_of_rest(at(z), at(a), 4 * (z - a))
            if ids is not None and ids[k] is not None:
                ids[k] = ids[k][4 * a : 4 * z]
        out = out.assign(start=out["start"] + first, length=n, ids_crc32=crc, sequence_id=(int(key[0]) << 32) + w, offset=before - np.maximum.accumulate(np.where(new, before, 0)))
        if ids is not None:
            out["ids"] = ids
        return out[[*cols, "sequence_id", "offset"]]

    kinds = ", ".join(f"`{c}` {t}" for c, t in tails.dtypes if c in cols)
    packed = tails.groupBy("_pk_group").applyInPandas(run, f"{kinds}, sequence_id long, offset long")
    return full.select(*cols, "sequence_id", "offset").unionAll(packed)
