"""Near-duplicate lines by a deletion-neighbourhood join.

A line is its sequence of words. Two lines are near if one word is replaced,
inserted or deleted between them. Every line emits hashed variants: itself, and
itself without each one of its words; lines that meet in a variant are near
exactly if

* one is the variant itself, and the other lost a word (insertion, deletion), or
* both lost the word at the same place (replacement),

so the place is part of the key of a replacement. Lines that share such a key
are all near to each other: one aggregation finds the earliest of a key, and no
pairs of a group are emitted. Every link so found is verified on the words.

A line is removed if an earlier line (by document id, then line) is equal or
near to it, whether or not that one is removed itself. Lines of any length are
compared by equality; by edits those of ``near_words`` or more, five by default,
where one word is a fifth of the line. Before variants are made, lines are
brought down to distinct ones, and to those that share their first or last half
with another line: an edit leaves one half as it was, so nothing near is lost.
Which halves are shared is found exactly; a bit field, sized by their number,
only spares lines without any from being moved for that.

Defined results: null texts stay null, blank lines stay; lines at one place of
rows with equal ids are neither earlier, so both stay; an id that is null or no
whole number counts as later than all others; texts and lines may be of any
length. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import materialize, small_batches

MIN_WORDS, NEAR_WORDS = 1, 5
#: Bits of the field for each shared half, and the most that it may have in all
#: (128 MB). Beyond it more lines than need be are moved; the result is the same.
BITS_EACH, MOST_BITS = 32, 30
_B = 0x9E3779B97F4A7C15 | 1
_INV = pow(_B, -1, 1 << 64)


def line_words(line: str) -> list[str]:
    return [w for w in line.replace("\t", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def halves(words: list[str]) -> list[int]:
    """Keys of the first and the last half, at the lengths at which a line of
    one word more, of as many, or of one word less would take them."""
    n = len(words)
    out = []
    for h in sorted({(n - 1) // 2, n // 2}):
        out += [_signed(xxhash.xxh3_64_intdigest(f"{side}{h}\n" + " ".join(part))) for side, part in (("<", words[:h]), (">", words[n - h :]))]
    return out


def variants(words: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """(replacement keys, deletion keys, own key) of a line."""
    n = len(words)
    w = np.array([xxhash.xxh3_64_intdigest(x) for x in words], np.uint64)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _B, np.uint64)]), dtype=np.uint64)
        p = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * power[:n], dtype=np.uint64)])
        without = p[:-1] + (p[-1] - p[1:]) * np.uint64(_INV)
        place = (np.arange(n, dtype=np.uint64) + np.uint64(n << 20)) * np.uint64(0xC2B2AE3D27D4EB4F)
        swap = ((without ^ (without >> np.uint64(31))) + np.uint64(1)) * np.uint64(0xFF51AFD7ED558CCD) + place
        own = np.array([p[-1]], np.uint64)
        mix = lambda x: (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
        return mix(swap).view(np.int64), mix(without).view(np.int64), int(mix(own).view(np.int64)[0])


def near(a: list[str], b: list[str]) -> bool:
    """Whether at most one word is replaced, inserted or deleted between them."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def _key(id_col: str, text_col: str) -> list[Column]:
    """A document: its id and its text's hash. Null ids sort last."""
    return [F.coalesce(F.col(f"`{id_col}`").try_cast("long"), F.lit((1 << 63) - 1)).alias("d"), F.xxhash64(F.col(f"`{text_col}`")).alias("k"), F.col(f"`{text_col}`").alias("t")]


def _place() -> Column:
    """A line's place in the order of all lines, as one number that an
    aggregation can hold in its buffer: document id, then line, then nine digits
    of a hash, which tell lines apart that stand at one place of equal ids."""
    at = F.col("d").cast("decimal(19,0)") * F.lit(10**10).cast("decimal(11,0)") + F.col("n")
    return (at.cast("decimal(29,0)") * F.lit(10**9).cast("decimal(10,0)")).cast("decimal(38,0)") + F.pmod(F.col("h1"), F.lit(10**9))


def _order(place: Column) -> Column:
    """A place without the digits of the hash."""
    return place - F.pmod(place, F.lit(10**9).cast("decimal(10,0)"))


def _named(batches: list[list], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(batches, kinds, strict=True)], names)


def _hashes(text: str) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(text)
    return _signed(h >> 64), _signed(h & 0xFFFFFFFFFFFFFFFF)


def _lines(docs: DataFrame, min_words: int, near_words: int) -> DataFrame:
    """(d, k, n, h1, h2, x) of lines with ``min_words`` words: two hashes, and
    the keys of the halves of those that are compared by edits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for d, k, t in zip(b.column("d").to_pylist(), b.column("k").to_pylist(), b.column("t").to_pylist(), strict=True):
                for n, line in enumerate((t or "").split("\n")):
                    words = line_words(line)
                    if len(words) >= min_words:
                        row = (d, k, n, *_hashes(" ".join(words)), halves(words) if len(words) >= near_words else None)
                        for c, v in zip(cols, row, strict=True):
                            c.append(v)
            yield _named(cols, ["d", "k", "n", "h1", "h2", "x"], [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())])

    return docs.mapInArrow(run, "d long, k long, n int, h1 long, h2 long, x array<long>")


class Field:
    """A bit field of keys, two places each. It may let others through."""

    def __init__(self, keys: DataFrame):
        self.bits = min(MOST_BITS, max(15, (BITS_EACH * keys.count()).bit_length()))
        places = F.explode(F.array(F.shiftrightunsigned("key", 64 - self.bits), F.col("key").bitwiseAND((1 << self.bits) - 1))).alias("p")
        parts = keys.select(places).groupBy(F.shiftright("p", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(0x7FFF)).alias("bitmap"))
        self.field = np.zeros((1 << self.bits - 15, 4096), np.uint8)
        for r in parts.toLocalIterator():
            self.field[r["part"]] = np.frombuffer(r["bitmap"], np.uint8)
        self.field = self.field.ravel()

    def has(self, keys: np.ndarray) -> np.ndarray:
        k = keys.view(np.uint64)
        out = np.ones(len(k), bool)
        for p in (k >> np.uint64(64 - self.bits), k & np.uint64((1 << self.bits) - 1)):
            p = p.astype(np.int64)
            out &= (self.field[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)
        return out


def _candidates(docs: DataFrame, near_words: int, shared: Field) -> DataFrame:
    """(place, front, back, x, h1, h2) of distinct lines of which a half is
    shared: ``front``, if the first half is, so that an edit can lie behind it."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.string()]
    names = ["h1", "h2", "d", "n", "keys", "x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple] = {}  # copies within a task: the earliest
        size = 0

        def flush() -> pa.RecordBatch:
            cols = [list(c) for c in zip(*((*h, *v) for h, v in held.items()), strict=True)] if held else [[] for _ in kinds]
            held.clear()
            return _named(cols, names, kinds)

        for b in batches:
            for d, t in zip(b.column("d").to_pylist(), b.column("t").to_pylist(), strict=True):
                found = []
                for n, line in enumerate((t or "").split("\n")):
                    words = line_words(line)
                    if len(words) >= near_words:
                        found.append((n, words, halves(words)))
                if not found:
                    continue
                ends = np.cumsum([len(k) for *_, k in found])
                hit = shared.has(np.array([x for *_, k in found for x in k], np.int64))
                some = np.add.reduceat(hit, ends - [len(k) for *_, k in found])
                for i in np.flatnonzero(some).tolist():
                    n, words, keys = found[i]
                    text = " ".join(words)
                    h = _hashes(text)
                    if h not in held or (d, n) < held[h][:2]:
                        held[h] = (d, n, keys, text)
                        size += len(text)
            if len(held) > 20_000 or size > 1 << 24:
                yield flush()
                size = 0
        yield flush()

    out = docs.mapInArrow(run, "h1 long, h2 long, d long, n int, keys array<long>, x string")
    texts = materialize(out.groupBy("h1", "h2").agg(F.min(_place()).alias("place"), F.first("keys").alias("keys"), F.first("x").alias("x")))
    # what the field let through for nothing goes here: a half is shared if two distinct lines have it
    sides = texts.select("place", F.posexplode("keys").alias("side", "key"))
    both = sides.groupBy("key").agg(F.min("place").alias("a"), F.max("place").alias("b")).where("a <> b").select("key")
    of = lambda k: F.bool_or(F.col("side") % 2 == k)
    flags = sides.join(both, "key").groupBy("place").agg(of(0).alias("front"), of(1).alias("back"))
    return materialize(texts.drop("keys").join(flags, "place"))


def _variants(texts: DataFrame) -> DataFrame:
    """(place, key, kind): kind 0 replacement, 1 deletion, 2 the line itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, keys, kinds = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int8)]
            for i, (x, front, back) in enumerate(zip(b.column("x").to_pylist(), b.column("front").to_pylist(), b.column("back").to_pylist(), strict=True)):
                words = x.split(" ")
                swap, drop, own = variants(words)
                n, h = len(words), (len(words) - 1) // 2
                lo, hi = 0 if back else h, n if front else n - h
                swap, drop = swap[lo:hi], np.unique(drop[lo:hi])
                keys.append(np.concatenate([swap, drop, [own]]))
                kinds.append(np.repeat(np.array([0, 1, 2], np.int8), [len(swap), len(drop), 1]))
                at.append(np.full(len(keys[-1]), i))
            rows = np.concatenate([np.zeros(0, np.int64), *at])
            yield pa.RecordBatch.from_arrays([b.column("place").take(pa.array(rows)), pa.array(np.concatenate(keys)), pa.array(np.concatenate(kinds))], ["place", "key", "kind"])

    return texts.select("place", "front", "back", "x").mapInArrow(run, "place decimal(38,0), key long, kind tinyint")


def _near(texts: DataFrame) -> DataFrame:
    """(place, by): lines that are near to an earlier one, verified."""
    of = lambda k: F.min(F.when(F.col("kind") == k, F.col("place")))
    best = _variants(texts).groupBy("key").agg(of(0).alias("swap"), of(1).alias("drop"), of(2).alias("own"), F.count("*").alias("c")).where("c > 1").drop("c")
    keyed, best = _variants(texts), materialize(best)
    earlier = F.when(F.col("kind") == 0, F.col("swap")).when(F.col("kind") == 1, F.col("own")).otherwise(F.col("drop"))
    links = keyed.join(best, "key").select("place", earlier.alias("by")).where(_order(F.col("by")) < _order(F.col("place"))).distinct()
    both = links.join(texts.select("place", "x"), "place").join(texts.select(F.col("place").alias("by"), F.col("x").alias("y")), "by")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [near(x.split(" "), y.split(" ")) for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)]
            yield b.select(["place", "by"]).filter(pa.array(ok, pa.bool_()))

    return both.select("place", "by", "x", "y").mapInArrow(verify, "place decimal(38,0), by decimal(38,0)").groupBy("place").agg(F.min("by").alias("by"))


def removed_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS) -> DataFrame:
    """(d, k, n, keeper_doc_id, keeper_line): every line to remove, by document
    (id and hash of the text) and number, with an earlier line that it repeats."""
    small_batches(df.sparkSession)
    near_words = max(near_words, min_words, 2)
    docs = df.select(*_key(id_col, text_col)).where(F.col("t").isNotNull())
    lines = materialize(_lines(docs, min_words, near_words))
    half = lines.where(F.col("x").isNotNull()).select("h1", F.explode("x").alias("key"))
    shared = Field(materialize(half.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("key")))
    texts = _candidates(docs.select("d", "t"), near_words, shared)
    near = texts.select("h1", "h2", "place").join(_near(texts), "place").select("h1", "h2", "by")
    copies = lines.groupBy("h1", "h2").agg(F.min(_place()).alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    act = materialize(copies.join(near, ["h1", "h2"], "full"))
    keeper = F.least("by", F.when(F.col("first") < _place(), F.col("first")))
    out = lines.select("d", "k", "n", "h1", "h2").join(act, ["h1", "h2"]).withColumn("keeper", keeper).where(F.col("keeper").isNotNull())
    digits = F.lpad((_order(F.col("keeper"))).cast("string"), 38, "0")
    return out.select("d", "k", "n", F.substring(digits, 1, 19).cast("long").alias("keeper_doc_id"), F.substring(digits, 20, 10).cast("int").alias("keeper_line"))


def _cut(text: Column, gone: Column) -> Column:
    """The text without the lines of these numbers (ascending): the runs of lines
    between them, so it takes time in proportion to the lines."""
    minus = F.array(F.lit(-1))

    def runs(lines: Column) -> Column:
        begin, end = F.concat(minus, gone), F.concat(gone, F.array(F.size(lines)))
        return F.flatten(F.zip_with(begin, end, lambda a, z: F.slice(lines, a + 2, z - a - 1)))

    # a lambda's argument is split once, not once a run
    return F.array_join(F.element_at(F.transform(F.array(F.split(text, "\n")), runs), 1), "\n")


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS, report: str = "_ld_removed") -> DataFrame:
    """``df`` with the text shortened to the kept lines. A last column lists the
    removed ones: (line, keeper_doc_id, keeper_line), null if there are none; it
    is named ``report``, with underscores after it if ``df`` has such a column."""
    gone = materialize(removed_lines(df, id_col, text_col, min_words, near_words))
    per = gone.groupBy("d", "k").agg(F.array_sort(F.collect_set(F.struct(F.col("n").alias("line"), "keeper_doc_id", "keeper_line"))).alias("removed"))
    rows = df.select(*_key(id_col, text_col), F.struct("*").alias("row")).join(per, ["d", "k"], "left")
    kept = _cut(F.col("t"), F.transform("removed", lambda r: r["line"]))
    text = F.when(F.col("removed").isNull(), F.col("t")).otherwise(kept)
    while report in df.columns:
        report += "_"
    return rows.select(*(text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in df.columns), F.col("removed").alias(report))
