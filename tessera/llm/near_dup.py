"""Near-duplicate documents by improved consistent weighted sampling.

Documents are sets of five-word shingles weighted by TF-IDF. Samples whose
chance to agree is the weighted Jaccard similarity are banded; documents that
share a band are candidates, and every link is verified by the weighted Jaccard
similarity itself. Classes are the connected components of the verified links.

* Exact copies are brought down to one text first, so a group of copies costs as
  much as one document.
* The inverse document frequency is that of every shingle, damped to lie between
  1 and 2: 1 + ln(N / n) / ln(N), where n of N documents have it. Undamped, the
  shingles that a thousand near copies share would weigh so much less than those
  that an edit makes that the copies would no longer count as alike. The counts
  are hashed to 2**22 counters, whatever the corpus; what other shingles add to
  a counter on average is taken off. Weights are rounded to 1/64.
* Samples come from tables of 2**14 random (r, c, beta): an element's place in
  them is a hash, and for shingles that occur once the samples of all weights
  are tabled too.
* A bucket is not expanded into pairs. Its members meet its least member; where
  several classes are left in it after that, the members outside the main class
  meet all others, in blocks of bounded size, and links alone come out. Pairs
  whose total weights rule out the similarity are skipped.

Defined results: words are as in ``phrase_index``; a text of one to four words
is one shingle; a null text or one without words is a class of its own; rows
that repeat share a class; of equal ids and texts one row is kept; ids may be of
any type that has an order, null comes last; an empty table gives no rows; long
texts are one set each, in batches of bounded size; ``drop_near_duplicates``
passes other columns through, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import materialize, small_batches
from tessera.llm.phrase_index import _FOLD

WORDS, SIMILARITY = 5, 0.8
BANDS, BAND_ROWS = 24, 6
#: Documents of a chunk; bits of a document counter's place, counters that move
#: together, and steps of the inverse document frequency.
CHUNK, COUNTERS, TOGETHER, STEPS = 1024, 22, 1024, 32
_PLACES = 14
_BITS = 20
#: Members of a bucket in one block.
BLOCK = 256

_rng = np.random.default_rng(20240501)
_POW = _rng.integers(1, 1 << 63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEED = _rng.integers(1, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R = _rng.gamma(2.0, 1.0, 1 << _PLACES)
_LOG_C = np.log(_rng.gamma(2.0, 1.0, 1 << _PLACES))
_BETA = _rng.random(1 << _PLACES)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle, times), ordered; shingles are 64-bit hashes."""
    folded = [b"" if t is None else t.encode("utf-8", "replace").translate(_FOLD) for t in texts]
    raw = np.frombuffer(b" ".join([*folded, b""]) or b" ", np.uint8)
    letter = raw != 32
    edge = np.diff(letter.astype(np.int8), prepend=0, append=0)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = stop - start
    at = np.flatnonzero(letter)
    first = np.cumsum(size) - size
    inside = np.arange(len(at)) - np.repeat(first, size)
    with np.errstate(over="ignore"):
        word = _mix(np.add.reduceat((raw[at].astype(np.uint64) + np.uint64(1)) * _POW[inside & 1023], first) + size.astype(np.uint64))
        begins = np.cumsum([0, *(len(x) + 1 for x in folded)])
        owner = np.searchsorted(begins, start, "right") - 1
        n = np.bincount(owner, minlength=len(texts))
        last = np.cumsum(n)
        padded = np.append(word, np.zeros(WORDS, np.uint64))
        # words of a text that follow, at most WORDS
        left = np.minimum(WORDS, last[owner] - np.arange(len(word)))
        s = np.zeros(len(word), np.uint64)
        for k in range(WORDS):
            s += np.where(left > k, padded[k : k + len(word)] * _PLACE[k], np.uint64(0))
        s = _mix(s)
    whole = (left == WORDS) | (n[owner] < WORDS) & (np.arange(len(word)) == last[owner] - n[owner])
    owner, s = owner[whole], s[whole]
    order = np.lexsort((s, owner))
    owner, s = owner[order], s[order]
    new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (s[1:] != s[:-1])]))
    return owner[new], s[new], np.diff(np.append(new, len(s)))


class Weights:
    """TF-IDF weights, relative to that of a shingle of one document that occurs
    once. ``counts``: the documents of each counter's shingles; ``n``: all."""

    def __init__(self, counts: np.ndarray, n: int):
        others = counts.sum() / len(counts)
        alone = np.clip(counts - others, 1, max(n, 1))
        share = 1 - np.log(alone) / np.log(n) if n > 1 else np.ones(len(counts))
        self.steps = np.rint(STEPS * share).astype(np.uint8)

    def step(self, s: np.ndarray) -> np.ndarray:
        return self.steps[(s >> np.uint64(64 - COUNTERS)).astype(np.int64)]


def value(step: np.ndarray, times: np.ndarray | int = 1) -> np.ndarray:
    """The weight of a shingle by its step and how often it occurs."""
    return (STEPS + step.astype(np.float64)) / (2 * STEPS) * times


def _draw(log_w: np.ndarray | float, place: np.ndarray) -> np.ndarray:
    """Samples as numbers: above, log a in order; below, a mark of t."""
    r = _R[place]
    t = np.floor(log_w / r + _BETA[place])
    a = (_LOG_C[place] - r * (t - _BETA[place]) - r).astype(np.float32)
    bits = a.view(np.uint32)
    rank = np.where(bits >> 31 == 1, ~bits, bits | np.uint32(0x80000000))
    mark = (t.astype(np.int64) * 0x9E3779B1).astype(np.uint64) & np.uint64(0xFFFFFFFF)
    return rank.astype(np.uint64) << np.uint64(32) | mark


#: Samples of shingles that occur once, by step and place.
_TABLE = np.concatenate([_draw(np.log(value(np.array([k]))), np.arange(1 << _PLACES)) for k in range(STEPS + 1)])


def bands(owner: np.ndarray, s: np.ndarray, step: np.ndarray, times: np.ndarray, n: int) -> np.ndarray:
    """Band keys (n by BANDS) of texts; those without shingles get zeros."""
    out = np.zeros((n, BANDS), np.uint64)
    if not len(s):
        return out.view(np.int64)
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    low, odd = s & np.uint64(0xFFFFFFFF), np.flatnonzero(times != 1)
    log_w, s_odd = np.log(value(step[odd], times[odd])), s[odd]
    row, shift = step.astype(np.uint64) << np.uint64(_PLACES), np.uint64(64 - _PLACES)
    with np.errstate(over="ignore"):
        for b in range(BANDS):
            key = np.full(len(first), b + 1, np.uint64)
            for seed in _SEED[b * BAND_ROWS : (b + 1) * BAND_ROWS]:
                drawn = _TABLE[row + ((s * seed) >> shift)]
                if len(odd):
                    drawn[odd] = _draw(log_w, ((s_odd * seed) >> shift).astype(np.int64))
                least = np.minimum.reduceat(drawn ^ low, first) & np.uint64(0xFFFFFFFF)
                key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + least)
            out[owner[first], b] = key
    return out.view(np.int64)


def similarity(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two packed sets."""
    (x, u), (y, v) = unpack(a), unpack(b)
    i = np.minimum(np.searchsorted(y, x), max(len(y) - 1, 0))
    same = y[i] == x if len(y) else np.zeros(len(x), bool)
    both = np.minimum(u[same], v[i[same]]).sum()
    return float(both / max(u.sum() + v.sum() - both, 1e-12))


def pack(s: np.ndarray, step: np.ndarray, times: np.ndarray) -> bytes:
    """A set in bytes: its number, how many shingles occur more than once, places
    and times of those, the high halves of the shingles, then their steps."""
    odd = np.flatnonzero(times != 1)
    return np.array([len(s), len(odd), *odd, *times[odd]], "<u4").tobytes() + (s >> np.uint64(32)).astype("<u4").tobytes() + step.astype("u1").tobytes()


def unpack(x: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, k = np.frombuffer(x, "<u4", 2).tolist()
    odd, times = np.frombuffer(x, "<u4", 2 * k, 8).reshape(2, k)
    s, w = np.frombuffer(x, "<u4", n, 8 + 8 * k), value(np.frombuffer(x, "u1", n, 8 + 8 * k + 4 * n))
    w[odd] *= times
    return s, w


def digest(text: str) -> bytes:
    """128 bits that stand for a text, as ``_digest`` has them in Spark."""
    return hashlib.md5(text.encode("utf-8", "replace"), usedforsecurity=False).digest()


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _parts(batches: Iterator[pa.RecordBatch], chars: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of about ``chars`` characters at most, one text at least."""
    for b in batches:
        sizes = [len(t) if t else 0 for t in b.column("t").to_pylist()]
        at = 0
        while at < b.num_rows:
            stop, n = at, 0
            while stop < b.num_rows and (stop == at or n + sizes[stop] <= chars):
                n, stop = n + sizes[stop], stop + 1
            yield b.slice(at, stop - at)
            at = stop


def weights(docs: DataFrame) -> Weights:
    """The weights of a corpus (column ``t``), from one pass over all of it. A
    task adds its counters up before they move."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, n = np.zeros(1 << COUNTERS, np.uint32), [], 0
        for b in _parts(batches):
            owner, s, _ = shingles(b.column("t").to_pylist())
            n += len(np.unique(owner))
            held.append((s >> np.uint64(64 - COUNTERS)).astype(np.int64))
            if sum(map(len, held)) >= 1 << 21:
                total += np.bincount(np.concatenate(held), minlength=len(total)).astype(np.uint32)
                held = []
        if held:
            total += np.bincount(np.concatenate(held), minlength=len(total)).astype(np.uint32)
        blocks = total.reshape(-1, TOGETHER)
        some = np.flatnonzero(blocks.any(1))
        for at in range(0, len(some), 256):
            k = some[at : at + 256]
            # four bytes a counter only where one byte is too little
            data = [x.astype("<u4").tobytes() if x.max() > 255 else x.astype("u1").tobytes() for x in blocks[k]]
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array([0] * len(k), pa.int64()), pa.array(data, pa.binary())], ["block", "n", "data"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([n], pa.int64()), pa.array([b""], pa.binary())], ["block", "n", "data"])

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(TOGETHER, np.uint64)
        for x in pdf["data"]:
            if x:
                total += np.frombuffer(x, "u1" if len(x) == TOGETHER else "<u4").astype(np.uint64)
        return pd.DataFrame({"block": [key[0]], "n": [pdf["n"].sum()], "data": [total.astype("<u8").tobytes() if key[0] >= 0 else b""]})

    kinds = "block long, n long, data binary"
    # 2**22 counters at most, whatever the corpus
    found = docs.mapInArrow(count, kinds).groupBy("block").applyInPandas(add, kinds).toArrow()
    counts, n = np.zeros((1 << COUNTERS) // TOGETHER * TOGETHER, np.float64).reshape(-1, TOGETHER), 0
    for block, m, data in zip(*(found.column(c).to_pylist() for c in ("block", "n", "data")), strict=True):
        n += m
        if block >= 0:
            counts[block] = np.frombuffer(data, "<u8")
    return Weights(counts.ravel(), n)


def _signatures(docs: DataFrame, weight: Weights) -> DataFrame:
    """(doc_id, g, total, bands): g is the text's digest, null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            texts = b.column("t").to_pylist()
            owner, s, times = shingles(texts)
            step = weight.step(s)
            total = np.bincount(owner, value(step, times), minlength=len(texts)).astype(float)  # of nothing it is integers
            keys = bands(owner, s, step, times, len(texts))
            g = [digest(t) if n > 0 else None for t, n in zip(texts, total.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(g, pa.binary()), pa.array(total, pa.float64()), pa.array(list(keys), pa.list_(pa.int64()))], ["doc_id", "g", "total", "bands"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, g binary, total double, bands array<long>")


def _sets(docs: DataFrame, pool: DataFrame, weight: Weights) -> DataFrame:
    """(g, x): the packed sets of the texts in ``pool``. A bit field of bounded
    size keeps most others from being packed; the join is exact."""
    place = F.shiftright(F.conv(F.hex(F.substring("g", 1, 3)), 16, 10).cast("int"), 24 - _BITS)
    hit = np.zeros(1 << _BITS, bool)
    hit[pool.select(place.alias("p")).distinct().toArrow().column("p").to_numpy()] = True  # 2**20 at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in _parts(batches):
            texts, gs = [], []
            for t in b.column("t").to_pylist():
                g = digest(t) if t else None
                if g and hit[int.from_bytes(g[:3], "big") >> (24 - _BITS)] and g not in seen:
                    if len(seen) < 100_000:
                        seen.add(g)
                    texts.append(t)
                    gs.append(g)
            owner, s, times = shingles(texts)
            step = weight.step(s)
            cut = np.searchsorted(owner, np.arange(len(texts) + 1))
            x = [pack(s[i:j], step[i:j], times[i:j]) for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(gs, pa.binary()), pa.array(x, pa.binary())], ["g", "x"])

    return docs.mapInArrow(run, "g binary, x binary").join(pool, "g", "left_semi").dropDuplicates(["g"])


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose similarity is at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [similarity(x, y) >= least for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(sets.select(F.col("g").alias("a"), "x"), "a").join(sets.select(F.col("g").alias("b"), F.col("x").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def _dealt(rest: DataFrame) -> DataFrame:
    """Cells (band, i, j) of blocks: block i of a bucket's members outside its
    main class, and block j of all its members. Rows are (band, g, label, main,
    n, n_odd); a member stands in its column of cells, one outside the main class
    in its row of cells too. One such member among a million meets them in as
    many cells as there are blocks, and nothing else is repeated."""
    odd = F.col("label") != F.col("main")
    rows, columns = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("n_odd", "n"))
    here = F.xxhash64("g", "band")
    every = F.sequence
    own = rest.select("band", "g", "label", F.lit(False).alias("odd"), F.explode(every(F.lit(0), rows - 1)).alias("i"), F.pmod(here, columns).cast("int").alias("j"))
    met = rest.where(odd).select("band", "g", "label", F.lit(True).alias("odd"), F.pmod(here, rows).cast("int").alias("i"), F.explode(every(F.lit(0), columns - 1)).alias("j"))
    return own.unionAll(met)


def _meet(rest: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between classes within buckets: members outside the bucket's
    main class meet all members of other classes, cell by cell. A task holds two
    blocks of ``BLOCK`` members or so; no pairs are emitted but links."""
    keyed = _dealt(rest).join(sets, "g")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        packed = [unpack(x) for x in pdf["x"]]
        at = np.cumsum([0, *(len(s) for s, _ in packed)])
        ids, number = np.unique(np.concatenate([s for s, _ in packed]), return_inverse=True)
        w = np.concatenate([v for _, v in packed])
        total = np.add.reduceat(w, at[:-1])
        names, label = np.unique(pdf["label"].to_numpy(), return_inverse=True)
        g, mine = pdf["g"].to_numpy(), np.zeros(len(ids))
        out = []
        for i in np.flatnonzero(pdf["odd"].to_numpy()):
            here = slice(at[i], at[i + 1])
            mine[number[here]] = w[here]
            both = np.add.reduceat(np.minimum(w, mine[number]), at[:-1])
            mine[number[here]] = 0
            near = both >= (least - 1e-9) * (total + total[i] - both)
            for j in np.flatnonzero(near & (label != label[i])):
                if label[i] != label[j]:  # not linked meanwhile
                    out.append((g[i], g[j]))
                    label[label == label[j]] = label[i]
        return pd.DataFrame(out, columns=["a", "b"])

    return keyed.groupBy("band", "i", "j").applyInPandas(run, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(g, label) of all ends of the edges (a, b): the least end of each
    connected component, by rounds of least labels and pointer jumps."""
    both = materialize(edges.select("a", "b").unionAll(edges.select("b", "a")).where("a <> b").distinct())
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("g"), F.least("a", "m").alias("label")))
    while True:
        near = both.join(labels, F.col("b") == F.col("g")).groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near, F.col("g") == F.col("a")).select("g", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        up = labels.select(F.col("g").alias("u"), F.col("label").alias("ul"))
        new = materialize(step.join(up, F.col("label") == F.col("u")).select("g", "old", F.least("label", "ul").alias("label")))
        if new.where("label <> old").isEmpty():
            return new.select("g", "label")
        labels = new.select("g", "label")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """(doc_id, g, class_id, keeper): the class of every document, named by its
    least document id, and whether the document is its keeper, that is the one of
    the least id (texts of one id in order of their digests)."""
    spark: SparkSession = df.sparkSession
    small_batches(spark)
    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("t"))
    weight = weights(docs.select("t"))
    signed = materialize(_signatures(docs, weight))
    texts = signed.where(F.col("g").isNotNull()).groupBy("g").agg(F.first("total").alias("total"), F.first("bands").alias("bands"))
    members = materialize(texts.select("g", "total", F.explode("bands").alias("band")))
    buckets = members.groupBy("band").agg(F.min(F.struct("g", "total")).alias("lead"), F.max("g").alias("m")).where("lead.g <> m").select("band", "lead")
    fits = lambda x, y: F.least(x, y) >= (least - 1e-9) * F.greatest(x, y)
    met = materialize(members.join(buckets, "band"))  # members of buckets of two texts and more
    pairs = materialize(met.where((F.col("g") != F.col("lead.g")) & fits(F.col("total"), F.col("lead.total"))).select(F.col("lead.g").alias("a"), F.col("g").alias("b")).distinct())
    sets = materialize(_sets(docs.select("t"), met.select("g").distinct(), weight))
    links = materialize(_verified(pairs, sets, least))
    labels = components(links)
    # buckets in which several classes are left: their smaller classes meet all
    named = met.select("band", "g").join(labels, "g", "left").withColumn("label", F.coalesce("label", "g"))
    sizes = named.groupBy("band", "label").agg(F.count("*").alias("n")).groupBy("band").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("n_odd"), F.count("*").alias("classes")).where("classes > 1").drop("classes")
    rest = materialize(named.join(sizes, "band"))
    if not rest.isEmpty():
        links = links.unionAll(materialize(_meet(rest, sets, least)))
        labels = components(links)
    own = signed.where(F.col("g").isNotNull()).groupBy("g").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "g")).alias("first"))
    labelled = own.join(labels, "g", "left").withColumn("label", F.coalesce("label", "g"))
    heads = labelled.groupBy("label").agg(F.min("first").alias("head"))
    of = labelled.join(heads, "label").select("g", "head")
    out = signed.select("doc_id", "g").join(of, "g", "left")
    lone = F.col("head").isNull()
    return out.select(
        "doc_id",
        "g",
        F.when(lone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"),
        (lone | F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("g") == F.col("head.g"))).alias("keeper"),
    )


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row of each class, with its own columns: the keeper, and of rows that
    repeat its id and text one."""
    t = F.col(f"`{text_col}`")
    rows = df.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").alias("k"), F.when(t != "", _digest(t)).alias("x"))
    found = near_duplicates(df, id_col, text_col, least)
    gone = found.where(~F.col("keeper")).select("doc_id", "g").distinct()
    again = found.where("keeper and g is not null").groupBy("doc_id", "g").agg(F.count("*").alias("c")).where("c > 1").drop("c")
    same = F.col("k").eqNullSafe(F.col("doc_id")) & (F.col("x") == F.col("g"))
    left = rows.join(gone, same, "left_anti")
    if not again.isEmpty():
        once = left.join(again, same, "left_semi").groupBy("k", "x").agg(F.first("row").alias("row")).select("row", "k", "x")
        left = left.join(again, same, "left_anti").unionAll(once)
    return left.select("row.*")
