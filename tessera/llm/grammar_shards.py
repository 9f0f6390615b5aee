"""Token-id files compressed by Re-Pair grammars.

``write_shards`` tokenizes whole texts, puts the documents in ascending id
order into shards of bounded size, and replaces frequent id pairs of each shard
by nonterminals, round after round, until no pair is frequent. A shard holds
the rules, the expanded length of every symbol, and the documents' offsets both
in symbols and in tokens, so any document, or any range of one, is decoded
without the rest. Rules never cross the end of a document. Vocabularies and
rules may be of any number; symbols take as many bits as they need.

Shards are values in Parquet rows, so they can lie in any store that Spark
reaches and are written once by Spark's committer when tasks are repeated.

Format of a shard, little endian: ``TSRP``, then u32 version, base (first
nonterminal), rules, documents, symbols, bits of a symbol (16 or more), then u64
tokens; rules as (u32, u32) pairs; u32 expanded length of each rule; i64 document
ids; u8 1 where the id is null; u32 symbol offsets (documents + 1); u64 token
offsets (documents + 1); the low 16 bits of the symbols; for each higher bit of
the symbols a plane of one bit a symbol.

Defined results: a null or empty text is the end id alone; documents with equal
or null ids keep one place each (nulls first); an empty table gives no shard;
columns besides id and text are not read, so their names cannot clash; a text of
any length is one document of one shard.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import small_batches
from tessera.llm.tokens import tokenize

MAGIC, VERSION = b"TSRP", 2
HEAD = struct.Struct("<4s6IQ")
#: Tokens after which a shard is closed.
SHARD_TOKENS = 1 << 20
#: Documents in one bucket of consecutive ids, and the most buckets: their
#: boundaries are on the driver. Beyond it buckets grow; they are sorted outside
#: memory and written shard by shard, so a task takes longer but no more memory.
BUCKET_DOCS, MAX_BUCKETS = 4096, 1 << 16
#: Occurrences in a shard that make a pair frequent.
FREQUENT = 12


def _dense(s: np.ndarray, barrier: int, frequent: int, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One round over a whole array: (places, rule of each, rules)."""
    a, b = s[:-1], s[1:]
    # a place of the table stands for the pair that was written to it last;
    # others there wait for a round that hashes differently
    h = ((a * np.uint32(0x9E3779B1 - 2 * turn) + b * np.uint32(0x85EBCA77 + 2 * turn)) >> np.uint32(12)).astype(np.int64)
    able = np.flatnonzero((np.bincount(h, minlength=1 << 20) >= frequent)[h] & (a != barrier) & (b != barrier))
    h, pair = h[able], a[able].astype(np.int64) << 32 | b[able]
    owner = np.full(1 << 20, -1, np.int64)
    owner[h] = pair
    same = owner[h] == pair
    at, h = able[same], h[same]
    count = np.bincount(h, minlength=1 << 20)
    # by count, then by place in the table; in runs of one pair every other one
    rank = (np.minimum(count, 0x3FFFF) << 11 | (np.arange(1 << 20) + turn) * 0x9E3779B1 >> 17 & 0x7FF).astype(np.int32)
    rank[count < frequent] = 0
    weight = np.zeros(len(s) + 2, np.int32)
    own = rank[h]
    weight[at + 1] = own * 2 + (at & (own > 0))
    own = weight[at + 1]
    won = np.flatnonzero((own > weight[at]) & (own >= weight[at + 2]))
    at, h = at[won], h[won]
    left = np.bincount(h, minlength=1 << 20)
    keep = left[h] * 2 >= frequent  # too few left by overlaps: later
    at, h = at[keep], h[keep]
    used = np.flatnonzero(np.bincount(h, minlength=1 << 20))
    number = np.zeros(1 << 20, np.int64)
    number[used] = np.arange(len(used))
    return at, number[h], np.stack([owner[used] >> 32, owner[used] & 0xFFFFFFFF], 1)


def _weight(count: np.ndarray, pair: np.ndarray, at: np.ndarray, turn: int) -> np.ndarray:
    """Which of two overlapping occurrences goes first: by count, then by a hash
    that differs from pair to pair and, in runs of one pair, from place to place."""
    return count << 21 | (pair + turn) * 0x1E3779B97F4A7C15 >> 43 & 0x1FFFF8 | (at + turn) * 0x9E3779B1 >> 20 & 7


def repair(ids: np.ndarray, base: int, barrier: int, frequent: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules): frequent pairs of adjacent symbols are replaced by new
    symbols, round after round, until no pair occurs ``frequent`` times.
    ``barrier`` takes part in no pair.

    A round counts pairs and replaces the occurrences of all frequent ones, an
    occurrence giving way to an overlapping one of a more frequent pair. While
    rounds replace much they go over the whole array; then symbols become a
    linked list, and a round takes only the places that are still open: a pair
    that is not frequent can only get rarer, so its places stay closed until a
    neighbour is replaced.
    """
    rules, total, turn = [np.zeros((0, 2), np.int64)], 0, 0
    dense = ids.astype(np.uint32)
    while len(dense) > 1 << 14:
        at, code, new = _dense(dense, barrier, frequent, turn)
        dense[at] = base + total + code
        rules.append(new)
        total, turn = total + len(new), turn + 1
        before, dense = len(dense), np.delete(dense, at + 1)
        if len(at) < before // 12:
            break
    n = len(dense)
    s = np.append(dense.astype(np.int64), barrier)
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    after[n] = before[0] = n
    alive, mark, weight = np.ones(n + 1, bool), np.zeros(n + 1, bool), np.zeros(n + 1, np.int64)
    at = np.flatnonzero((s[:-1] != barrier) & (s[1:] != barrier))
    while len(at) >= frequent:
        turn += 1
        pair = s[at] << 32 | s[after[at]]
        if len(at) > 1 << 16:  # most pairs are rare: a count by hash, never too low, tells
            h = (pair * (0x1E3779B97F4A7C15 + 2 * turn)).view(np.uint64) >> np.uint64(44)
            some = np.bincount(h.astype(np.int64), minlength=1 << 20)[h] >= frequent
            at, pair = at[some], pair[some]
        owner, code, count = np.unique(pair, return_inverse=True, return_counts=True)
        ok = count[code] >= frequent
        if not ok.any():
            break
        at, code = at[ok], code[ok]
        weight[at] = _weight(count[code], owner[code], at, turn)
        won = (weight[at] > weight[before[at]]) & (weight[at] >= weight[after[at]])
        weight[at] = 0
        here, code = at[won], code[won]
        left = np.bincount(code, minlength=len(owner))
        keep = left[code] >= min(left.max(), -(-frequent // 2))  # too few left by overlaps: later
        here, code = here[keep], code[keep]
        used, code = np.unique(code, return_inverse=True)
        gone = after[here]
        s[here] = base + total + code
        alive[gone] = False
        follow = after[gone]
        after[here] = follow
        before[follow] = here
        rules.append(np.stack([owner[used] >> 32, owner[used] & 0xFFFFFFFF], 1))
        total += len(used)
        # open: what was, and the pairs around every new symbol
        mark[at] = True
        mark[gone] = False
        mark[here] = mark[before[here]] = True
        mark[n] = False
        at = np.flatnonzero(mark)
        mark[at] = False
        at = at[(s[at] != barrier) & (s[after[at]] != barrier)]
    return s[:-1][alive[:-1]], np.concatenate(rules)


def expansions(rules: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, ids): the ids that each rule stands for, one after another."""
    flat: list[list[int]] = []
    for x, y in rules.tolist():
        flat.append((flat[x - base] if x >= base else [x]) + (flat[y - base] if y >= base else [y]))
    at = np.cumsum([0, *map(len, flat)])
    return at, np.fromiter(chain.from_iterable(flat), np.int64, int(at[-1]))


def _planes(symbols: np.ndarray, bits: int) -> bytes:
    """Symbols of ``bits`` bits: their low halves, then a plane for each bit above."""
    planes = [np.packbits((symbols >> b & 1).astype(np.uint8)) for b in range(16, bits)]
    return b"".join([symbols.astype("<u2").tobytes(), *(x.tobytes() for x in planes)])


def encode_shard(doc_ids: list[int | None], ids: list[bytes], base: int, barrier: int) -> bytes:
    tokens = np.frombuffer(b"".join(ids), "<u4").astype(np.int64)
    symbols, rules = repair(tokens, base, barrier)
    lengths = np.diff(expansions(rules, base)[0])
    each = np.ones(len(symbols), np.int64)
    each[symbols >= base] = lengths[symbols[symbols >= base] - base]
    token_at = np.cumsum([0, *(len(x) // 4 for x in ids)])
    symbol_at = np.searchsorted(np.concatenate([[0], np.cumsum(each)]), token_at)
    bits = max(16, (base + len(rules) - 1).bit_length())
    return b"".join(
        [
            HEAD.pack(MAGIC, VERSION, base, len(rules), len(ids), len(symbols), bits, len(tokens)),
            rules.astype("<u4").tobytes(),
            lengths.astype("<u4").tobytes(),
            np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
            bytes(x is None for x in doc_ids),
            symbol_at.astype("<u4").tobytes(),
            token_at.astype("<u8").tobytes(),
            _planes(symbols, bits),
        ]
    )


@dataclass
class Shard:
    """A parsed shard; ``document`` and ``tokens`` decode parts of it."""

    base: int
    rules: np.ndarray
    lengths: np.ndarray
    doc_ids: list[int | None]
    symbol_at: np.ndarray
    token_at: np.ndarray
    symbols: np.ndarray

    @classmethod
    def parse(cls, blob: bytes) -> Shard:
        magic, version, base, n_rules, n_docs, n_symbols, bits, _ = HEAD.unpack_from(blob)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token shard")
        at = HEAD.size

        def part(kind: str, n: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(blob, kind, n, at)
            at += x.nbytes
            return x

        rules = part("<u4", 2 * n_rules).reshape(-1, 2).astype(np.int64)
        lengths, doc_ids, null = part("<u4", n_rules), part("<i8", n_docs), part("u1", n_docs)
        symbol_at, token_at = part("<u4", n_docs + 1), part("<u8", n_docs + 1)
        symbols = part("<u2", n_symbols).astype(np.int64)
        for b in range(16, bits):
            symbols |= np.unpackbits(part("u1", -(-n_symbols // 8)), count=n_symbols).astype(np.int64) << b
        names = [None if z else int(x) for x, z in zip(doc_ids, null, strict=True)]
        shard = cls(base, rules, lengths, names, symbol_at, token_at.astype(np.int64), symbols)
        shard._at, shard._flat = expansions(rules, base)
        return shard

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        rule = symbols >= self.base
        n = np.ones(len(symbols), np.int64)
        n[rule] = self.lengths[symbols[rule] - self.base]
        out = np.repeat(symbols, n)
        inside = np.repeat(rule, n)
        first = np.cumsum(n) - n
        start = np.zeros(len(symbols), np.int64)
        start[rule] = self._at[symbols[rule] - self.base]
        where = np.arange(len(out)) - np.repeat(first, n) + np.repeat(start, n)
        out[inside] = self._flat[where[inside]]
        return out.astype("<u4")

    def document(self, i: int) -> np.ndarray:
        return self._expand(self.symbols[self.symbol_at[i] : self.symbol_at[i + 1]])

    def tokens(self, i: int, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of document ``i``; expands only the symbols
        that reach into this range."""
        own = self.symbols[self.symbol_at[i] : self.symbol_at[i + 1]]
        n = np.ones(len(own), np.int64)
        n[own >= self.base] = self.lengths[own[own >= self.base] - self.base]
        ends = np.cumsum(n)
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        skip = start - (ends[a - 1] if a else 0)
        return self._expand(own[a:b])[skip : skip + max(0, stop - start)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20)


def write_shards(df: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", vocabulary: int | None = None) -> None:
    """Tokenize whole texts and write shards in ascending id order to ``path``.

    Boundaries of buckets are quantiles of the ids alone, so texts are read and
    tokenized once, and only ids (two bytes each where the vocabulary allows)
    move between machines.
    """
    from tessera.llm.tokens import load

    spark = df.sparkSession
    small_batches(spark)
    base = max(vocabulary or 0, load(tokenizer).get_vocab_size(), end_id + 1)
    narrow = "<u2" if base <= 1 << 16 else "<u4"
    n = df.count()
    buckets = int(min(MAX_BUCKETS, max(1, -(-n // BUCKET_DOCS))))
    # as doubles, ids over 2**53 may round: a boundary moves a little, in every row alike
    key = F.coalesce(F.col(f"`{id_col}`").cast("double"), F.lit(-float(1 << 63)))
    probes = [i / buckets for i in range(1, buckets)]
    cuts = np.array([int(x) for x in df.select(key.alias("k")).approxQuantile("k", probes, 1 / (8 * buckets))] if probes else [], np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            k = pc.fill_null(b.column("doc_id"), -(1 << 63)).to_numpy(zero_copy_only=False)
            row += len(k)
            part = _mix(np.arange(row - len(k), row))
            lo, hi = np.searchsorted(cuts, k, "left"), np.searchsorted(cuts, k, "right")
            # several boundaries at one id: its rows are dealt among the buckets between
            bucket = lo + (part % np.maximum(hi - lo, 1).astype(np.uint64)).astype(np.int64)
            ids = [np.frombuffer(x, "<u4").astype(narrow).tobytes() for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), b.column("doc_id"), pa.array(ids, pa.binary())], ["bucket", "doc_id", "ids"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "shard", "bucket_start", "n_docs", "n_tokens", "payload"]
        bucket, shard, start, docs, held, n = None, 0, 0, [], [], 0

        def close() -> pa.RecordBatch:
            row = [bucket, shard, start, len(docs), n, encode_shard(docs, held, base, end_id)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names)

        for b in batches:
            for k, d, x in zip(b.column("bucket").to_pylist(), b.column("doc_id").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if docs and (k != bucket or n >= SHARD_TOKENS):
                    yield close()
                    shard, start, docs, held, n = shard + 1, start + n, [], [], 0
                if k != bucket:
                    bucket, shard, start = k, 0, 0
                x = np.frombuffer(x, narrow).astype("<u4").tobytes()
                docs.append(d)
                held.append(x)
                n += len(x) // 4
        if docs:
            yield close()

    ids = tokenize(df, tokenizer, end_id, id_col, text_col).mapInArrow(place, "bucket int, doc_id long, ids binary")
    ordered = ids.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "doc_id", "ids")
    ordered.mapInArrow(pack, "bucket int, shard int, bucket_start long, n_docs int, n_tokens long, payload binary").write.parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids): every document of the shards,
    decoded. ``start`` counts the ids of all documents before it."""
    shards = spark.read.parquet(path)
    # one row a bucket, MAX_BUCKETS at most
    sums = sorted((r["bucket"], r["n"]) for r in shards.groupBy("bucket").agg(F.sum("n_tokens").alias("n")).collect())
    first, total = {}, 0
    for bucket, n in sums:
        first[bucket], total = total, total + n

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bucket, start, payload in zip(b.column("bucket").to_pylist(), b.column("bucket_start").to_pylist(), b.column("payload").to_pylist(), strict=True):
                shard = Shard.parse(payload)
                at = shard.token_at
                ids = shard._expand(shard.symbols)
                docs = [ids[i:j].tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                for k in range(0, len(docs), 256):
                    part = docs[k : k + 256]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(shard.doc_ids[k : k + 256], pa.int64()),
                            pa.array(at[k : k + len(part)] + first[bucket] + start, pa.int64()),
                            pa.array([len(x) // 4 for x in part], pa.int64()),
                            pa.array([zlib.crc32(x) for x in part], pa.int64()),
                            pa.array(part, pa.binary()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                    )

    return shards.select("bucket", "bucket_start", "payload").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
