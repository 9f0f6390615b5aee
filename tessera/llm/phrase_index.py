"""Benchmark decontamination by a distributed positional inverted index.

The index is partitioned by document: a segment holds some consecutive
documents of one task, and for every term the sorted list of its positions in
the segment. Documents lie apart by a gap, so no phrase runs from one into the
next. Segments are rows of a written table; postings never cross machines, and
one hot term, passage or source only makes lists of its own segments longer.

A search sends a bounded part of the test items to all segments. In a segment,
each test window starts from the positions of its rarest term, shifted by the
term's offset, and keeps those that the lists of its other terms, shifted
likewise, contain, rarer terms first. What is left are exact phrase matches.
Proximity matches are the shortest spans that hold all words of an item, found
around the positions of its rarest word.

The index holds all terms, whatever will be asked. Tests are taken in blocks; a
task reads a segment once and goes through the blocks of one part (``SCAN_BYTES``
of test text), so a benchmark of ordinary size is one scan of the index.

Defined results: a null text has no words; a test without words never matches;
repeated documents are judged one by one, repeated items count once by id;
items without an id can match but are not named. Ids may be of any type. An
empty table of documents gives no rows, an empty table of tests leaves every
document clean; a text of any length lies in one segment; other columns are not
read here, and ``drop_contaminated`` passes them through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import count as counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, LongType

from tessera.llm._common import shared_dir, small_batches

#: Words of a window, words after which a segment is closed, positions between
#: two documents, and the test text of a block and of a scan.
WINDOW, SEGMENT_WORDS, GAP, BLOCK_BYTES, SCAN_BYTES = 10, 1 << 20, 64, 4 << 20, 32 << 20
#: Candidate positions examined at once.
CANDIDATES = 1 << 21

#: Words are runs of digits, a-z (capitals lowered) and all beyond ASCII.
_FOLD = bytes((i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32) for i in range(256))


def words(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "replace").translate(_FOLD).split()


class Tests:
    """A block of test items: their words as term numbers, one after another,
    and where windows begin. Term numbers and windows are made where needed."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        numbers: dict[bytes, int] = {}
        self.window, self.owners = window, [k for k, _ in items]
        found = [words(text) for _, text in items]
        self.n_words = np.array([len(w) for w in found], np.int64)
        self.ids = np.array([numbers.setdefault(w, len(numbers)) for own in found for w in own], np.int32)
        self.terms = list(numbers)
        self.first = np.cumsum(self.n_words) - self.n_words
        #: windows of an item; one, if it is shorter than a window but not empty
        self.n_windows = np.where(self.n_words > 0, np.maximum(1, self.n_words - window + 1), 0)
        self._numbers = None

    def numbers(self) -> dict[bytes, int]:
        if self._numbers is None:
            self._numbers = {t: i for i, t in enumerate(self.terms)}
        return self._numbers

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(term numbers by window, -1 beyond a short item; sizes; items)."""
        item = np.repeat(np.arange(len(self.owners)), self.n_windows)
        start = np.arange(len(item)) - np.repeat(np.cumsum(self.n_windows) - self.n_windows, self.n_windows) + self.first[item]
        size = np.minimum(self.window, self.n_words[item])
        place = np.arange(self.window)
        at = np.minimum(start[:, None] + place, max(len(self.ids) - 1, 0))
        return np.where(place < size[:, None], self.ids[at] if len(self.ids) else -1, -1).astype(np.int64), size, item

    def sets(self) -> list[tuple[int, list[int]]]:
        """(item, its different terms)."""
        return [(i, np.unique(self.ids[a : a + n]).tolist()) for i, (a, n) in enumerate(zip(self.first.tolist(), self.n_words.tolist(), strict=True)) if n]


def blocks(tests: DataFrame, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[object, str | None]]]:
    """Items in blocks of bounded text, read one partition at a time."""
    held, n = [], 0
    for r in tests.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).toLocalIterator():
        size = len((r[1] or "").encode("utf-8", "replace"))
        if held and n + size > block_bytes:
            yield held
            held, n = [], 0
        held.append((r[0], r[1]))
        n += size
    if held:
        yield held


def build(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", segment_words: int = SEGMENT_WORDS) -> None:
    """Write the index of whole texts to ``path``: every position of every term."""
    small_batches(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[bytes, int] = {}  # term -> number of the word that it was first
        kind, docs, sizes, lists, n = None, [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal own
            seen = np.concatenate(lists) if lists else np.zeros(0, np.int32)
            rank = np.zeros(max(n, 1), np.int32)
            rank[np.fromiter(own.values(), np.int64, len(own))] = np.arange(len(own))
            ids = rank[seen]
            order = np.argsort(ids.astype(np.uint16) if len(own) <= 1 << 16 else ids, kind="stable")
            gaps = np.repeat(np.arange(len(sizes)) * GAP, sizes)
            deltas = np.diff((order + gaps[order]).astype(np.int32), prepend=0).astype("<i4")
            counts = np.bincount(ids, minlength=len(own))
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([docs], pa.list_(kind)),
                    pa.array([sizes], pa.list_(pa.int32())),
                    pa.array([list(own)], pa.list_(pa.binary())),
                    pa.array([counts.tolist()], pa.list_(pa.int32())),
                    pa.array([deltas.tobytes()], pa.binary()),
                ],
                ["doc_ids", "sizes", "terms", "counts", "postings"],
            )
            own = {}
            return out

        for b in batches:
            kind = b.column("doc_id").type
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                w = words(text)
                lists.append(np.fromiter(map(own.setdefault, w, counter(n)), np.int32, len(w)))
                docs.append(doc)
                sizes.append(len(w))
                n += len(w)
                if n + GAP * len(docs) >= segment_words:
                    yield close()
                    docs, sizes, lists, n = [], [], [], 0
        if docs:
            yield close()

    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    index = rows.mapInArrow(run, f"doc_ids array<{id_type}>, sizes array<int>, terms array<binary>, counts array<int>, postings binary")
    index.withColumn("segment", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)


class Lists:
    """The lists of one segment, as stored."""

    def __init__(self, sizes: list[int], terms: list[bytes], counts: list[int], postings: bytes):
        self.sizes, self.terms = np.array(sizes, np.int64), terms
        self.starts = np.cumsum(self.sizes + GAP) - self.sizes - GAP
        self.at, self.count = np.cumsum(np.frombuffer(postings, "<i4").astype(np.int64)), np.array(counts, np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.span = int(self.starts[-1] + self.sizes[-1] + 2 * GAP) if len(sizes) else 1


class Segment:
    """Lists of a segment, numbered as a block of tests numbers its terms."""

    def __init__(self, lists: Lists, numbers: dict[bytes, int]):
        self.starts, self.span = lists.starts, lists.span
        number = np.array([numbers.get(t, -1) for t in lists.terms], np.int64)
        use = np.argsort(number, kind="stable")
        use = use[number[use] >= 0]
        count = lists.count[use]
        self.count = np.zeros(len(numbers), np.int64)
        self.count[number[use]] = count
        self.first = np.cumsum(self.count) - self.count
        where = np.repeat(lists.first[use] - np.cumsum(count) + count, count) + np.arange(count.sum())
        self.at = lists.at[where]
        #: (term, position) in one number; ascending, so membership is a search
        self.keys = np.repeat(number[use], count) * self.span + self.at

    def has(self, term: np.ndarray, at: np.ndarray) -> np.ndarray:
        key = term * self.span + at
        i = np.searchsorted(self.keys, key)
        return (at >= 0) & (self.keys[np.minimum(i, len(self.keys) - 1)] == key)

    def phrases(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window number, start) of every occurrence of every window."""
        width = windows.shape[1]
        count = np.where(windows >= 0, self.count[windows], np.iinfo(np.int64).max)
        alive = np.flatnonzero((count > 0).all(1))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        order = np.argsort(count[alive], axis=1, kind="stable")
        rarest = count[alive, order[:, 0]] if len(alive) else np.zeros(0, np.int64)
        load = np.cumsum(rarest) // CANDIDATES
        for part in np.split(np.arange(len(alive)), np.flatnonzero(np.diff(load)) + 1) if len(alive) else []:
            w, o, n = alive[part], order[part], rarest[part]
            each = np.repeat(np.arange(len(part)), n)
            offset = o[:, 0]
            term = windows[w, offset]
            start = self.at[np.repeat(self.first[term] - np.cumsum(n) + n, n) + np.arange(n.sum())] - offset[each]
            for k in range(1, width):
                offset = o[each, k]
                term = windows[w[each], offset]
                ok = (term < 0) | self.has(np.maximum(term, 0), start + offset)
                each, start = each[ok], start[ok]
                if not len(each):
                    break
            found.append((w[each], start))
        return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])

    def near(self, terms: list[int], within: int) -> list[tuple[int, int]]:
        """Shortest spans of at most ``within`` words of one document that hold all
        terms: (first position, last position), from around the rarest term's
        positions."""
        if not terms or len(terms) > within or (self.count[terms] == 0).any():
            return []
        own = {t: self.at[self.first[t] : self.first[t] + self.count[t]] for t in terms}
        anchors = own[min(terms, key=lambda t: self.count[t])]
        events = []
        for t, at in own.items():
            i = np.searchsorted(anchors, at)
            gap = np.minimum(np.abs(anchors[np.minimum(i, len(anchors) - 1)] - at), np.abs(anchors[np.maximum(i - 1, 0)] - at))
            events += [(p, t) for p in at[gap < within].tolist()]
        last: dict[int, int] = {}
        out: list[tuple[int, int]] = []
        for p, t in sorted(events):
            last[t] = p
            if len(last) == len(terms) and p - (a := min(last.values())) < within and (not out or out[-1][0] != a):
                out.append((a, p))
        if not out:
            return []
        doc = np.searchsorted(self.starts, np.array(out), "right")
        return [x for x, (i, j) in zip(out, doc.tolist(), strict=True) if i == j]


def _cover(start: np.ndarray, stop: np.ndarray) -> int:
    """Words inside any of the intervals."""
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    before = np.concatenate([[-1], stop[:-1]])
    return int(np.maximum(0, stop - np.maximum(start, before)).sum())


SPANS = "array<struct<item_id:{item},start:int,stop:int>>"


def _merged(rows: list[tuple[object, int, int]]) -> list[dict]:
    """Spans of each item, those that overlap or touch as one."""
    own: dict[object, list[list[int]]] = {}
    for k, x, y in sorted(rows, key=lambda v: v[1]):
        held = own.setdefault(k, [])
        if held and x <= held[-1][1]:
            held[-1][1] = max(held[-1][1], y)
        else:
            held.append([x, y])
    return [{"item_id": k, "start": x, "stop": y} for k, v in own.items() for x, y in v]


def search(spark: SparkSession, path: str, parts: list[Tests], item_type: DataType = LongType(), within: int | None = None) -> DataFrame:
    """Matches of some blocks of tests, in one scan of the index: a row for every
    document, with the words hit and, per item, the merged spans of its phrase
    matches. With ``within``, ``near`` lists the shortest spans of at most so
    many words that hold all words of an item in any order."""
    index = spark.read.parquet(path)
    id_type = index.schema["doc_ids"].dataType.elementType.simpleString()
    spans = SPANS.format(item=item_type.simpleString())
    kind = pa.list_(pa.struct([("item_id", to_arrow_type(item_type)), ("start", pa.int32()), ("stop", pa.int32())]))
    schema = f"segment long, row int, doc_id {id_type}, n_words long, n_hit long, spans {spans}" + (f", near {spans}" if within else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                get = lambda c: b.column(c)[i].as_py()  # noqa: B023, E731
                lists = Lists(get("sizes"), get("terms"), get("counts"), get("postings"))
                n = len(lists.sizes)
                hits: list[list[tuple]] = [[] for _ in range(n)]
                close: list[list[dict]] = [[] for _ in range(n)]
                for tests in parts:
                    seg = Segment(lists, tests.numbers())
                    windows, size, item = tests.windows()
                    if len(windows):
                        which, start = seg.phrases(windows)
                        doc = np.searchsorted(lists.starts, start, "right") - 1
                        begin = start - lists.starts[doc]
                        for d, k, x, y in zip(doc.tolist(), item[which].tolist(), begin.tolist(), (begin + size[which]).tolist(), strict=True):
                            hits[d].append((tests.owners[k], x, y))
                    for k, terms in tests.sets() if within else ():
                        for a, z in seg.near(terms, within):
                            d = int(np.searchsorted(lists.starts, a, "right")) - 1
                            close[d].append({"item_id": tests.owners[k], "start": int(a - lists.starts[d]), "stop": int(z - lists.starts[d]) + 1})
                covered = [_cover(np.array([x for _, x, _ in h]), np.array([y for *_, y in h])) if h else 0 for h in hits]
                columns = [pa.array([get("segment")] * n, pa.int64()), pa.array(range(n), pa.int32()), b.column("doc_ids")[i].values, pa.array(lists.sizes), pa.array(covered, pa.int64())]
                columns.append(pa.array([_merged(h) for h in hits], kind))
                if within:
                    columns.append(pa.array(close, kind))
                yield pa.RecordBatch.from_arrays(columns, ["segment", "row", "doc_id", "n_words", "n_hit", "spans", *(["near"] if within else [])])

    return index.select("segment", "doc_ids", "sizes", "terms", "counts", "postings").mapInArrow(run, schema)


def contamination(df: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", within: int | None = None, block_bytes: int = BLOCK_BYTES, scan_bytes: int = SCAN_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, spans) of every document against all tests, and
    ``near`` if ``within`` is given."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    build(df, path, id_col, text_col)
    item_type = tests.schema[item_col].dataType
    scans, held = [], []
    for block in blocks(tests, item_col, "text", block_bytes):
        held.append(Tests(block))
        if len(held) * block_bytes >= scan_bytes:
            scans.append(search(spark, path, held, item_type, within))
            held = []
    if held or not scans:
        scans.append(search(spark, path, held, item_type, within))
    if len(scans) == 1:
        return scans[0].drop("segment", "row")
    every = reduce(DataFrame.unionAll, scans)
    lists = ["spans", "near"] if within else ["spans"]
    merged = every.groupBy("segment", "row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *(F.flatten(F.collect_list(c)).alias(c) for c in lists))
    ordered = merged.withColumn("spans", F.array_sort("spans", lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0)))
    step = lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(s["start"], acc["end"]))).alias("n"), F.greatest(acc["end"], s["stop"]).alias("end"))
    hit = F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step)["n"].cast("long")
    return ordered.select("doc_id", "n_words", hit.alias("n_hit"), *lists)


def drop_contaminated(df: DataFrame, tests: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` without a word in any test window. Whether a row goes
    depends on its text alone, so rows are matched by the text's digest."""
    packed = df.select(F.struct("*").alias("row"), F.col(f"`{text_col}`").alias("text"))
    key = F.sha2("text", 256)
    found = contamination(packed.select(key.alias("doc_id"), "text"), tests)
    gone = found.where("n_hit > 0").select(F.col("doc_id").alias("gone")).distinct()
    return packed.join(gone, key == F.col("gone"), "left_anti").select("row.*")
