"""Frame: a DataFrame with an explicit row order and optional partition key."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence
from functools import reduce
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.functions.expressions import NAN, ieee_div
from tessera.operators.arrays import Coo
from tessera.operators.profiles import PROFILES, Scope, add
from tessera.operators.series import Series
from tessera.plans.options import AsofOptions, JoinOptions, SortOptions
from tessera.sources.io import write_csv

_ARITHMETIC = {"add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": ieee_div}
_COMPARE = {"eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b}
_FLOAT = (T.FloatType, T.DoubleType)
_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _constant(value: object, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType) and value is not None:
        return F.struct(*(_constant(v, f.dataType).alias(f.name) for v, f in zip(value, kind, strict=True)))
    return F.lit(value).cast(kind)


def _starts(counts: dict[int, int]) -> Column:
    """The sum of the counts of all blocks before a row's."""
    before = accumulate((counts.get(i, 0) for i in range(max(counts, default=0))), initial=0)
    return F.lit(list(before)).cast("array<long>")[F.col("__block")]


class Frame:
    """Immutable and lazy: every method gives a new frame over a longer plan.

    ``order`` names columns that order the rows totally (within a partition);
    everything that depends on row order uses them. Method names may also be
    written in camel case.
    """

    def __init__(self, df: DataFrame, order: Sequence[str], partition: Sequence[str] = ()):
        for c in (*order, *partition):
            if c not in df.columns:
                raise KeyError(c)
        self.df, self.order, self.partition = df, list(order), list(partition)

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        snake = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()
        if snake in PROFILES:
            return lambda *a, **k: self._new(PROFILES[snake](self.df, Scope(self.order, self.partition), *a, **k))
        if snake != name and snake in type(self).__dict__:
            return getattr(self, snake)
        raise AttributeError(name)

    def _new(self, df: DataFrame) -> Frame:
        return Frame(df, [c for c in self.order if c in df.columns], [c for c in self.partition if c in df.columns])

    def _same_type(self, a: str, b: str) -> None:
        if self.df.schema[a].dataType != self.df.schema[b].dataType:
            raise TypeError(f"{a} and {b} have different types")

    # --- metadata and actions ---

    @property
    def width(self) -> int:
        return len(self.df.columns)

    def height(self) -> int:
        return self.df.count()

    def shape(self) -> tuple[int, int]:
        return self.height(), self.width

    def column_index(self, name: str) -> int:
        return self.df.columns.index(name)

    def column_dtype(self, name: str) -> T.DataType:
        return self.df.schema[name].dataType

    def nullable(self, name: str) -> bool:
        return self.df.schema[name].nullable

    def null_count(self, name: str) -> int:
        return self.df.where(F.col(name).isNull()).count()

    def has_nulls(self, name: str) -> bool:
        return not self.df.where(F.col(name).isNull()).isEmpty()

    def explain(self) -> None:
        self.df.explain("formatted")

    def collect(self) -> list:
        return self.df.orderBy(*self.order).collect()

    def clone(self) -> Frame:
        return self

    view = cpu = clone

    def cuda(self) -> Frame:
        raise NotImplementedError("Spark plans run on executors; there is no device to move to")

    mps = cuda

    def print(self, rows: int = 20) -> None:
        self.head(rows).df.orderBy(*self.order).show(rows, truncate=False)

    def column(self, name: str) -> Series:
        return Series(self.df, name, self.order[0])

    def to_matrix(self, names: Sequence[str] | None = None) -> Coo:
        """Numeric columns as a matrix (rows in the frame's order); null is NaN."""
        names = list(names or [f.name for f in self.df.schema if isinstance(f.dataType, _NUMERIC) and f.name not in self.order])
        for n in names:
            if not isinstance(self.column_dtype(n), _NUMERIC):
                raise TypeError(f"{n} is not numeric")
        numbered = self._numbered("i0")
        cells = F.posexplode(F.array(*(F.coalesce(F.col(n).cast("double"), F.lit(math.nan)) for n in names))).alias("i1", "v")
        return Coo(numbered.select("i0", cells).withColumn("i1", F.col("i1").cast("long")), (self.height(), len(names)), True)

    def write_parquet(self, path: str, mode: str = "error") -> None:
        self.df.write.mode(mode).parquet(path)

    def write_csv(self, path: str) -> None:
        write_csv(self.df, path)

    def to_arrow_table(self) -> pa.Table:
        return self.df.toArrow()

    # --- projections and filters ---

    def select(self, names: Sequence[str]) -> Frame:
        """The named columns; the order columns stay with the frame."""
        for n in names:
            if n not in self.df.columns:
                raise KeyError(n)
        return self._new(self.df.select(*dict.fromkeys([*names, *self.order, *self.partition])))

    def with_column(self, name: str, column: Column) -> Frame:
        if name in self.df.columns:
            raise ValueError(f"column exists already: {name}")
        return self._new(self.df.withColumn(name, column))

    def _binary(self, a: Column, b: Column, op: str, kind: T.DataType) -> Column:
        if not isinstance(kind, _NUMERIC) or op == "div" and not isinstance(kind, _FLOAT):
            raise TypeError(f"{op} is not defined for {kind.simpleString()}")
        return _ARITHMETIC[op](a, b).cast(kind)

    def binary_columns(self, lhs: str, rhs: str, op: str, out: str) -> Frame:
        self._same_type(lhs, rhs)
        return self.with_column(out, self._binary(F.col(lhs), F.col(rhs), op, self.column_dtype(lhs)))

    def binary_column_scalar(self, col: str, scalar: object, op: str, out: str) -> Frame:
        kind = self.column_dtype(col)
        return self.with_column(out, self._binary(F.col(col), F.lit(scalar).cast(kind), op, kind))

    def _compare(self, a: Column, b: Column, op: str, kind: T.DataType) -> Column:
        if isinstance(kind, T.BooleanType) and op not in ("eq", "ne"):
            raise TypeError("booleans have no order here")
        found = _COMPARE[op](a, b)
        if isinstance(kind, _FLOAT):  # IEEE: nothing equals or exceeds NaN
            odd = F.isnan(a) | F.isnan(b)
            found = F.when(a.isNotNull() & b.isNotNull(), F.when(odd, F.lit(op == "ne")).otherwise(found))
        return found

    def compare_columns(self, lhs: str, rhs: str, op: str, out: str) -> Frame:
        self._same_type(lhs, rhs)
        return self.with_column(out, self._compare(F.col(lhs), F.col(rhs), op, self.column_dtype(lhs)))

    def compare_column_scalar(self, col: str, scalar: object, op: str, out: str) -> Frame:
        kind = self.column_dtype(col)
        return self.with_column(out, self._compare(F.col(col), F.lit(scalar).cast(kind), op, kind))

    def filter_column_mask(self, mask: str) -> Frame:
        return self._new(self.df.where(F.col(mask)))

    def filter(self, mask: Sequence[bool]) -> Frame:
        """Rows by a mask on the driver, one value a row in the frame's order;
        the positions that are true are joined, the mask itself stays here."""
        spark = self.df.sparkSession
        at = spark.createDataFrame([(i,) for i, m in enumerate(mask) if m], "__pos long")
        if self.height() != len(mask):
            raise ValueError("mask and frame differ in length")
        return self._new(self._numbered("__pos").join(at, "__pos").drop("__pos"))

    def _placed(self, df: DataFrame, keys: Sequence[tuple[str, SortOptions]]) -> DataFrame:
        """``df`` with ``__block``, the range of a row in the order of ``keys``:
        the number of cuts before it. Cuts are rows of a sample and constants of
        the plan, so a row lies in one range however often the plan runs; Spark's
        own ranges are sampled anew in every run."""
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        fields = [F.col(c).alias(f"k{i}") for i, (c, _) in enumerate(keys)]
        kinds = [f.dataType for f in df.select(*fields).schema]
        sample = df.select(*fields).orderBy(F.rand(0)).limit(100 * n)
        found = sample.orderBy(*(self._sort(f"k{i}", o) for i, (_, o) in enumerate(keys))).collect() if n > 1 else []
        cuts = list(dict.fromkeys(len(found) * i // n for i in range(1, n))) if found else []
        if not cuts:
            return df.withColumn("__block", F.lit(0))
        cuts = [F.struct(*(_constant(v, kind).alias(f"k{i}") for i, (v, kind) in enumerate(zip(found[at], kinds, strict=True)))) for at in cuts]

        def passed(cuts: Column) -> Column:
            def before(cut: Column) -> Column:
                found = F.lit(False)
                for i, (c, o) in reversed(list(enumerate(keys))):
                    a, b = cut[f"k{i}"], F.col(c)
                    nulls = a.isNull() & b.isNotNull() if o.nulls == "first" else a.isNotNull() & b.isNull()
                    less = F.when(a.isNull() | b.isNull(), nulls).otherwise(a > b if o.descending else a < b)
                    found = less | a.eqNullSafe(b) & found
                return found

            return F.size(F.filter(cuts, before))

        # cuts by the root of their number: first the group, then those within it
        width = math.isqrt(len(cuts) - 1) + 1
        groups = [cuts[i : i + width] for i in range(0, len(cuts), width)]
        if len(groups) == 1:
            return df.withColumn("__block", passed(F.array(*cuts)))
        df = df.withColumn("__group", passed(F.array(*(g[-1] for g in groups[:-1]))))
        within = passed(F.array(*(F.array(*g) for g in groups))[F.col("__group")])
        return df.withColumn("__block", F.col("__group") * width + within).drop("__group")

    def _numbered(self, name: str, by: Sequence[tuple[str, SortOptions]] = ()) -> DataFrame:
        """Row positions from 0 in the frame's order, or by ``by`` and then that
        order. Rows are numbered within ranges; a range starts at the number of
        rows in those before it, so no task holds all rows. A sample and one count
        a range come to the driver."""
        keys = [*by, *((c, SortOptions(nulls="first")) for c in self.order)]
        placed = self._placed(self.df, keys)
        counts = {r["__block"]: r["count"] for r in placed.groupBy("__block").count().collect()}
        w = Window.partitionBy("__block").orderBy(*(self._sort(c, o) for c, o in keys))
        return placed.withColumn(name, _starts(counts) + F.row_number().over(w) - 1).drop("__block")

    def filter_column_scalar(self, col: str, scalar: object, op: str) -> Frame:
        """A plain comparison where no NaN can tell the difference, so that it
        reaches the scan."""
        kind = self.column_dtype(col)
        if isinstance(scalar, float) and math.isnan(scalar):  # IEEE: all values differ from NaN
            return self._new(self.df.where(F.col(col).isNotNull() & (op == "ne")))
        plain = _COMPARE[op](F.col(col), F.lit(scalar).cast(kind))
        if isinstance(kind, _FLOAT) and op in ("gt", "ge"):
            plain = plain & ~F.isnan(col)
        return self._new(self.df.where(plain))

    def take(self, indices: DataFrame, index: str = "index", optional: bool = False) -> DataFrame:
        """Rows by position: ``indices`` has positions (from 0) and its own
        ``at`` column as the order of the result."""
        numbered = self._numbered("__pos")
        return indices.join(numbered, indices[index] == numbered["__pos"], "left" if optional else "inner").drop("__pos")

    def head(self, n: int) -> Frame:
        return self._new(self.df.orderBy(*self.order).limit(n))

    def tail(self, n: int) -> Frame:
        return self._new(self.df.orderBy(*(F.col(c).desc() for c in self.order)).limit(n))

    def slice_rows(self, start: int, stop: int) -> Frame:
        return self._new(self.df.orderBy(*self.order).offset(start).limit(max(0, stop - start)))

    # --- joins ---

    def _join_keys(self, right: Frame, lks: Sequence[str], rks: Sequence[str]) -> None:
        if not lks or len(lks) != len(rks):
            raise ValueError("as many keys on either side, one at least")
        for a, b in zip(lks, rks, strict=True):
            if self.column_dtype(a) != right.column_dtype(b):
                raise TypeError(f"{a} and {b} have different types")

    def _join(self, right: Frame, lks: Sequence[str], rks: Sequence[str], how: str, suffix: str) -> DataFrame:
        """Right columns whose names are taken get the suffix, as often as needed."""
        if not suffix and how in ("inner", "left", "full") and set(self.df.columns) & (set(right.df.columns) - set([rks] if isinstance(rks, str) else rks)):
            raise ValueError("columns clash and there is no suffix")
        lks, rks = ([lks], [rks]) if isinstance(lks, str) else (list(lks), list(rks))
        self._join_keys(right, lks, rks)
        r = right.df.select(*(F.col(c).alias(f"__r_{c}") for c in right.df.columns))
        on = [self.df[a] == r[f"__r_{b}"] for a, b in zip(lks, rks, strict=True)]
        joined = self.df.join(r, on, how)
        if how in ("left_semi", "left_anti"):
            return joined
        names, taken = {}, set(self.df.columns)
        for c in right.df.columns:
            if c not in rks:
                names[c] = c
                while names[c] in taken:
                    names[c] += suffix
                taken.add(names[c])
        left = [F.coalesce(self.df[c], r[f"__r_{rks[lks.index(c)]}"]).alias(c) if how == "full" and c in lks else self.df[c] for c in self.df.columns]
        rest = [r[f"__r_{c}"].alias(n) for c, n in names.items()]
        return joined.select(*left, *rest)

    def inner_join(self, right: Frame, lk, rk, o: JoinOptions = JoinOptions()) -> Frame:
        return self._new(self._join(right, lk, rk, "inner", o.right_suffix))

    def left_join(self, right: Frame, lk, rk, o: JoinOptions = JoinOptions()) -> Frame:
        return self._new(self._join(right, lk, rk, "left", o.right_suffix))

    def full_join(self, right: Frame, lk, rk, o: JoinOptions = JoinOptions()) -> Frame:
        return self._new(self._join(right, lk, rk, "full", o.right_suffix))

    def semi_join(self, right: Frame, lk, rk) -> Frame:
        return self._new(self._join(right, lk, rk, "left_semi", ""))

    def anti_join(self, right: Frame, lk, rk) -> Frame:
        return self._new(self._join(right, lk, rk, "left_anti", ""))

    inner_join_on, left_join_on, full_join_on, semi_join_on, anti_join_on = inner_join, left_join, full_join, semi_join, anti_join

    def asof_join(self, right: Frame, lk: str, rk: str, o: AsofOptions = AsofOptions(), by: Sequence[str] = ()) -> Frame:
        """Every left row with the nearest right row by key. Both sides are put
        into one ordered sequence and payloads are carried along it, so the join
        is one sort. ``by`` (an extension) splits the sequence; without it, and
        without a partition key, it is one task's."""
        self._join_keys(right, [lk], [rk])
        if isinstance(self.column_dtype(lk), T.BooleanType):
            raise TypeError("boolean keys have no distance")
        by = list(by) or self.partition
        taken = set(self.df.columns)
        payload = [c for c in right.df.columns if c != rk and c not in by]
        names = {c: c + o.right_suffix if c in taken else c for c in payload}
        rorder = F.struct(*(F.col(c) for c in right.order))
        l = self.df.select(*(F.col(c).alias(c) for c in by), F.col(lk).alias("__k"), F.lit(0).alias("__side"), F.struct(*self.df.columns).alias("__l"), F.lit(None).cast(T.StructType([T.StructField("k", self.column_dtype(lk)), T.StructField("o", right.df.select(rorder.alias("o")).schema["o"].dataType), T.StructField("p", T.StructType([right.df.schema[c] for c in payload]))])).alias("__r"))
        r = right.df.where(F.col(rk).isNotNull()).select(*(F.col(c).alias(c) for c in by), F.col(rk).alias("__k"), F.lit(1).alias("__side"), F.lit(None).cast(l.schema["__l"].dataType).alias("__l"), F.struct(F.col(rk).alias("k"), rorder.alias("o"), F.struct(*payload).alias("p")).alias("__r"))
        both = l.unionByName(r)
        w = Window.partitionBy(*by)
        back = w.orderBy("__k", F.col("__side").desc(), F.col("__r.o").desc()).rowsBetween(Window.unboundedPreceding, 0)
        # of right rows with equal keys the first counts, so it stands last
        ahead = w.orderBy(F.col("__k").desc(), F.col("__side").desc(), F.col("__r.o").desc()).rowsBetween(Window.unboundedPreceding, 0)
        before, after = F.last("__r", ignorenulls=True).over(back), F.last("__r", ignorenulls=True).over(ahead)
        if o.strategy == "previous":
            both = both.withColumn("__m", before)
        elif o.strategy == "next":
            both = both.withColumn("__m", after)
        else:
            both = both.withColumns({"__b": before, "__a": after})
            db, da = F.col("__k") - F.col("__b.k"), F.col("__a.k") - F.col("__k")
            nearer = F.col("__b").isNull() | (da < db) | (da == db) & (F.col("__a.o") < F.col("__b.o"))
            both = both.withColumn("__m", F.when(F.col("__a").isNull(), F.col("__b")).when(nearer, F.col("__a")).otherwise(F.col("__b")))
        out = both.where("__side = 0").withColumn("__m", F.when(F.col("__k").isNotNull(), F.col("__m")))
        return self._new(out.select("__l.*", *(F.col(f"__m.p.{c}").alias(n) for c, n in names.items())))

    # --- frames without a partition key, over the cluster ---

    def rolling_blocked(self, apply: Callable[[Frame], Frame], behind: int, ahead: int = 0, blocks: int | None = None) -> Frame:
        """``apply``, in blocks: for operators whose windows reach at most
        ``behind`` rows back and ``ahead`` rows on (rolling and lag-like profiles,
        not streaks or expanding ones) over a frame without a partition key,
        ordered first by a number or time.

        Blocks are ranges of the first order column, bounded by its quantiles;
        each also holds the last and first rows of its neighbours, as far as
        windows reach, and these are dropped again after ``apply``.
        """
        if self.partition:
            return apply(self)
        first = F.col(self.order[0])
        key = first.cast("double") if isinstance(self.column_dtype(self.order[0]), _NUMERIC) else F.unix_micros(first.cast("timestamp")).cast("double")
        n = blocks or int(self.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        cuts = sorted(set(self.df.select(key.alias("k")).approxQuantile("k", [i / n for i in range(1, n)], 1 / (4 * n)))) if n > 1 else []

        def placed(cuts: list[float]) -> DataFrame:
            slot = F.size(F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: c < key)) if cuts else F.lit(0)
            return self.df.withColumn("__block", F.when(key.isNull(), F.lit(0)).otherwise(slot).cast("int"))

        # blocks that windows would reach across are joined to the next; one number a block
        count = {r["__block"]: r["count"] for r in placed(cuts).groupBy("__block").count().collect()}
        kept, held = [], 0
        for i, c in enumerate(cuts):
            held += count.get(i, 0)
            if held >= max(behind, ahead, 1):
                kept, held = [*kept, c], 0
        if kept and held + count.get(len(cuts), 0) < max(behind, ahead, 1):
            kept.pop()
        df = placed(kept)
        parts = [df.withColumn("__own", F.lit(True))]
        for reach, step, way in ((behind, 1, "desc"), (ahead, -1, "asc")):
            if reach:
                w = Window.partitionBy("__block").orderBy(*(getattr(F.col(c), way)() for c in self.order))
                edge = df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= reach).drop("__rn")
                parts.append(edge.withColumns({"__block": F.col("__block") + step, "__own": F.lit(False)}))
        out = apply(Frame(reduce(DataFrame.unionByName, parts), self.order, ["__block"])).df
        return self._new(out.where("__own").drop("__own", "__block"))

    # --- aggregation ---

    def _groups(self, keys, value: str | None) -> DataFrame:
        keys = [keys] if isinstance(keys, str) else list(keys)
        df = self.df.dropna(subset=[*keys, *([value] if value else [])])
        if value and not isinstance(self.column_dtype(value), _NUMERIC):
            raise TypeError(f"{value} is not numeric")
        return df.groupBy(*keys)

    def group_by_count(self, key, out: str = "count") -> DataFrame:
        return self._groups(key, None).agg(F.count("*").alias(out))

    def _one(self, f, key, value: str, out: str) -> DataFrame:
        return self._groups(key, value).agg(f(F.col(value)).cast(self.column_dtype(value)).alias(out))

    def group_by_sum(self, key, value: str, out: str) -> DataFrame:
        return self._one(F.sum, key, value, out)

    def group_by_min(self, key, value: str, out: str) -> DataFrame:
        return self._one(F.min, key, value, out)

    def group_by_max(self, key, value: str, out: str) -> DataFrame:
        return self._one(F.max, key, value, out)

    def group_by_mean(self, key, value: str, out: str) -> DataFrame:
        return self._groups(key, value).agg(F.avg(F.col(value).cast("double")).alias(out))

    def group_by_stats(self, keys, value: str, prefix: str) -> DataFrame:
        v, kind = F.col(value), self.column_dtype(value)
        return self._groups(keys, value).agg(F.count(v).alias(f"{prefix}_count"), F.sum(v).cast(kind).alias(f"{prefix}_sum"), F.min(v).alias(f"{prefix}_min"), F.max(v).alias(f"{prefix}_max"), F.avg(v.cast("double")).alias(f"{prefix}_mean"))

    def group_by_profile(self, keys, value: str, prefix: str) -> DataFrame:
        v = F.col(value).cast("double")
        flat, n = F.min(v) == F.max(v), F.count(v)
        shape = lambda f: F.when((n < 2) | flat, F.lit(NAN)).otherwise(f(v))
        return self._groups(keys, value).agg(n.alias(f"{prefix}_count"), F.sum(v).alias(f"{prefix}_sum"), F.avg(v).alias(f"{prefix}_mean"), F.var_pop(v).alias(f"{prefix}_variance"), F.stddev_pop(v).alias(f"{prefix}_stddev"), shape(F.skewness).alias(f"{prefix}_skewness"), shape(F.kurtosis).alias(f"{prefix}_kurtosis"))

    group_by_stats_on, group_by_profile_on = group_by_stats, group_by_profile

    def describe(self) -> DataFrame:
        """Rows count, mean, min, max of the numeric columns, as doubles."""
        names = [f.name for f in self.df.schema if isinstance(f.dataType, _NUMERIC)]
        one = self.df.agg(*(f(F.col(c).cast("double")).cast("double").alias(f"{c}|{k}") for c in names for k, f in (("count", F.count), ("mean", F.avg), ("min", F.min), ("max", F.max))))
        rows = [F.struct(F.lit(k).alias("stat"), *(F.col(f"`{c}|{k}`").alias(c) for c in names)) for k in ("count", "mean", "min", "max")]
        return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")

    # --- sort, rank, sets ---

    def _sort(self, col: str, o: SortOptions) -> Column:
        c = F.col(col)
        return getattr(c, f"{'desc' if o.descending else 'asc'}_nulls_{o.nulls}")()

    def sort_by(self, col: str, o: SortOptions = SortOptions()) -> DataFrame:
        return self.df.orderBy(self._sort(col, o), *self.order)

    sort_by_column = sort_by

    def top_k_by(self, col: str, k: int, o: SortOptions = SortOptions()) -> DataFrame:
        return self.sort_by(col, o).limit(k)

    def argsort_by(self, col: str, o: SortOptions = SortOptions()) -> Frame:
        if not self.partition:
            if "argsort" in self.df.columns:
                raise ValueError("column exists already: argsort")
            return self._new(self._numbered("argsort", [(col, o)]))
        w = Window.partitionBy(*self.partition).orderBy(self._sort(col, o), *self.order)
        return self.with_column("argsort", (F.row_number().over(w) - 1).cast("long"))

    def rank_profile_by(self, col: str, prefix: str, o: SortOptions = SortOptions()) -> Frame:
        if not self.partition:
            return self._new(self._ranked(col, prefix, o))
        w = Window.partitionBy(*self.partition).orderBy(self._sort(col, o))
        ordinal = Window.partitionBy(*self.partition).orderBy(self._sort(col, o), *self.order)
        return self._new(add(self.df, prefix, {"ordinal_rank": F.row_number().over(ordinal).cast("long"), "competition_rank": F.rank().over(w).cast("long"), "dense_rank": F.dense_rank().over(w).cast("long"), "percent_rank": F.percent_rank().over(w), "cume_dist": F.cume_dist().over(w)}))

    def _ranked(self, col: str, prefix: str, o: SortOptions) -> DataFrame:
        """Ranks over the whole frame: positions by ranges, joined to the values,
        each with the numbers of rows and of values before it."""
        values = self._placed(self.df.groupBy(F.col(col).alias("__v")).agg(F.count("*").alias("__c")), [("__v", o)])
        found = values.groupBy("__block").agg(F.sum("__c").alias("rows"), F.count("*").alias("values")).collect()
        n_rows, n_values = sum(r["rows"] for r in found), sum(r["values"] for r in found)
        w = Window.partitionBy("__block").orderBy(self._sort("__v", o))
        values = values.select(
            "__v", "__c",
            (_starts({r["__block"]: r["rows"] for r in found}) + F.sum("__c").over(w) - F.col("__c")).alias("__a"),
            (_starts({r["__block"]: r["values"] for r in found}) + F.row_number().over(w) - 1).alias("__d"),
        )
        if n_values <= 100_000:  # rows of few values, many of each, are not dealt by value
            values = F.broadcast(values)
        joined = self._numbered("__r", [(col, o)]).join(values, F.col(col).eqNullSafe(F.col("__v")))
        a = F.col("__a")
        ranks = {"ordinal_rank": F.col("__r") + 1, "competition_rank": a + 1, "dense_rank": F.col("__d") + 1, "percent_rank": a / F.lit(n_rows - 1) if n_rows > 1 else F.lit(0.0), "cume_dist": (a + F.col("__c")) / F.lit(n_rows or 1)}
        return add(joined, prefix, ranks, ("__r", "__v", "__a", "__c", "__d"))

    def concat_rows(self, other: Frame) -> Frame:
        a, b = self.df.schema, other.df.schema
        if a.names != b.names or [f.dataType for f in a] != [f.dataType for f in b]:
            raise TypeError("columns differ in names, order or types")
        return self._new(self.df.unionAll(other.df))

    append_rows = vstack = concat_rows

    def distinct_on(self, keys: Sequence[str]) -> Frame:
        """The first row of every key; rows with a null in the key go."""
        if not keys:
            raise ValueError("one key at least")
        row = F.struct(*(F.col(c) for c in self.df.columns))
        first = self.df.dropna(subset=list(keys)).groupBy(*keys).agg(F.min_by(row, F.struct(*self.order)).alias("__r"))
        return self._new(first.select("__r.*"))

    drop_duplicates_on = distinct_on

    def distinct_rows(self, columns: Sequence[str] | None = None) -> Frame:
        return self.distinct_on(list(columns or self.df.columns))

    drop_duplicates = unique_rows = distinct_rows


def frame_of(spark: SparkSession, rows: object, schema: object = None, order: Sequence[str] = ("rid",), partition: Sequence[str] = ()) -> Frame:
    """A frame from local rows, an Arrow table or pandas."""
    return Frame(spark.createDataFrame(rows, schema) if schema is not None else spark.createDataFrame(rows), order, partition)



def empty_frame(spark: SparkSession, schema: str | T.StructType, order: Sequence[str] = (), partition: Sequence[str] = ()) -> Frame:
    """A frame of no rows; without a schema's columns it has none."""
    return Frame(spark.createDataFrame([], schema), order, partition)
