"""Profiles: operators that append derived columns to ordered rows.

Every function takes (frame, input columns, prefix, options) and returns the
frame with ``<prefix>_<suffix>`` columns added; rows neither move nor vanish.
Windows of one profile share the partition and order of the frame, so Spark
plans one exchange and one sort for them. Statistics are over all n (population),
zero denominators give NaN, and a value is null where fewer than ``min_periods``
valid observations are in its window.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

from tessera.functions.expressions import NAN, ge, greatest_over, gt, least_over, lt, nz, sign
from tessera.plans.options import BucketOptions, ClipOptions, EmaOptions, ExpandingOptions, LagOptions, RollingOptions

MAD_SCALE = 0.6744897501960817


class Scope:
    """The windows of a frame: ``wo`` ordered, ``we`` all rows so far, ``wall``
    the whole partition, ``wr(n)`` the last n rows."""

    def __init__(self, order: list[str], partition: list[str]):
        self.key_names, self.order_names = list(partition), list(order)
        self.keys = [F.col(c) for c in partition]
        self.order = [F.col(c) for c in order]
        self.wall = Window.partitionBy(*self.keys)
        self.wo = self.wall.orderBy(*self.order)
        self.we = self.wo.rowsBetween(Window.unboundedPreceding, 0)
        self.before = self.wo.rowsBetween(Window.unboundedPreceding, -1)
        self.whole = self.wo.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def wr(self, n: int) -> WindowSpec:
        return self.wo.rowsBetween(-(n - 1), 0)


class Span:
    """A window of a summary, its gate and the word in its column names."""

    def __init__(self, scope: Scope, options: RollingOptions | ExpandingOptions):
        self.rolling = isinstance(options, RollingOptions)
        self.word = "rolling" if self.rolling else "expanding"
        self.w = scope.wr(options.window) if self.rolling else scope.we
        self.least = options.min_periods

    def count(self, x: Column) -> Column:
        return F.count(x).over(self.w)

    def sum(self, x: Column) -> Column:
        return F.coalesce(F.sum(x.cast("double")).over(self.w), F.lit(0.0))

    def hits(self, x: Column) -> Column:
        return F.coalesce(F.sum(x.cast("long")).over(self.w), F.lit(0)).cast("long")

    def avg(self, x: Column) -> Column:
        return F.avg(x).over(self.w)


def add(df: DataFrame, prefix: str, columns: dict[str, Column], drop: tuple[str, ...] = ()) -> DataFrame:
    named = {f"{prefix}_{k}": v for k, v in columns.items()}
    if clash := set(named) & set(df.columns):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    return df.withColumns(named).drop(*drop)


def _x(name: str) -> Column:
    return F.col(name).cast("double")


def _runs(scope: Scope, holds: Column, at: Column) -> Column:
    """Length of the run of true values that ends here, 0 if it is not true."""
    return at - F.coalesce(F.max(F.when(~F.coalesce(holds, F.lit(False)), at)).over(scope.we), F.lit(0))


# --- per row ---------------------------------------------------------------


def lag(df, scope, x, prefix, o: LagOptions = LagOptions()):
    v, p = _x(x), F.lag(_x(x), o.periods).over(scope.wo)
    df = df.withColumn("__p", p)
    p = F.col("__p")
    return add(df, prefix, {"lag": p, "diff": v - p, "pct_change": nz(v - p, p)}, ("__p",))


def lead(df, scope, x, prefix, o: LagOptions = LagOptions()):
    v, p = _x(x), F.col("__p")
    df = df.withColumn("__p", F.lead(v, o.periods).over(scope.wo))
    return add(df, prefix, {"lead": p, "forward_diff": p - v, "forward_pct_change": nz(p - v, v)}, ("__p",))


def standardize(df, scope, x, prefix, o: ExpandingOptions = ExpandingOptions()):
    v, w = _x(x), scope.wall
    if not scope.key_names:  # one row of statistics, not one task of all rows
        start = F.min_by(v, F.when(v.isNotNull(), F.struct(*scope.order)))
        low, high = (F.when(F.isnan(start), F.lit(NAN)).otherwise(f(F.when(~F.isnan(v), v))) for f in (F.min, F.max))
        one = df.agg(F.count(v).alias("__n"), F.avg(v).alias("__m"), F.stddev_pop(v).alias("__s"), low.alias("__lo"), high.alias("__hi"))
        df = df.crossJoin(F.broadcast(one))
    else:
        df = df.withColumns({"__n": F.count(v).over(w), "__m": F.avg(v).over(w), "__s": F.stddev_pop(v).over(w), "__lo": least_over(v, w, scope.whole), "__hi": greatest_over(v, w, scope.whole)})
    m, s, lo, hi = (F.col(c) for c in ("__m", "__s", "__lo", "__hi"))
    s = F.when(lo == hi, F.lit(0.0)).otherwise(s)
    ok = v.isNotNull() & (F.col("__n") >= o.min_periods)
    return add(df, prefix, {"centered": F.when(ok, v - m), "zscore": F.when(ok, nz(v - m, s)), "minmax": F.when(ok, nz(v - lo, hi - lo))}, ("__n", "__m", "__s", "__lo", "__hi"))


def _robust_columns(v: Column, n: Column, q: Column, mad: Column, least: int, k: float, word: str = "") -> dict[str, Column]:
    q1, med, q3 = q[0], q[1], q[2]
    low, high = q1 - k * (q3 - q1), q3 + k * (q3 - q1)
    ok = v.isNotNull() & (n >= least)
    return {
        f"{word}median_centered": F.when(ok, v - med),
        f"{word}mad_zscore": F.when(ok, nz(MAD_SCALE * (v - med), mad)),
        f"{word}iqr_outlier": F.when(ok, lt(v, low) | gt(v, high)),
        f"{word}winsorized": F.when(ok, F.least(F.when(F.isnan(v), low).otherwise(F.greatest(v, low)), high)),
    }


def robust(df, scope, x, prefix, o: ExpandingOptions = ExpandingOptions(), iqr_multiplier: float = 1.5):
    """Two aggregations per partition, joined back: quantiles, then the median
    of absolute deviations. No window collects the partition."""
    v = _x(x)
    keys = scope.key_names
    quartiles = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    if keys:
        q = df.groupBy(*keys).agg(quartiles.alias("__q"), F.count(v).alias("__n"))
        same = lambda a, b: [a[k].eqNullSafe(b[f"__k{i}"]) for i, k in enumerate(keys)]
        named = lambda t: t.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), *(c for c in t.columns if c not in keys))
        drop = [f"__k{i}" for i in range(len(keys))]
        q2 = named(q)
        dev = df.join(q2, same(df, q2)).drop(*drop).groupBy(*keys).agg(F.percentile(F.abs(v - F.col("__q")[1]), F.lit(0.5)).alias("__mad"))
        m2 = named(dev)
        df = df.join(q2, same(df, q2)).drop(*drop)
        df = df.join(m2, same(df, m2)).drop(*drop)
    else:
        q = df.agg(quartiles.alias("__q"), F.count(v).alias("__n"))
        dev = df.crossJoin(F.broadcast(q)).agg(F.percentile(F.abs(v - F.col("__q")[1]), F.lit(0.5)).alias("__mad"))
        df = df.crossJoin(F.broadcast(q.crossJoin(F.broadcast(dev))))  # one row each
    return add(df, prefix, _robust_columns(v, F.col("__n"), F.col("__q"), F.col("__mad"), o.min_periods, iqr_multiplier), ("__q", "__n", "__mad"))


def drawdown(df, scope, x, prefix, o: ExpandingOptions = ExpandingOptions()):
    v = _x(x)
    df = df.withColumns({"__pk": greatest_over(v, scope.we), "__n": F.count(v).over(scope.we)})
    p, ok = F.col("__pk"), v.isNotNull() & (F.col("__n") >= o.min_periods)
    return add(df, prefix, {"running_peak": F.when(ok, p), "drawdown": F.when(ok, v - p), "drawdown_pct": F.when(ok, nz(v - p, p))}, ("__pk", "__n"))


def extrema(df, scope, x, prefix, o: ExpandingOptions = ExpandingOptions()):
    v = _x(x)
    df = df.withColumns({"__lo": least_over(v, scope.we), "__hi": greatest_over(v, scope.we), "__n": F.count(v).over(scope.we), "__pl": least_over(v, scope.before), "__ph": greatest_over(v, scope.before)})
    ok = v.isNotNull() & (F.col("__n") >= o.min_periods)
    first = F.count(v).over(scope.before) == 0
    return add(df, prefix, {"running_low": F.when(ok, F.col("__lo")), "running_high": F.when(ok, F.col("__hi")), "new_low": F.when(ok, first | lt(v, F.col("__pl"))), "new_high": F.when(ok, first | gt(v, F.col("__ph")))}, ("__lo", "__hi", "__n", "__pl", "__ph"))


def _clip(v: Column, o: ClipOptions) -> tuple[Column, Column, Column]:
    low, high = F.lit(float(o.lower)), F.lit(float(o.upper))
    # NaN is neither below nor above, and is clipped to the lower bound
    clipped = F.when(F.isnan(v), low).when(v.isNotNull(), F.least(F.greatest(v, low), high))
    return clipped, lt(v, low), gt(v, high)


def clip(df, scope, x, prefix, o: ClipOptions):
    c, below, above = _clip(_x(x), o)
    return add(df, prefix, {"clipped": c, "below": below, "above": above, "in_range": ~below & ~above})


def threshold(df, scope, x, prefix, at: float):
    d = _x(x) - F.lit(float(at))
    return add(df, prefix, {"distance": d, "abs_distance": F.abs(d), "above": gt(d, F.lit(0.0)), "below": d < 0, "at": d == 0})


def bucket(df, scope, x, prefix, o: BucketOptions = BucketOptions()):
    v = F.col(x).cast("int") if isinstance(df.schema[x].dataType, T.BooleanType) else _x(x)
    upto = scope.wall.orderBy(v.asc_nulls_last()).rangeBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"__r": F.count(v).over(upto), "__n": F.count(v).over(scope.wall)})
    r, n = F.col("__r"), F.col("__n")
    ok = v.isNotNull() & (n >= o.min_periods)
    e = r / F.when(n > 0, n)
    slot = F.least(F.floor(((r - 1) * o.buckets) / F.when(n > 0, n)), F.lit(o.buckets - 1)).cast("long")
    return add(df, prefix, {"ecdf": F.when(ok, e), "bucket": F.when(ok, slot), "lower_tail": F.when(ok, e <= o.lower_quantile), "upper_tail": F.when(ok, e >= o.upper_quantile)}, ("__r", "__n"))


def ema(df, scope, x, prefix, o: EmaOptions = EmaOptions()):
    """Recursive, so one ordered pass over each partition key: the sorted rows
    stream through a task in Arrow batches, and only the state is kept. Columns
    that are not needed pass by unchanged. Without a key the frame is one task's."""
    df = df.withColumns({"__v": _x(x), "__new": F.row_number().over(scope.wo) == 1})
    df = df.sortWithinPartitions(*scope.keys, *scope.order)
    names = df.columns
    out = T.StructType([*df.schema.fields, T.StructField("__e", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, seen = 0.0, 0
        for b in batches:
            e: list[float | None] = []
            for value, new in zip(b.column("__v").to_pylist(), b.column("__new").to_pylist(), strict=True):
                if new:
                    seen = 0
                if value is not None:
                    state = value if seen == 0 else o.alpha * value + (1 - o.alpha) * state
                    seen += 1
                e.append(state if value is not None and seen >= o.min_periods else None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(e, pa.float64())], [*names, "__e"])

    df = df.mapInArrow(run, out)
    e, v = F.col("__e"), F.col("__v")
    g = lambda c: F.when(e.isNotNull(), c)
    return add(df, prefix, {"ema": e, "ema_residual": g(v - e), "ema_ratio": g(nz(v, e))}, ("__v", "__new", "__e"))


def linear_fit(df, scope, x, y, prefix, o: ExpandingOptions = ExpandingOptions(2)):
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b, w = F.when(both, _x(x)), F.when(both, _x(y)), scope.wall
    sums = {"__n": F.count(a), "__sx": F.sum(a), "__sy": F.sum(b), "__xx": F.sum(a * a), "__xy": F.sum(a * b)}
    spread = lambda t: t.withColumns({k: c.over(w) for k, c in sums.items()})
    if not scope.key_names:  # one row of sums, not one task of all rows
        spread = lambda t: t.crossJoin(F.broadcast(df.agg(*(c.alias(k) for k, c in sums.items()))))
    df = spread(df)
    n, sx, sy, xx, xy = (F.col(c) for c in ("__n", "__sx", "__sy", "__xx", "__xy"))
    slope = nz(n * xy - sx * sy, n * xx - sx * sx)
    df = df.withColumn("__b", slope).withColumn("__f", (sy - F.col("__b") * sx) / F.when(n > 0, n) + F.col("__b") * a).withColumn("__e", b - F.col("__f"))
    squares = F.avg(F.col("__e") * F.col("__e"))
    if scope.key_names:
        df = df.withColumn("__s", F.sqrt(squares.over(w)))
    else:
        df = df.crossJoin(F.broadcast(df.agg(F.sqrt(squares).alias("__s"))))
    ok = both & (n >= o.min_periods)
    return add(df, prefix, {"fitted": F.when(ok, F.col("__f")), "residual": F.when(ok, F.col("__e")), "residual_zscore": F.when(ok, nz(F.col("__e"), F.col("__s"))), "slope": F.when(ok, F.col("__b"))}, ("__n", "__sx", "__sy", "__xx", "__xy", "__b", "__f", "__e", "__s"))


def _errors(actual: str, predicted: str) -> dict[str, Column]:
    a, p = _x(actual), _x(predicted)
    e = a - p
    return {"error": e, "abs_error": F.abs(e), "squared_error": e * e, "ape": nz(F.abs(e), F.abs(a)), "smape": nz(2 * F.abs(e), F.abs(a) + F.abs(p))}


def error(df, scope, actual, predicted, prefix):
    return add(df, prefix, _errors(actual, predicted))


def _crossings(df: DataFrame, scope: Scope, lhs: str, rhs: str, periods: int) -> DataFrame:
    df = df.withColumn("__d", _x(lhs) - _x(rhs)).withColumn("__l", F.lag("__d", periods).over(scope.wo))
    d, p = F.col("__d"), F.col("__l")
    return df.withColumns({"__up": (p <= 0) & gt(d, F.lit(0.0)), "__dn": ge(p, F.lit(0.0)) & (d < 0)}).withColumns({c: F.when(p.isNotNull() & d.isNotNull(), F.col(c)) for c in ("__up", "__dn")})


def crossover(df, scope, lhs, rhs, prefix, o: LagOptions = LagOptions()):
    df = _crossings(df, scope, lhs, rhs, o.periods)
    return add(df, prefix, {"spread": F.col("__d"), "ratio": nz(_x(lhs), _x(rhs)), "cross_above": F.col("__up"), "cross_below": F.col("__dn")}, ("__d", "__l", "__up", "__dn"))


def _trend(df: DataFrame, scope: Scope, x: str, periods: int) -> DataFrame:
    """__at row number, __t sign of the change, __rev reversal."""
    df = df.withColumns({"__at": F.row_number().over(scope.wo).cast("long"), "__t": sign(_x(x) - F.lag(_x(x), periods).over(scope.wo))})
    at, t = F.col("__at"), F.col("__t")
    df = df.withColumns({"__gap": F.coalesce(F.max(F.when(t.isNull(), at)).over(scope.we), F.lit(0)), "__last": F.max(F.when(t != 0, F.struct(at.alias("at"), t.alias("t")))).over(scope.before)})
    known = F.coalesce(F.col("__last.at") > F.col("__gap"), F.lit(False))
    return df.withColumn("__rev", F.when(t.isNotNull(), known & (t != 0) & F.coalesce(t != F.col("__last.t"), F.lit(False)))).drop("__gap", "__last")


def trend(df, scope, x, prefix, o: LagOptions = LagOptions()):
    df = _trend(df, scope, x, o.periods)
    at, t = F.col("__at"), F.col("__t")
    run = lambda k: F.when(t.isNotNull(), _runs(scope, t == k, at))
    return add(df, prefix, {"trend": t, "up_streak": run(1), "down_streak": run(-1), "flat_streak": run(0), "reversal": F.col("__rev")}, ("__at", "__t", "__rev"))


def change_point(df, scope, x, prefix, at_least: float, o: LagOptions = LagOptions()):
    if at_least < 0:
        raise ValueError("threshold must not be negative")
    df = df.withColumn("__p", F.lag(_x(x), o.periods).over(scope.wo))
    d = _x(x) - F.col("__p")
    return add(df, prefix, {"change_delta": d, "change_abs_delta": F.abs(d), "change_pct": nz(d, F.col("__p")), "change_point": ge(F.abs(d), F.lit(float(at_least)))}, ("__p",))


def _signs(df: DataFrame, scope: Scope, x: str, periods: int) -> DataFrame:
    df = df.withColumns({"__at": F.row_number().over(scope.wo).cast("long"), "__s": sign(_x(x))})
    return df.withColumn("__flip", F.col("__s") != F.lag("__s", periods).over(scope.wo))


def sign_profile(df, scope, x, prefix, o: LagOptions = LagOptions()):
    df = _signs(df, scope, x, o.periods)
    at, s = F.col("__at"), F.col("__s")
    run = lambda k: F.when(s.isNotNull(), _runs(scope, s == k, at))
    return add(df, prefix, {"sign": s, "sign_flip": F.col("__flip"), "positive_streak": run(1), "negative_streak": run(-1), "zero_streak": run(0)}, ("__at", "__s", "__flip"))


def validity(df, scope, x, prefix):
    df = df.withColumn("__at", F.row_number().over(scope.wo).cast("long"))
    null, at = F.col(x).isNull(), F.col("__at")
    return add(df, prefix, {"is_null": null, "is_valid": ~null, "valid_streak": _runs(scope, ~null, at), "null_streak": _runs(scope, null, at)}, ("__at",))


def _outcomes(actual: str, predicted: str) -> dict[str, Column]:
    a, p = F.col(actual), F.col(predicted)
    ok = a.isNotNull() & p.isNotNull()
    return {k: F.when(ok, v) for k, v in {"tp": a & p, "fp": ~a & p, "tn": ~a & ~p, "fn": a & ~p, "correct": a == p}.items()}


def classification(df, scope, actual, predicted, prefix):
    for c in (actual, predicted):
        if not isinstance(df.schema[c].dataType, T.BooleanType):
            raise TypeError(f"{c} is not boolean")
    return add(df, prefix, _outcomes(actual, predicted))


def _transitions(df: DataFrame, scope: Scope, b: str, periods: int) -> DataFrame:
    df = df.withColumns({"__at": F.row_number().over(scope.wo).cast("long"), "__pb": F.lag(b, periods).over(scope.wo)})
    v, p = F.col(b), F.col("__pb")
    ok = v.isNotNull() & p.isNotNull()
    return df.withColumns({"__rise": F.when(ok, v & ~p), "__fall": F.when(ok, ~v & p), "__tog": F.when(ok, v != p)})


def bool_transition(df, scope, b, prefix, o: LagOptions = LagOptions()):
    df = _transitions(df, scope, b, o.periods)
    v, at = F.col(b), F.col("__at")
    run = lambda c: F.when(v.isNotNull(), _runs(scope, c, at))
    return add(df, prefix, {"rising": F.col("__rise"), "falling": F.col("__fall"), "toggled": F.col("__tog"), "true_streak": run(v), "false_streak": run(~v)}, ("__at", "__pb", "__rise", "__fall", "__tog"))


# --- rolling and expanding summaries ----------------------------------------


def stats(df, scope, x, prefix, o):
    v, s = _x(x), Span(scope, o)
    df = df.withColumn("__n", s.count(v))
    g = lambda c: F.when(F.col("__n") >= s.least, c)
    if s.rolling:
        more = {"variance": F.var_pop(v).over(s.w), "stddev": F.stddev_pop(v).over(s.w)}
    else:
        more = {"min": least_over(v, s.w), "max": greatest_over(v, s.w)}
    return add(df, prefix, {f"{s.word}_count": F.col("__n"), f"{s.word}_sum": g(s.sum(v)), f"{s.word}_mean": g(s.avg(v))} | {f"{s.word}_{k}": g(c) for k, c in more.items()}, ("__n",))


def moments(df, scope, x, prefix, o):
    v, s = _x(x), Span(scope, o)
    df = df.withColumns({"__n": s.count(v), "__1": s.avg(v), "__2": s.avg(v * v), "__3": s.avg(v * v * v), "__4": s.avg(v * v * v * v), "__lo": F.min(v).over(s.w), "__hi": F.max(v).over(s.w)})
    n, a, b, c, d = (F.col(k) for k in ("__n", "__1", "__2", "__3", "__4"))
    flat = F.col("__lo") == F.col("__hi")
    var = F.when(flat, F.lit(0.0)).otherwise(F.greatest(b - a * a, F.lit(0.0)))
    m3 = F.when(flat, F.lit(0.0)).otherwise(c - 3 * a * b + 2 * a * a * a)
    m4 = F.when(flat, F.lit(0.0)).otherwise(d - 4 * a * c + 6 * a * a * b - 3 * a * a * a * a)
    df = df.withColumns({"__v": var, "__m3": m3, "__m4": m4})
    var, m3, m4 = F.col("__v"), F.col("__m3"), F.col("__m4")
    few = n < 2
    g = lambda e: F.when(n >= s.least, e)
    skew = F.when(few, F.lit(NAN)).otherwise(nz(m3, F.pow(var, F.lit(1.5))))
    kurt = F.when(few, F.lit(NAN)).otherwise(nz(m4, var * var) - 3)
    w = f"{s.word}_"
    return add(df, prefix, {w + "moment_count": n, w + "m3": g(m3), w + "m4": g(m4), w + "skewness": g(skew), w + "kurtosis": g(kurt)}, ("__n", "__1", "__2", "__3", "__4", "__lo", "__hi", "__v", "__m3", "__m4"))


def rolling_range(df, scope, x, prefix, o: RollingOptions):
    v, s = _x(x), Span(scope, o)
    df = df.withColumns({"__n": s.count(v), "__lo": least_over(v, s.w), "__hi": greatest_over(v, s.w)})
    ok = v.isNotNull() & (F.col("__n") >= s.least)
    lo, hi = F.col("__lo"), F.col("__hi")
    return add(df, prefix, {"rolling_low": F.when(ok, lo), "rolling_high": F.when(ok, hi), "rolling_range": F.when(ok, hi - lo), "rolling_position": F.when(ok, nz(v - lo, hi - lo))}, ("__n", "__lo", "__hi"))


def normalize(df, scope, x, prefix, o):
    v, s = _x(x), Span(scope, o)
    df = df.withColumns({"__n": s.count(v), "__m": s.avg(v), "__s": F.stddev_pop(v).over(s.w), "__lo": least_over(v, s.w), "__hi": greatest_over(v, s.w)})
    lo, hi, ok = F.col("__lo"), F.col("__hi"), v.isNotNull() & (F.col("__n") >= s.least)
    sd = F.when(lo == hi, F.lit(0.0)).otherwise(F.col("__s"))
    w = f"{s.word}_"
    return add(df, prefix, {w + "centered": F.when(ok, v - F.col("__m")), w + "zscore": F.when(ok, nz(v - F.col("__m"), sd)), w + "minmax": F.when(ok, nz(v - lo, hi - lo))}, ("__n", "__m", "__s", "__lo", "__hi"))


def quantiles(df, scope, x, prefix, o):
    v, s = _x(x), Span(scope, o)
    if not s.rolling:
        df = _scan(df, scope, x, ("__n", "__q1", "__q2", "__q3")).withColumn("__q", F.array("__q1", "__q2", "__q3")).drop("__q1", "__q2", "__q3")
    else:
        df = df.withColumns({"__n": s.count(v), "__q": F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).over(s.w)})
    ok = F.col("__n") >= s.least
    ok = ok & v.isNotNull() if s.rolling else ok
    q, w = F.col("__q"), f"{s.word}_"
    return add(df, prefix, {w + "q1": F.when(ok, q[0]), w + "median": F.when(ok, q[1]), w + "q3": F.when(ok, q[2]), w + "iqr": F.when(ok, q[2] - q[0])}, ("__n", "__q"))


def bools(df, scope, b, prefix, o):
    v, s = F.col(b), Span(scope, o)
    df = df.withColumns({"__n": s.count(v), "__t": s.hits(v)})
    n, t = F.col("__n"), F.col("__t")
    ok, w = v.isNotNull() & (n >= s.least), f"{s.word}_"
    return add(df, prefix, {w + "true_count": t, w + "false_count": n - t, w + "true_rate": F.when(ok, nz(t.cast("double"), n)), w + "any": F.when(ok, t > 0), w + "all": F.when(ok, t == n)}, ("__n", "__t"))


def rolling_drawdown(df, scope, x, prefix, o: RollingOptions):
    v, s = _x(x), Span(scope, o)
    df = df.withColumn("__at", F.row_number().over(scope.wo).cast("long"))
    here = F.struct(v.alias("v"), F.col("__at").alias("at"))
    start = F.first(F.when(v.isNotNull(), here), ignorenulls=True).over(s.w)
    top = F.max(F.when(v.isNotNull() & ~F.isnan(v), here)).over(s.w)
    df = df.withColumns({"__n": s.count(v), "__pk": F.when(F.isnan(start["v"]), start).otherwise(top)})
    p, ok = F.col("__pk.v"), v.isNotNull() & (F.col("__n") >= s.least)
    return add(df, prefix, {"rolling_peak": F.when(ok, p), "rolling_drawdown": F.when(ok, v - p), "rolling_drawdown_pct": F.when(ok, nz(v - p, p)), "rolling_peak_age": F.when(ok, F.col("__at") - F.col("__pk.at"))}, ("__at", "__n", "__pk"))


def _middle(a: Column) -> Column:
    """Median of a non-empty array by linear interpolation."""
    s = F.sort_array(a)
    n = F.size(a)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


class Ordered:
    """Numbers in order, in blocks, so that insertions and ranks take time in
    proportion to the root of their number. NaN stands after all others."""

    SIZE = 1024

    def __init__(self):
        self.blocks: list[list[float]] = [[]]
        self.nans, self.n = 0, 0

    def add(self, v: float) -> None:
        self.n += 1
        if v != v:
            self.nans += 1
            return
        k = max(0, bisect_right(self.blocks, v, key=lambda b: b[0] if b else v) - 1)
        insort(self.blocks[k], v)
        if len(self.blocks[k]) > 2 * self.SIZE:
            self.blocks[k : k + 1] = [self.blocks[k][: self.SIZE], self.blocks[k][self.SIZE :]]

    def rank(self, v: float) -> tuple[int, int]:
        """(numbers below v, numbers equal to v)."""
        below = upto = 0
        for b in self.blocks:
            if not b or b[0] > v:
                break
            below += bisect_left(b, v)
            upto += bisect_right(b, v)
        return below, upto - below

    def kth(self, k: int) -> float:
        for b in self.blocks:
            if k < len(b):
                return b[k]
            k -= len(b)
        return NAN

    def quantile(self, q: float) -> float:
        at = q * (self.n - 1)
        low, high = self.kth(int(at)), self.kth(min(int(at) + 1, self.n - 1))
        return low if at == int(at) else low + (at - int(at)) * (high - low)

    def deviation(self, centre: float, k: int) -> float:
        """The k-th distance from the centre, from 0: distances grow to either side
        of it, and a search finds how many of the first k lie on the left."""
        below, equal = self.rank(centre)
        left_n = below + equal
        right_n = self.n - left_n
        left, right = (lambda i: centre - self.kth(left_n - 1 - i)), (lambda j: self.kth(left_n + j) - centre)
        low, high = max(0, k - right_n), min(k, left_n)
        while low < high:
            mid = (low + high) // 2
            if left(mid) < right(k - mid - 1):
                low = mid + 1
            else:
                high = mid
        found = [f(i) for f, i, n in ((left, low, left_n), (right, k - low, right_n)) if i < n]
        return min((d for d in found if d == d), default=NAN)


_SCANNED = ("__n", "__q1", "__q2", "__q3", "__mad", "__b", "__e")


def _scan(df: DataFrame, scope: Scope, x: str, wanted: tuple[str, ...], descending: bool = False) -> DataFrame:
    """Order statistics of the values so far, beside every row: sorted rows
    stream through a task, which holds the values of one partition key. Columns
    that are not needed pass by unchanged."""
    df = df.withColumns({"__v": _x(x), "__new": F.row_number().over(scope.wo) == 1})
    df = df.sortWithinPartitions(*scope.keys, *scope.order)
    names = df.columns
    out = T.StructType([*df.schema.fields, *(T.StructField(c, T.DoubleType()) for c in wanted)])
    parts = {"__q1": 0.25, "__q2": 0.5, "__q3": 0.75}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Ordered()
        for b in batches:
            cols: dict[str, list[float | None]] = {c: [] for c in wanted}
            for v, new in zip(b.column("__v").to_pylist(), b.column("__new").to_pylist(), strict=True):
                if new:
                    seen = Ordered()
                if v is not None:
                    seen.add(v)
                n = seen.n
                for c, to in cols.items():
                    if c == "__n":
                        to.append(float(n))
                    elif not n:
                        to.append(None)
                    elif c in parts:
                        to.append(seen.quantile(parts[c]))
                    elif c == "__mad":
                        m = seen.quantile(0.5)
                        to.append(NAN if m != m else (seen.deviation(m, (n - 1) // 2) + seen.deviation(m, n // 2)) / 2)
                    elif v is None:
                        to.append(None)
                    else:
                        below, equal = seen.rank(v) if v == v else (0, 0)
                        to.append(float(equal if c == "__e" else n - seen.nans - below - equal if descending and v == v else below))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, pa.float64()) for c in cols.values())], [*names, *wanted])

    return df.mapInArrow(run, out).withColumn("__n", F.col("__n").cast("long")).drop("__v", "__new")


def windowed_robust(df, scope, x, prefix, o, iqr_multiplier: float = 1.5):
    v, s = _x(x), Span(scope, o)
    if not s.rolling:
        df = _scan(df, scope, x, ("__n", "__q1", "__q2", "__q3", "__mad"))
        q = F.array("__q1", "__q2", "__q3")
        return add(df, prefix, _robust_columns(v, F.col("__n"), q, F.col("__mad"), s.least, iqr_multiplier, "expanding_"), _SCANNED)
    df = df.withColumns({"__n": s.count(v), "__a": F.collect_list(v).over(s.w), "__q": F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).over(s.w)})
    df = df.withColumn("__dev", F.transform("__a", lambda e: F.abs(e - F.col("__q")[1])))
    return add(df, prefix, _robust_columns(v, F.col("__n"), F.col("__q"), _middle(F.col("__dev")), s.least, iqr_multiplier, f"{s.word}_"), ("__n", "__a", "__q", "__dev"))


def windowed_rank(df, scope, x, prefix, o, descending: bool = False):
    v, s = _x(x), Span(scope, o)
    if not s.rolling:
        df = _scan(df, scope, x, ("__n", "__b", "__e"), descending).withColumn("__v", v)
        return _rank_columns(df, prefix, s)
    df = df.withColumns({"__v": v, "__n": s.count(v), "__a": F.collect_list(v).over(s.w)})
    better = F.size(F.filter("__a", lambda e: gt(e, F.col("__v")) if descending else lt(e, F.col("__v"))))
    df = df.withColumns({"__b": better, "__e": F.size(F.filter("__a", lambda e: (e == F.col("__v")) & ~F.isnan(e)))})
    return _rank_columns(df, prefix, s)


def _rank_columns(df: DataFrame, prefix: str, s: Span) -> DataFrame:
    n, b, e = F.col("__n"), F.col("__b"), F.col("__e")
    ok, w = F.col("__v").isNotNull() & (n >= s.least), f"{s.word}_"
    share = F.when(n <= 1, F.lit(0.0)).otherwise(b / F.when(n > 1, n - 1))
    return add(df, prefix, {w + "rank_count": n, w + "rank": F.when(ok, (b + 1).cast("long")), w + "percent_rank": F.when(ok, share), w + "cume_dist": F.when(ok, (b + e) / F.when(n > 0, n))}, ("__v", "__n", "__a", "__b", "__e"))


def _rates(df: DataFrame, s: Span, prefix: str, of: Column, count_name: str, parts: dict[str, Column], drop: tuple[str, ...]) -> DataFrame:
    """A count of valid observations, and the share of each flag among them."""
    df = df.withColumns({"__n": s.count(of)} | {f"__f{i}": s.hits(c) for i, c in enumerate(parts.values())})
    n = F.col("__n")
    shares = {f"{s.word}_{k}": F.when(n >= s.least, nz(F.col(f"__f{i}").cast("double"), n)) for i, k in enumerate(parts)}
    return add(df, prefix, {f"{s.word}_{count_name}": n} | shares, ("__n", *(f"__f{i}" for i in range(len(parts))), *drop))


def trend_summary(df, scope, x, prefix, lag_o: LagOptions, o):
    df = _trend(df, scope, x, lag_o.periods)
    t = F.col("__t")
    return _rates(df, Span(scope, o), prefix, t, "trend_count", {"up_rate": t == 1, "down_rate": t == -1, "flat_rate": t == 0, "reversal_rate": F.col("__rev")}, ("__at", "__t", "__rev"))


def change_point_summary(df, scope, x, prefix, at_least: float, lag_o: LagOptions, o):
    s = Span(scope, o)
    df = df.withColumn("__d", F.abs(_x(x) - F.lag(_x(x), lag_o.periods).over(scope.wo)))
    d = F.col("__d")
    df = df.withColumns({"__n": s.count(d), "__c": s.hits(ge(d, F.lit(float(at_least)))), "__m": s.avg(d), "__hi": greatest_over(d, s.w)})
    n, ok, w = F.col("__n"), F.col("__n") >= s.least, f"{s.word}_"
    return add(df, prefix, {w + "change_count": n, w + "change_point_count": F.col("__c"), w + "change_rate": F.when(ok, nz(F.col("__c").cast("double"), n)), w + "mean_abs_delta": F.when(ok, F.col("__m")), w + "max_abs_delta": F.when(ok, F.col("__hi"))}, ("__d", "__n", "__c", "__m", "__hi"))


def sign_summary(df, scope, x, prefix, lag_o: LagOptions, o):
    df = _signs(df, scope, x, lag_o.periods)
    t = F.col("__s")
    return _rates(df, Span(scope, o), prefix, t, "sign_count", {"positive_rate": t == 1, "negative_rate": t == -1, "zero_rate": t == 0, "sign_flip_rate": F.col("__flip")}, ("__at", "__s", "__flip"))


def clip_summary(df, scope, x, prefix, c: ClipOptions, o):
    s, v = Span(scope, o), _x(x)
    clipped, below, above = _clip(v, c)
    df = df.withColumn("__m", s.avg(clipped)).withColumn("__k", F.count(v).over(s.w))
    df = add(df, prefix, {f"{s.word}_mean_clipped": F.when(F.col("__k") >= s.least, F.col("__m"))}, ("__m", "__k"))
    return _rates(df, s, prefix, v, "clip_count", {"clipped_rate": below | above, "clip_below_rate": below, "clip_above_rate": above, "clip_in_range_rate": ~below & ~above}, ())


def threshold_summary(df, scope, x, prefix, at: float, o):
    s, v = Span(scope, o), _x(x)
    d = v - F.lit(float(at))
    df = df.withColumns({"__m": s.avg(d), "__a": s.avg(F.abs(d)), "__k": F.count(v).over(s.w)})
    ok = F.col("__k") >= s.least
    df = add(df, prefix, {f"{s.word}_mean_distance": F.when(ok, F.col("__m")), f"{s.word}_mean_abs_distance": F.when(ok, F.col("__a"))}, ("__m", "__a", "__k"))
    return _rates(df, s, prefix, v, "threshold_count", {"above_rate": gt(d, F.lit(0.0)), "below_rate": d < 0, "at_rate": d == 0}, ())


def error_summary(df, scope, actual, predicted, prefix, o):
    s, e = Span(scope, o), _errors(actual, predicted)
    df = df.withColumns({"__n": s.count(e["error"]), "__a": s.avg(e["abs_error"]), "__q": s.avg(e["squared_error"]), "__p": s.avg(e["ape"]), "__s": s.avg(e["smape"])})
    ok, w = F.col("__n") >= s.least, f"{s.word}_"
    return add(df, prefix, {w + "error_count": F.col("__n"), w + "mae": F.when(ok, F.col("__a")), w + "rmse": F.when(ok, F.sqrt("__q")), w + "mape": F.when(ok, F.col("__p")), w + "smape": F.when(ok, F.col("__s"))}, ("__n", "__a", "__q", "__p", "__s"))


def crossover_summary(df, scope, lhs, rhs, prefix, lag_o: LagOptions, o):
    s = Span(scope, o)
    df = _crossings(df, scope, lhs, rhs, lag_o.periods)
    df = df.withColumns({"__n": s.count(F.col("__d")), "__u": s.hits(F.col("__up")), "__w": s.hits(F.col("__dn")), "__m": s.avg(F.abs("__d"))})
    n, ok, w = F.col("__n"), F.col("__n") >= s.least, f"{s.word}_"
    rate = lambda c: F.when(ok, nz(F.col(c).cast("double"), n))
    return add(df, prefix, {w + "cross_count": n, w + "cross_above_count": F.col("__u"), w + "cross_below_count": F.col("__w"), w + "cross_above_rate": rate("__u"), w + "cross_below_rate": rate("__w"), w + "mean_abs_spread": F.when(ok, F.col("__m"))}, ("__d", "__l", "__up", "__dn", "__n", "__u", "__w", "__m"))


def classification_summary(df, scope, actual, predicted, prefix, o):
    s, flags = Span(scope, o), _outcomes(actual, predicted)
    df = df.withColumns({"__n": s.count(flags["correct"])} | {f"__{k}": s.hits(flags[k]) for k in ("tp", "fp", "tn", "fn")})
    n, tp, fp, tn, fn = (F.col(f"__{k}") for k in ("n", "tp", "fp", "tn", "fn"))
    g, w = (lambda c: F.when(n >= s.least, c)), f"{s.word}_"
    rate = lambda a, b: g(nz(a.cast("double"), b))
    return add(df, prefix, {w + "class_count": n, w + "tp_count": tp, w + "fp_count": fp, w + "tn_count": tn, w + "fn_count": fn, w + "accuracy": rate(tp + tn, n), w + "precision": rate(tp, tp + fp), w + "recall": rate(tp, tp + fn)}, ("__n", "__tp", "__fp", "__tn", "__fn"))


def bool_transition_summary(df, scope, b, prefix, lag_o: LagOptions, o):
    s = Span(scope, o)
    df = _transitions(df, scope, b, lag_o.periods)
    df = df.withColumns({"__n": s.count(F.col("__tog")), "__r": s.hits(F.col("__rise")), "__f": s.hits(F.col("__fall")), "__g": s.hits(F.col("__tog"))})
    n, w = F.col("__n"), f"{s.word}_"
    rate = lambda c: F.when(n >= s.least, nz(F.col(c).cast("double"), n))
    return add(df, prefix, {w + "transition_count": n, w + "rising_count": F.col("__r"), w + "falling_count": F.col("__f"), w + "toggle_count": F.col("__g"), w + "rising_rate": rate("__r"), w + "falling_rate": rate("__f"), w + "toggle_rate": rate("__g")}, ("__at", "__pb", "__rise", "__fall", "__tog", "__n", "__r", "__f", "__g"))


def _pair(df: DataFrame, s: Span, x: str, y: str) -> DataFrame:
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, _x(x)), F.when(both, _x(y))
    return df.withColumns({"__a": a, "__b": b}).withColumns({"__n": s.count(F.col("__a"))} | {k: s.sum(e) for k, e in {"__sx": F.col("__a"), "__sy": F.col("__b"), "__xx": F.col("__a") * F.col("__a"), "__yy": F.col("__b") * F.col("__b"), "__xy": F.col("__a") * F.col("__b")}.items()})


_PAIR = ("__a", "__b", "__n", "__sx", "__sy", "__xx", "__yy", "__xy")


def correlation(df, scope, x, y, prefix, o):
    s = Span(scope, o)
    df = _pair(df, s, x, y)
    n, sx, sy, xx, yy, xy = (F.col(c) for c in _PAIR[2:])
    m = F.when(n > 0, n)
    df = df.withColumns({"__c": xy / m - (sx / m) * (sy / m), "__vx": F.greatest(xx / m - (sx / m) * (sx / m), F.lit(0.0)), "__vy": F.greatest(yy / m - (sy / m) * (sy / m), F.lit(0.0))})
    c, vx, vy = F.col("__c"), F.col("__vx"), F.col("__vy")
    g, w = (lambda e: F.when(n >= s.least, e)), f"{s.word}_"
    return add(df, prefix, {w + "pair_count": n, w + "covariance": g(c), w + "correlation": g(nz(c, F.sqrt(vx * vy))), w + "beta": g(nz(c, vx))}, (*_PAIR, "__c", "__vx", "__vy"))


def linear_fit_summary(df, scope, x, y, prefix, o):
    s = Span(scope, o)
    df = _pair(df, s, x, y)
    n, sx, sy, xx, yy, xy = (F.col(c) for c in _PAIR[2:])
    m = F.when(n > 0, n)
    df = df.withColumn("__k", nz(n * xy - sx * sy, n * xx - sx * sx)).withColumn("__i", (sy - F.col("__k") * sx) / m)
    k, i = F.col("__k"), F.col("__i")
    sse = yy - 2 * i * sy - 2 * k * xy + n * i * i + 2 * i * k * sx + k * k * xx
    # a sum of squares that is zero but for rounding counts as zero
    sse = F.when(sse <= F.lit(1e-12) * F.greatest(yy, F.lit(1.0)), F.lit(0.0)).otherwise(sse)
    df = df.withColumns({"__f": i + k * F.col("__a"), "__sd": F.when(F.isnan(k), F.lit(NAN)).otherwise(F.sqrt(F.greatest(sse, F.lit(0.0)) / m))})
    g = lambda e: F.when(n >= s.least, e)
    row = lambda e: F.when((n >= s.least) & F.col("__a").isNotNull(), e)
    w, r = f"{s.word}_", F.col("__b") - F.col("__f")
    z = F.when(F.isnan("__sd"), F.lit(NAN)).otherwise(nz(r, F.col("__sd")))
    return add(df, prefix, {w + "pair_count": n, w + "slope": g(k), w + "intercept": g(i), w + "fitted": row(F.col("__f")), w + "residual": row(r), w + "residual_zscore": row(z)}, (*_PAIR, "__k", "__i", "__f", "__sd"))


def validity_summary(df, scope, x, prefix, o):
    s, null = Span(scope, o), F.col(x).isNull()
    df = df.withColumns({"__n": F.count(F.lit(1)).over(s.w), "__v": s.count(F.col(x)), "__z": s.hits(null)})
    n, w = F.col("__n"), f"{s.word}_"
    rate = lambda c: F.when(n >= s.least, nz(F.col(c).cast("double"), n))
    return add(df, prefix, {w + "validity_count": n, w + "valid_count": F.col("__v"), w + "null_count": F.col("__z"), w + "valid_rate": rate("__v"), w + "null_rate": rate("__z")}, ("__n", "__v", "__z"))


#: Name of the operator -> function. Names with rolling_/expanding_ share one
#: function, which takes RollingOptions or ExpandingOptions.
PROFILES: dict[str, Callable] = {
    "lag_profile": lag, "lead_profile": lead, "standardize_profile": standardize, "robust_profile": robust, "drawdown_profile": drawdown, "extrema_profile": extrema,
    "clip_profile": clip, "threshold_profile": threshold, "bucket_profile": bucket, "ema_profile": ema, "linear_fit_profile": linear_fit, "error_profile": error,
    "crossover_profile": crossover, "trend_profile": trend, "change_point_profile": change_point, "sign_profile": sign_profile, "validity_profile": validity,
    "classification_profile": classification, "bool_transition_profile": bool_transition,
    "rolling_profile": stats, "rolling_moment_profile": moments, "rolling_range_profile": rolling_range, "rolling_normalize_profile": normalize, "rolling_quantile_profile": quantiles,
    "rolling_bool_profile": bools, "rolling_drawdown_profile": rolling_drawdown, "rolling_robust_profile": windowed_robust, "rolling_rank_profile": windowed_rank,
    "rolling_trend_profile": trend_summary, "rolling_change_point_profile": change_point_summary, "rolling_sign_profile": sign_summary, "rolling_clip_profile": clip_summary,
    "rolling_threshold_profile": threshold_summary, "rolling_error_profile": error_summary, "rolling_crossover_profile": crossover_summary,
    "rolling_classification_profile": classification_summary, "rolling_bool_transition_profile": bool_transition_summary, "rolling_correlation_profile": correlation,
    "rolling_linear_fit_profile": linear_fit_summary, "rolling_validity_profile": validity_summary,
    "expanding_profile": stats, "expanding_moment_profile": moments, "expanding_normalize_profile": normalize, "expanding_quantile_profile": quantiles, "expanding_bool_profile": bools,
    "expanding_robust_profile": windowed_robust, "expanding_rank_profile": windowed_rank, "expanding_trend_profile": trend_summary, "expanding_change_point_profile": change_point_summary,
    "expanding_sign_profile": sign_summary, "expanding_clip_profile": clip_summary, "expanding_threshold_profile": threshold_summary, "expanding_error_profile": error_summary,
    "expanding_crossover_profile": crossover_summary, "expanding_classification_profile": classification_summary, "expanding_bool_transition_profile": bool_transition_summary,
    "expanding_correlation_profile": correlation, "expanding_linear_fit_profile": linear_fit_summary, "expanding_validity_profile": validity_summary,
}
