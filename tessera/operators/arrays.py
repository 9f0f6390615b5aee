"""Dense array operators in two encodings.

``vec``: a rank-1 array is an ARRAY column; functions take and return columns,
so they stay within Spark's expressions. ``Coo``: an array of any rank is a
table (i0, i1, ..., v), one row an element; shape is metadata, transforms are
index arithmetic, reductions are group-bys and products are joins, so arrays
may be larger than any machine.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.expressions import NAN, clamp, ieee_div, nz

# --- elementwise functions on scalars (columns); maps over vec and Coo alike ---


def _softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def _domain(ok: Column, value: Column, x: Column) -> Column:
    return F.when(ok, value).when(x.isNotNull(), F.lit(NAN))


UNARY: dict[str, Callable[[Column], Column]] = {
    "neg": lambda x: -x, "positive": lambda x: x, "abs": F.abs, "square": lambda x: x * x, "reciprocal": lambda x: ieee_div(F.lit(1.0), x), "sign": F.signum,
    "exp": F.exp, "exp2": lambda x: F.pow(F.lit(2.0), x), "expm1": F.expm1, "log": lambda x: _domain(x > 0, F.log(x), x), "log2": lambda x: _domain(x > 0, F.log2(x), x), "log10": lambda x: _domain(x > 0, F.log10(x), x), "log1p": lambda x: _domain(x > -1, F.log1p(x), x),
    "sqrt": lambda x: _domain(x >= 0, F.sqrt(x), x), "rsqrt": lambda x: nz(F.lit(1.0), _domain(x >= 0, F.sqrt(x), x)), "cbrt": F.cbrt, "floor": lambda x: F.floor(x).cast("double"), "ceil": lambda x: F.ceil(x).cast("double"), "round": lambda x: F.rint(x), "trunc": lambda x: F.signum(x) * F.floor(F.abs(x)),
    "deg2rad": F.radians, "rad2deg": F.degrees, "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "asinh": F.asinh, "acosh": F.acosh, "atanh": F.atanh,
    "sinc": lambda x: F.when(x == 0, F.lit(1.0)).otherwise(F.sin(x * math.pi) / F.when(x != 0, x * math.pi)), "expit": lambda x: 1 / (1 + F.exp(-x)), "logit": lambda x: _domain((x > 0) & (x < 1), F.log(nz(x, 1 - x)), x),
    "nan_to_num": lambda x: F.when(F.isnan(x), F.lit(0.0)).otherwise(x), "is_nan": F.isnan, "is_inf": lambda x: F.abs(x) == float("inf"), "is_pos_inf": lambda x: x == float("inf"), "is_neg_inf": lambda x: x == float("-inf"), "is_finite": lambda x: ~F.isnan(x) & (F.abs(x) != float("inf")), "signbit": lambda x: x < 0, "logical_not": lambda x: x == 0,
    "relu": lambda x: F.greatest(x, F.lit(0.0)), "relu6": lambda x: clamp(x, F.lit(0.0), F.lit(6.0)), "leaky_relu": lambda x: F.when(x >= 0, x).otherwise(x * 0.01), "elu": lambda x: F.when(x > 0, x).otherwise(F.expm1(x)), "celu": lambda x: F.when(x > 0, x).otherwise(F.expm1(x)),
    "selu": lambda x: 1.0507009873554805 * F.when(x > 0, x).otherwise(1.6732632423543772 * F.expm1(x)), "sigmoid": lambda x: 1 / (1 + F.exp(-x)), "silu": lambda x: x / (1 + F.exp(-x)), "mish": lambda x: x * F.tanh(_softplus(x)), "hardtanh": lambda x: clamp(x, F.lit(-1.0), F.lit(1.0)),
    "hardsigmoid": lambda x: clamp(x / 6 + 0.5, F.lit(0.0), F.lit(1.0)), "hardswish": lambda x: x * clamp(x / 6 + 0.5, F.lit(0.0), F.lit(1.0)), "hardshrink": lambda x: F.when(F.abs(x) > 0.5, x).otherwise(0.0), "softshrink": lambda x: F.when(x > 0.5, x - 0.5).when(x < -0.5, x + 0.5).otherwise(0.0),
    "tanhshrink": lambda x: x - F.tanh(x), "logsigmoid": lambda x: -_softplus(-x), "softplus": _softplus, "softsign": lambda x: x / (1 + F.abs(x)), "gelu": lambda x: 0.5 * x * (1 + F.tanh(math.sqrt(2 / math.pi) * (x + 0.044715 * x * x * x))),
}

BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": ieee_div, "pow": F.pow, "floor_div": lambda a, b: F.floor(ieee_div(a, b)).cast("double"), "mod": lambda a, b: nz(a - b * F.floor(nz(a, b)), b) * b, "remainder": lambda a, b: a - b * F.floor(nz(a, b)),
    "maximum": lambda a, b: F.when(F.isnan(a) | F.isnan(b), F.lit(NAN)).otherwise(F.greatest(a, b)), "minimum": lambda a, b: F.when(F.isnan(a) | F.isnan(b), F.lit(NAN)).otherwise(F.least(a, b)), "fmax": lambda a, b: F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.greatest(a, b)), "fmin": lambda a, b: F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.least(a, b)),
    "hypot": F.hypot, "atan2": F.atan2, "log_add_exp": lambda a, b: F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b))), "log_add_exp2": lambda a, b: F.greatest(a, b) + F.log2(1 + F.pow(F.lit(2.0), -F.abs(a - b))), "xlogy": lambda a, b: F.when(a == 0, F.lit(0.0)).otherwise(a * UNARY["log"](b)),
    "copysign": lambda a, b: F.when(b < 0, -F.abs(a)).otherwise(F.abs(a)), "heaviside": lambda a, b: F.when(a < 0, F.lit(0.0)).when(a == 0, b).otherwise(F.lit(1.0)), "ldexp": lambda a, b: a * F.pow(F.lit(2.0), b),
    "eq": lambda a, b: ~F.isnan(a) & (a == b), "ne": lambda a, b: F.isnan(a) | (a != b), "gt": lambda a, b: ~F.isnan(a) & (a > b), "ge": lambda a, b: ~F.isnan(a) & (a >= b), "lt": lambda a, b: ~F.isnan(b) & (a < b), "le": lambda a, b: ~F.isnan(b) & (a <= b),
    "lerp_half": lambda a, b: a + 0.5 * (b - a), "prelu": lambda a, b: F.when(a >= 0, a).otherwise(a * b), "threshold": lambda a, b: F.when(a > b, a).otherwise(0.0),
    "logical_and": lambda a, b: (a != 0) & (b != 0), "logical_or": lambda a, b: (a != 0) | (b != 0), "logical_xor": lambda a, b: (a != 0) != (b != 0), "isclose": lambda a, b: F.abs(a - b) <= 1e-8 + 1e-5 * F.abs(b),
}

LOSSES: dict[str, Callable[[Column, Column], Column]] = {
    "mse": lambda p, t: (p - t) * (p - t), "l1": lambda p, t: F.abs(p - t), "smooth_l1": lambda p, t: F.when(F.abs(p - t) < 1, 0.5 * (p - t) * (p - t)).otherwise(F.abs(p - t) - 0.5), "huber": lambda p, t: F.when(F.abs(p - t) <= 1, 0.5 * (p - t) * (p - t)).otherwise(F.abs(p - t) - 0.5),
    "bce": lambda p, t: -(t * UNARY["log"](p) + (1 - t) * UNARY["log"](1 - p)), "bce_with_logits": lambda x, t: F.greatest(x, F.lit(0.0)) - x * t + F.log1p(F.exp(-F.abs(x))), "hinge": lambda p, t: F.greatest(1 - p * t, F.lit(0.0)), "soft_margin": lambda p, t: F.log1p(F.exp(-p * t)),
    "kl_div": lambda q, t: F.when(t > 0, t * (F.log(F.when(t > 0, t)) - q)).otherwise(0.0), "poisson_nll": lambda x, t: F.exp(x) - t * x, "hinge_embedding": lambda x, t: F.when(t == 1, x).otherwise(F.greatest(1 - x, F.lit(0.0))),
}

LOSSES |= {
    "margin_ranking": lambda d, t: F.greatest(-t * d, F.lit(0.0)),  # d: difference of two scores, t: 1 or -1
    "gaussian_nll": lambda e, v: 0.5 * (F.log(v) + e * e / v),  # e: error, v: variance
}
#: Functions that are not 0 at 0: arrays with absent elements are filled for them.
_NOT_ZERO = frozenset("reciprocal exp exp2 log log2 log10 rsqrt cos acos cosh acosh sinc expit logit is_finite logical_not sigmoid hardsigmoid logsigmoid softplus".split())
_ZERO_BINARY = frozenset("add sub mul".split())
_ADD = lambda a, x: a + x


class vec:
    """Rank-1 arrays as columns."""

    @staticmethod
    def map(a: Column, op: str) -> Column:
        return F.transform(a, UNARY[op])

    @staticmethod
    def zip(a: Column, b: Column, op: str) -> Column:
        return F.zip_with(a, b, BINARY[op])

    @staticmethod
    def sum(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    @staticmethod
    def prod(a: Column) -> Column:
        return F.aggregate(a, F.lit(1.0), lambda s, x: s * x)

    @staticmethod
    def mean(a: Column) -> Column:
        return nz(vec.sum(a), F.size(a))

    @staticmethod
    def variance(a: Column) -> Column:
        m = vec.mean(a)
        return nz(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)), F.size(a))

    @staticmethod
    def dot(a: Column, b: Column) -> Column:
        return vec.sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y))

    @staticmethod
    def norm(a: Column, p: float = 2.0) -> Column:
        if p == 1:
            return F.aggregate(a, F.lit(0.0), lambda s, x: s + F.abs(x))
        if math.isinf(p):
            return F.array_max(F.transform(a, F.abs)).cast("double")
        return F.pow(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.pow(F.abs(x), F.lit(p))), F.lit(1 / p))

    @staticmethod
    def normalize(a: Column) -> Column:
        n = vec.norm(a)
        return F.transform(a, lambda x: nz(x.cast("double"), n))

    @staticmethod
    def cosine_similarity(a: Column, b: Column) -> Column:
        return nz(vec.dot(a, b), vec.norm(a) * vec.norm(b))

    @staticmethod
    def pairwise_distance(a: Column, b: Column) -> Column:
        return vec.norm(F.zip_with(a, b, lambda x, y: x.cast("double") - y))

    @staticmethod
    def softmax(a: Column) -> Column:
        m = F.array_max(a)
        e = F.transform(a, lambda x: F.exp(x.cast("double") - m))
        return F.transform(e, lambda x: x / vec.sum(e))

    @staticmethod
    def logsumexp(a: Column) -> Column:
        m = F.array_max(a).cast("double")
        return m + F.log(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.exp(x - m)))

    @staticmethod
    def log_softmax(a: Column) -> Column:
        z = vec.logsumexp(a)
        return F.transform(a, lambda x: x - z)

    @staticmethod
    def cumsum(a: Column) -> Column:
        zero = F.struct(F.array().cast("array<double>").alias("out"), F.lit(0.0).alias("s"))
        return F.aggregate(a, zero, lambda acc, x: F.struct(F.array_append(acc["out"], acc["s"] + x).alias("out"), (acc["s"] + x).alias("s")))["out"]

    @staticmethod
    def diff(a: Column) -> Column:
        return F.transform(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), lambda x, i: x - F.get(a, i))

    @staticmethod
    def argsort(a: Column, descending: bool = False) -> Column:
        s = F.sort_array(F.transform(a, lambda x, i: F.struct((-x if descending else x).alias("v"), i.alias("i"))))
        return F.transform(s, lambda t: t["i"])

    @staticmethod
    def topk(a: Column, k: int) -> Column:
        return F.slice(F.sort_array(a, asc=False), 1, k)

    @staticmethod
    def argmax(a: Column) -> Column:
        return F.array_position(a, F.array_max(a)) - 1

    @staticmethod
    def argmin(a: Column) -> Column:
        return F.array_position(a, F.array_min(a)) - 1

    @staticmethod
    def quantile(a: Column, q: float) -> Column:
        s, at = F.sort_array(a), (F.size(a) - 1) * F.lit(float(q))
        lo = F.get(s, F.floor(at).cast("int")).cast("double")
        return lo + (at - F.floor(at)) * (F.get(s, F.ceil(at).cast("int")) - lo)

    @staticmethod
    def median(a: Column) -> Column:
        return vec.quantile(a, 0.5)

    @staticmethod
    def take(a: Column, idx: Sequence[int], mode: str = "raise") -> Column:
        n = F.size(a)
        place = {"raise": lambda i: F.lit(i) if i >= 0 else n + i, "wrap": lambda i: F.pmod(F.lit(i), n), "clip": lambda i: F.least(F.greatest(F.lit(i), F.lit(0)), n - 1)}[mode]
        return F.array(*(F.get(a, place(i)) for i in idx))

    @staticmethod
    def roll(a: Column, k: int) -> Column:
        return F.transform(a, lambda _, i: F.get(a, F.pmod(i - k, F.size(a))))

    @staticmethod
    def convolve(a: Column, kernel: Sequence[float], mode: str = "full") -> Column:
        k, n = len(kernel), F.size(a)
        full = F.transform(F.sequence(F.lit(0), n + k - 2), lambda i: reduce(_ADD, (F.coalesce(F.when(i >= j, F.get(a, i - j)), F.lit(0.0)) * float(w) for j, w in enumerate(kernel))))
        if mode == "full":
            return full
        return F.slice(full, k, F.greatest(n - k + 1, F.lit(0))) if mode == "valid" else F.slice(full, (k - 1) // 2 + 1, n)

    @staticmethod
    def cross_entropy(logits: Column, label: Column) -> Column:
        """Of one row of logits against a class number."""
        return vec.logsumexp(logits) - F.get(logits, label.cast("int"))

    @staticmethod
    def nll(log_p: Column, label: Column) -> Column:
        return -F.get(log_p, label.cast("int"))

    @staticmethod
    def cosine_embedding(a: Column, b: Column, t: Column, margin: float = 0.0) -> Column:
        c = vec.cosine_similarity(a, b)
        return F.when(t == 1, 1 - c).otherwise(F.greatest(c - margin, F.lit(0.0)))

    @staticmethod
    def triplet(a: Column, p: Column, n: Column, margin: float = 1.0) -> Column:
        return F.greatest(vec.pairwise_distance(a, p) - vec.pairwise_distance(a, n) + margin, F.lit(0.0))

    @staticmethod
    def multi_margin(scores: Column, label: Column, margin: float = 1.0) -> Column:
        own = F.get(scores, label.cast("int"))
        all_ = F.aggregate(F.transform(scores, lambda x, i: F.when(i == label, F.lit(0.0)).otherwise(F.greatest(margin - own + x, F.lit(0.0)))), F.lit(0.0), _ADD)
        return all_ / F.size(scores)

    @staticmethod
    def glu(a: Column) -> Column:
        """The first half, gated by the sigmoid of the second."""
        h = (F.size(a) / 2).cast("int")
        return F.zip_with(F.slice(a, 1, h), F.slice(a, h + 1, h), lambda x, g: x / (1 + F.exp(-g)))

    @staticmethod
    def softmin(a: Column) -> Column:
        return vec.softmax(F.transform(a, lambda x: -x))

    @staticmethod
    def gather(a: Column, idx: Column) -> Column:
        """Elements at an array of positions; null outside."""
        return F.transform(idx, lambda i: F.get(a, i.cast("int")))

    @staticmethod
    def put(a: Column, idx: Column, values: Column) -> Column:
        """``a`` with values at positions; of a position that repeats the last counts."""
        at = F.map_from_entries(F.aggregate(F.arrays_zip(idx.alias("i"), values.alias("v")), F.array().cast("array<struct<i:int,v:double>>"), lambda acc, t: F.array_append(F.filter(acc, lambda e: e["i"] != t["i"]), F.struct(t["i"].cast("int").alias("i"), t["v"].cast("double").alias("v")))))
        return F.transform(a, lambda x, i: F.coalesce(F.element_at(at, i), x.cast("double")))

    @staticmethod
    def scatter_add(a: Column, idx: Column, values: Column) -> Column:
        pairs = F.arrays_zip(idx.alias("i"), values.alias("v"))
        return F.transform(a, lambda x, i: x + F.aggregate(F.filter(pairs, lambda t: t["i"] == i), F.lit(0.0), lambda s, t: s + t["v"]))

    @staticmethod
    def masked_fill(a: Column, mask: Column, value: float) -> Column:
        return F.zip_with(a, mask, lambda x, m: F.when(m, F.lit(float(value))).otherwise(x.cast("double")))

    @staticmethod
    def where(mask: Column, a: Column, b: Column) -> Column:
        return F.transform(mask, lambda m, i: F.when(m, F.get(a, i)).otherwise(F.get(b, i)))

    @staticmethod
    def repeat(a: Column, k: int) -> Column:
        return F.flatten(F.transform(a, lambda x: F.array_repeat(x, k)))

    @staticmethod
    def tile(a: Column, k: int) -> Column:
        return F.flatten(F.array_repeat(a, k))

    @staticmethod
    def split(a: Column, k: int) -> Column:
        """``k`` parts of equal length."""
        n = (F.size(a) / k).cast("int")
        return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.slice(a, i * n + 1, n))

    @staticmethod
    def gradient(a: Column) -> Column:
        """Central differences, one-sided at the ends."""
        n = F.size(a)
        lo, hi = (lambda i: F.greatest(i - 1, F.lit(0))), (lambda i: F.least(i + 1, n - 1))
        return F.transform(a, lambda _, i: (F.get(a, hi(i)) - F.get(a, lo(i))) / (hi(i) - lo(i)))

    @staticmethod
    def trapezoid(a: Column) -> Column:
        return vec.sum(F.transform(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), lambda x, i: (x + F.get(a, i)) / 2))

    @staticmethod
    def correlate(a: Column, kernel: Sequence[float], mode: str = "full") -> Column:
        return vec.convolve(a, list(kernel)[::-1], mode)

    @staticmethod
    def rfft(a: Column) -> Column:
        """Array of (re, im) for the frequencies 0 .. n / 2, by the definition."""
        n = F.size(a)
        turn = lambda k, f: F.aggregate(F.transform(a, lambda x, i: x.cast("double") * f(k * i * (2 * math.pi) / n)), F.lit(0.0), _ADD)
        return F.transform(F.sequence(F.lit(0), F.floor(n / 2).cast("int")), lambda k: F.struct(turn(k, F.cos).alias("re"), (-turn(k, F.sin)).alias("im")))

    @staticmethod
    def nan_reduce(a: Column, op: str, q: float = 0.5) -> Column:
        """Statistics of the elements that are numbers; NaN if there are none."""
        b = F.filter(a, lambda x: ~F.isnan(x) & x.isNotNull())
        if op in ("argmin", "argmax"):
            return F.array_position(a, F.array_min(b) if op == "argmin" else F.array_max(b)) - 1
        f = {"sum": vec.sum, "mean": vec.mean, "variance": vec.variance, "stddev": lambda x: F.sqrt(vec.variance(x)), "min": F.array_min, "max": F.array_max, "median": vec.median, "quantile": lambda x: vec.quantile(x, q), "prod": vec.prod}[op]
        return f(b) if op in ("sum", "prod") else F.when(F.size(b) > 0, f(b)).otherwise(F.lit(NAN))

    flip = staticmethod(F.reverse)
    sort = staticmethod(F.sort_array)
    unique = staticmethod(lambda a: F.sort_array(F.array_distinct(a)))
    union1d = staticmethod(lambda a, b: F.sort_array(F.array_union(a, b)))
    intersect1d = staticmethod(lambda a, b: F.sort_array(F.array_intersect(a, b)))
    setdiff1d = staticmethod(lambda a, b: F.sort_array(F.array_except(a, b)))
    setxor1d = staticmethod(lambda a, b: F.sort_array(F.array_union(F.array_except(a, b), F.array_except(b, a))))
    isin = staticmethod(lambda a, b: F.transform(a, lambda x: F.array_contains(b, x)))
    compress = staticmethod(lambda a, mask: F.transform(F.filter(F.arrays_zip(a.alias("x"), mask.alias("m")), lambda t: t["m"]), lambda t: t["x"]))
    count_nonzero = staticmethod(lambda a: F.size(F.filter(a, lambda x: x != 0)))


@dataclass(frozen=True)
class Coo:
    """An array as rows (i0, i1, ..., v); elements not present are zero.
    ``complete``: all are present, so nothing has to be filled in where zeros
    count (means and sums do without; minima and exponentials do not)."""

    df: DataFrame
    shape: tuple[int, ...]
    complete: bool = False

    @property
    def axes(self) -> list[str]:
        return [f"i{k}" for k in range(len(self.shape))]

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def numel(self) -> int:
        return math.prod(self.shape)

    @classmethod
    def of(cls, spark: SparkSession, a: np.ndarray) -> Coo:
        a = np.asarray(a, float)
        rows = [(*map(int, i), float(v)) for i, v in np.ndenumerate(a)]
        return cls(spark.createDataFrame(rows, ", ".join([*(f"i{k} long" for k in range(a.ndim)), "v double"])), a.shape, True)

    @classmethod
    def full(cls, spark: SparkSession, shape: tuple[int, ...], value: float) -> Coo:
        flat = spark.range(math.prod(shape))
        return cls(_unravel(flat, "id", shape).select(*(f"i{k}" for k in range(len(shape))), F.lit(float(value)).alias("v")), shape, True)

    @classmethod
    def eye(cls, spark: SparkSession, n: int) -> Coo:
        return cls(spark.range(n).select(F.col("id").alias("i0"), F.col("id").alias("i1"), F.lit(1.0).alias("v")), (n, n))

    @classmethod
    def arange(cls, spark: SparkSession, n: int, start: float = 0.0, step: float = 1.0) -> Coo:
        return cls(spark.range(n).select(F.col("id").alias("i0"), (F.lit(start) + F.col("id") * step).alias("v")), (n,), True)

    def to_numpy(self) -> np.ndarray:
        """For arrays that fit the driver."""
        out = np.zeros(self.shape)
        for r in self.df.select(*self.axes, "v").toLocalIterator():
            out[tuple(r[:-1])] = r[-1]
        return out

    @classmethod
    def linspace(cls, spark: SparkSession, start: float, stop: float, n: int) -> Coo:
        return cls.arange(spark, n, start, (stop - start) / max(n - 1, 1))

    @classmethod
    def logspace(cls, spark: SparkSession, start: float, stop: float, n: int, base: float = 10.0) -> Coo:
        x = cls.linspace(spark, start, stop, n)
        return Coo(x.df.withColumn("v", F.pow(F.lit(base), F.col("v"))), x.shape, True)

    @classmethod
    def geomspace(cls, spark: SparkSession, start: float, stop: float, n: int) -> Coo:
        return cls.logspace(spark, math.log10(start), math.log10(stop), n)

    @classmethod
    def meshgrid(cls, a: Coo, b: Coo) -> tuple[Coo, Coo]:
        """Both vectors along the axes (a, b) of a grid."""
        spark, shape = a.df.sparkSession, (a.shape[0], b.shape[0])
        grid = cls.full(spark, shape, 0.0)
        return grid.binary(Coo(a.df, a.shape, a.complete).expand_dims(1), "add"), grid.binary(b.expand_dims(0), "add")

    def full_like(self, value: float) -> Coo:
        return Coo.full(self.df.sparkSession, self.shape, value)

    def filled(self) -> Coo:
        """The same with a row for every element."""
        if self.complete:
            return self
        every = _unravel(self.df.sparkSession.range(self.numel), "id", self.shape).select(*self.axes)
        return Coo(every.join(self.df, self.axes, "left").select(*self.axes, F.coalesce("v", F.lit(0.0)).alias("v")), self.shape, True)

    def map(self, op: str) -> Coo:
        a = self.filled() if op in _NOT_ZERO else self
        return Coo(a.df.withColumn("v", UNARY[op](F.col("v"))), a.shape, a.complete)

    def scalar(self, op: str, s: float) -> Coo:
        a = self if op == "mul" and math.isfinite(s) else self.filled()
        return Coo(a.df.withColumn("v", BINARY[op](F.col("v"), F.lit(float(s)))), a.shape, a.complete)

    def binary(self, other: Coo, op: str) -> Coo:
        """Elementwise, broadcasting axes of length 1."""
        shape = np.broadcast_shapes(self.shape, other.shape)
        if self.shape != other.shape or op not in _ZERO_BINARY:
            self, other = self.filled(), other.filled()
        a, b = self._lifted(len(shape), "a"), other._lifted(len(shape), "b")
        own, its = (1,) * (len(shape) - self.ndim) + self.shape, (1,) * (len(shape) - other.ndim) + other.shape
        shared = [k for k in range(len(shape)) if own[k] > 1 and its[k] > 1 or own[k] == its[k]]
        joined = a.join(b, reduce(lambda x, y: x & y, (F.col(f"a{k}") == F.col(f"b{k}") for k in shared), F.lit(True)), "full" if own == its else "inner")
        idx = [(F.coalesce(f"a{k}", f"b{k}") if k in shared else F.col(f"a{k}" if own[k] > 1 else f"b{k}")).alias(f"i{k}") for k in range(len(shape))]
        return Coo(joined.select(*idx, BINARY[op](F.coalesce("av", F.lit(0.0)), F.coalesce("bv", F.lit(0.0))).alias("v")), tuple(shape), self.complete and other.complete)

    def _lifted(self, ndim: int, name: str) -> DataFrame:
        pad = ndim - self.ndim
        return self.df.select(*(F.lit(0).cast("long").alias(f"{name}{k}") for k in range(pad)), *(F.col(f"i{k}").alias(f"{name}{k + pad}") for k in range(self.ndim)), F.col("v").alias(f"{name}v"))

    # --- transforms: index arithmetic ---

    def transpose(self, perm: Sequence[int] | None = None) -> Coo:
        perm = list(perm) if perm is not None else list(range(self.ndim))[::-1]
        return Coo(self.df.select(*(F.col(f"i{p}").alias(f"i{k}") for k, p in enumerate(perm)), "v"), tuple(self.shape[p] for p in perm), self.complete)

    permute = transpose

    def swapaxes(self, a: int, b: int) -> Coo:
        perm = list(range(self.ndim))
        perm[a], perm[b] = perm[b], perm[a]
        return self.transpose(perm)

    def reshape(self, shape: tuple[int, ...]) -> Coo:
        if -1 in shape:
            shape = tuple(self.numel // -math.prod(shape) if n == -1 else n for n in shape)
        if math.prod(shape) != self.numel:
            raise ValueError("shapes hold different numbers of elements")
        return Coo(_unravel(self.df.withColumn("__f", _ravel(self.shape)), "__f", shape).select(*(f"i{k}" for k in range(len(shape))), "v"), shape, self.complete)

    def ravel(self) -> Coo:
        return self.reshape((self.numel,))

    def flip(self, axis: int) -> Coo:
        return Coo(self.df.withColumn(f"i{axis}", self.shape[axis] - 1 - F.col(f"i{axis}")), self.shape, self.complete)

    def roll(self, k: int, axis: int) -> Coo:
        return Coo(self.df.withColumn(f"i{axis}", F.pmod(F.col(f"i{axis}") + k, F.lit(self.shape[axis])).cast("long")), self.shape, self.complete)

    def narrow(self, axis: int, start: int, length: int) -> Coo:
        c = F.col(f"i{axis}")
        return Coo(self.df.where((c >= start) & (c < start + length)).withColumn(f"i{axis}", c - start), (*self.shape[:axis], length, *self.shape[axis + 1 :]), self.complete)

    def cat(self, other: Coo, axis: int) -> Coo:
        moved = other.df.withColumn(f"i{axis}", F.col(f"i{axis}") + self.shape[axis])
        return Coo(self.df.select(*self.axes, "v").unionAll(moved.select(*self.axes, "v")), (*self.shape[:axis], self.shape[axis] + other.shape[axis], *self.shape[axis + 1 :]), self.complete and other.complete)

    def triu(self, k: int = 0) -> Coo:
        return Coo(self.df.where(F.col("i1") - F.col("i0") >= k), self.shape)

    def tril(self, k: int = 0) -> Coo:
        return Coo(self.df.where(F.col("i1") - F.col("i0") <= k), self.shape)

    def diagonal(self) -> Coo:
        return Coo(self.df.where("i0 = i1").select("i0", "v"), (min(self.shape),))

    def pad(self, axis: int, before: int, after: int) -> Coo:
        return Coo(self.df.withColumn(f"i{axis}", F.col(f"i{axis}") + before), (*self.shape[:axis], self.shape[axis] + before + after, *self.shape[axis + 1 :]))

    def expand_dims(self, axis: int) -> Coo:
        cols = [*(F.col(f"i{k}") for k in range(axis)), F.lit(0).cast("long").alias(f"i{axis}"), *(F.col(f"i{k}").alias(f"i{k + 1}") for k in range(axis, self.ndim))]
        return Coo(self.df.select(*cols, "v"), (*self.shape[:axis], 1, *self.shape[axis:]), self.complete)

    def squeeze(self) -> Coo:
        kept = [k for k, n in enumerate(self.shape) if n != 1]
        return Coo(self.df.select(*(F.col(f"i{k}").alias(f"i{j}") for j, k in enumerate(kept)), "v"), tuple(self.shape[k] for k in kept), self.complete)

    def flatten(self, start: int = 0, end: int = -1) -> Coo:
        end %= self.ndim
        return self.reshape((*self.shape[:start], math.prod(self.shape[start : end + 1]), *self.shape[end + 1 :]))

    def stack(self, other: Coo, axis: int = 0) -> Coo:
        return self.expand_dims(axis).cat(other.expand_dims(axis), axis)

    def split(self, k: int, axis: int = 0) -> list[Coo]:
        n = self.shape[axis] // k
        if n * k != self.shape[axis]:
            raise ValueError("parts are not equal")
        return [self.narrow(axis, i * n, n) for i in range(k)]

    def repeat(self, k: int, axis: int) -> Coo:
        """Every slice along the axis, ``k`` times."""
        at = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
        moved = self.df.withColumn("__j", at).withColumn(f"i{axis}", F.col(f"i{axis}") * k + F.col("__j")).drop("__j")
        return Coo(moved, (*self.shape[:axis], self.shape[axis] * k, *self.shape[axis + 1 :]), self.complete)

    def tile(self, k: int, axis: int) -> Coo:
        at = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
        moved = self.df.withColumn("__j", at).withColumn(f"i{axis}", F.col(f"i{axis}") + F.col("__j") * self.shape[axis]).drop("__j")
        return Coo(moved, (*self.shape[:axis], self.shape[axis] * k, *self.shape[axis + 1 :]), self.complete)

    def rot90(self, k: int = 1) -> Coo:
        out = self
        for _ in range(k % 4):
            out = out.transpose([1, 0]).flip(0)
        return out

    def trace(self) -> DataFrame:
        return self.df.where("i0 = i1").agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("v"))

    def diag_embed(self) -> Coo:
        return Coo(self.df.select("i0", F.col("i0").alias("i1"), "v"), (self.shape[0], self.shape[0]))

    def fill_diagonal(self, value: float) -> Coo:
        n = min(self.shape)
        line = self.df.sparkSession.range(n).select(F.col("id").alias("i0"), F.col("id").alias("i1"), F.lit(float(value)).alias("v"))
        return Coo(self.df.where("i0 <> i1").select("i0", "i1", "v").unionAll(line), self.shape, self.complete)

    # --- indexing ---

    def gather(self, axis: int, idx: DataFrame, place: str = "at", index: str = "index") -> Coo:
        """Slices by position: ``idx`` has (``at``, ``index``): result slice ``at``
        is slice ``index``."""
        n = idx.count()
        joined = self.df.join(idx.select(F.col(place).cast("long").alias("__p"), F.col(index).cast("long").alias("__i")), F.col(f"i{axis}") == F.col("__i"))
        return Coo(joined.withColumn(f"i{axis}", F.col("__p")).select(*self.axes, "v"), (*self.shape[:axis], n, *self.shape[axis + 1 :]), self.complete)

    def take_along_axis(self, axis: int, idx: Coo) -> Coo:
        """``idx`` holds, as values, positions along the axis."""
        others = [f"i{k}" for k in range(self.ndim) if k != axis]
        j = idx.filled().df.select(*(F.col(c).alias(f"j_{c}") for c in self.axes), F.col("v").cast("long").alias("__i"))
        on = reduce(lambda x, y: x & y, (F.col(c) == F.col(f"j_{c}") for c in others), F.col(f"i{axis}") == F.col("__i"))
        joined = j.join(self.df, on, "left")
        return Coo(joined.select(*(F.col(f"j_{c}").alias(c) for c in self.axes), F.coalesce("v", F.lit(0.0)).alias("v")), idx.shape, True)

    def scatter(self, updates: DataFrame, op: str = "add") -> Coo:
        """Updates (i0, ..., v) reduced into the array: add, mul, min, max, or put
        (an update replaces; of several at one place the greatest counts).
        Updates of one place are reduced before they meet the array."""
        f = {"add": F.sum, "mul": F.product, "min": F.min, "max": F.max, "put": F.max}[op]
        u = updates.groupBy(*self.axes).agg(f("v").alias("__u"))
        v, w = F.coalesce("v", F.lit(0.0)), F.col("__u")
        new = {"add": v + w, "mul": v * w, "min": F.least(v, w), "max": F.greatest(v, w), "put": w}[op]
        joined = self.df.join(u, self.axes, "full")
        return Coo(joined.select(*self.axes, F.when(w.isNull(), v).otherwise(new).alias("v")), self.shape, self.complete)

    def masked_fill(self, mask: Coo, value: float) -> Coo:
        return mask.where(self.full_like(value), self)

    def where(self, a: Coo, b: Coo) -> Coo:
        """a where this is not zero, else b."""
        joined = self.filled().df.withColumnRenamed("v", "__m").join(a.filled().df.withColumnRenamed("v", "__a"), self.axes).join(b.filled().df.withColumnRenamed("v", "__b"), self.axes)
        return Coo(joined.select(*self.axes, F.when(F.col("__m") != 0, F.col("__a")).otherwise(F.col("__b")).alias("v")), self.shape, True)

    def masked_select(self, mask: Coo) -> DataFrame:
        """(i0, ..., v) of the elements where the mask is not zero."""
        return self.filled().df.join(mask.df.where("v <> 0").select(*self.axes), self.axes)

    def nonzero(self) -> DataFrame:
        return self.df.where("v <> 0").select(*self.axes)

    # --- reductions ---

    def reduce(self, op: str, axes: Sequence[int] | None = None) -> DataFrame:
        """Over the given axes (all by default); absent elements count as zeros."""
        return self.reduce_many({"v": op}, axes)

    def reduce_many(self, ops: dict[str, str], axes: Sequence[int] | None = None) -> DataFrame:
        """Several reductions (name: operator) in one pass."""
        a = self if set(ops.values()) <= {"sum", "mean", "any", "count_nonzero", "norm", "nansum"} else self.filled()
        axes = range(a.ndim) if axes is None else axes
        kept = [f"i{k}" for k in range(a.ndim) if k not in axes]
        n, v = math.prod(a.shape[k] for k in axes), F.col("v")
        flat = _ravel(a.shape)
        number = F.when(~F.isnan(v), v)
        f = {
            "sum": F.sum(v), "prod": F.product(v), "min": F.min(v), "max": F.max(v), "ptp": F.max(v) - F.min(v), "mean": F.sum(v) / n, "variance": F.var_pop(v), "stddev": F.stddev_pop(v), "median": F.percentile(v, F.lit(0.5)),
            "all": F.bool_and(v != 0), "any": F.bool_or(v != 0), "count_nonzero": F.count_if(v != 0), "argmin": F.min_by(flat, F.struct(v, flat)), "argmax": F.min_by(flat, F.struct(-v, flat)), "norm": F.sqrt(F.sum(v * v)),
            "nansum": F.sum(number), "nanmean": F.avg(number), "nanmin": F.min(number), "nanmax": F.max(number), "nanvar": F.var_pop(number), "nanstd": F.stddev_pop(number), "nanmedian": F.percentile(number, F.lit(0.5)),
            "nanargmin": F.min_by(flat, F.when(~F.isnan(v), F.struct(v, flat))), "nanargmax": F.min_by(flat, F.when(~F.isnan(v), F.struct(-v, flat))),
        }
        aggregates = [f[op].alias(name) for name, op in ops.items()]
        return a.df.groupBy(*kept).agg(*aggregates) if kept else a.df.agg(*aggregates)

    def cumulative(self, op: str, axis: int) -> Coo:
        f = {"sum": F.sum, "prod": F.product, "min": F.min, "max": F.max}[op]
        w = Window.partitionBy(*(f"i{k}" for k in range(self.ndim) if k != axis)).orderBy(f"i{axis}").rowsBetween(Window.unboundedPreceding, 0)
        return Coo(self.filled().df.withColumn("v", f("v").over(w)), self.shape, True)

    def softmax(self, axis: int) -> Coo:
        w = Window.partitionBy(*(f"i{k}" for k in range(self.ndim) if k != axis))
        e = self.filled().df.withColumn("v", F.exp(F.col("v") - F.max("v").over(w)))
        return Coo(e.withColumn("v", F.col("v") / F.sum("v").over(w)), self.shape, True)

    # --- products ---

    def matmul(self, other: Coo) -> Coo:
        return einsum("ij,jk->ik", self, other)

    def bmm(self, other: Coo) -> Coo:
        return einsum("bij,bjk->bik", self, other)

    def matmul_add(self, other: Coo, c: Coo) -> Coo:
        return self.matmul(other).binary(c, "add")

    def tensordot(self, other: Coo, axes: int = 2) -> Coo:
        """The last ``axes`` axes of this with the first of the other."""
        letters = "abcdefghijklmnopqrstuvwxyz"
        left = letters[: self.ndim]
        right = left[self.ndim - axes :] + letters[self.ndim : self.ndim + other.ndim - axes]
        return einsum(f"{left},{right}->{left[: self.ndim - axes]}{right[axes:]}", self, other)

    def contract(self, other: Coo, own: Sequence[int], its: Sequence[int]) -> Coo:
        """Sums over pairs of axes."""
        letters = "abcdefghijklmnopqrstuvwxyz"
        left = letters[: self.ndim]
        fresh = iter(letters[self.ndim :])
        right = "".join(left[own[list(its).index(k)]] if k in its else next(fresh) for k in range(other.ndim))
        out = "".join(c for k, c in enumerate(left) if k not in own) + "".join(c for k, c in enumerate(right) if k not in its)
        return einsum(f"{left},{right}->{out}", self, other)

    def outer(self, other: Coo) -> Coo:
        return einsum("i,j->ij", self, other)


def _ravel(shape: Sequence[int]) -> Column:
    out = F.lit(0).cast("long")
    for k, n in enumerate(shape):
        out = out * n + F.col(f"i{k}")
    return out


def _unravel(df: DataFrame, flat: str, shape: Sequence[int]) -> DataFrame:
    step, cols = math.prod(shape), {}
    for k, n in enumerate(shape):
        step //= max(n, 1)
        cols[f"i{k}"] = F.pmod(F.floor(F.col(flat) / step), F.lit(max(n, 1))).cast("long")
    return df.withColumns(cols)


def einsum(spec: str, a: Coo, b: Coo) -> Coo:
    """Two operands: labels of both join, labels not in the result are summed."""
    inputs, out = spec.replace(" ", "").split("->")
    la, lb = inputs.split(",")
    if len(la) != a.ndim or len(lb) != b.ndim or len(set(la)) < len(la) or len(set(lb)) < len(lb):
        raise ValueError("labels do not fit the operands")
    sizes = dict(zip(la, a.shape, strict=True))
    for c, n in zip(lb, b.shape, strict=True):
        if sizes.setdefault(c, n) != n:
            raise ValueError(f"axis {c} has two lengths")
    x = a.df.select(*(F.col(f"i{k}").alias(f"a_{c}") for k, c in enumerate(la)), F.col("v").alias("av"))
    y = b.df.select(*(F.col(f"i{k}").alias(f"b_{c}") for k, c in enumerate(lb)), F.col("v").alias("bv"))
    both = [c for c in la if c in lb]
    on = reduce(lambda p, q: p & q, (F.col(f"a_{c}") == F.col(f"b_{c}") for c in both)) if both else None
    joined = x.join(y, on) if both else x.crossJoin(y)  # an outer product is the result's own size
    keys = [F.col(f"a_{c}" if c in la else f"b_{c}").alias(f"i{k}") for k, c in enumerate(out)]
    product = (F.col("av") * F.col("bv")).alias("v")
    if set(out) == set(la) | set(lb):
        return Coo(joined.select(*keys, product), tuple(sizes[c] for c in out))
    df = joined.select(*keys, product)
    df = df.groupBy(*(f"i{k}" for k in range(len(out)))).agg(F.sum("v").alias("v")) if out else df.agg(F.sum("v").alias("v"))
    return Coo(df, tuple(sizes[c] for c in out))
