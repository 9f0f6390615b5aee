"""Series, statistics, searches and random columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.expressions import NAN, ieee_div, nz


class Series:
    """A named column of a table with an order."""

    def __init__(self, df: DataFrame, name: str, order: str):
        self.df, self.name, self.order = df.select(order, name), name, order

    def _one(self, agg: Column):
        return self.df.agg(agg).first()[0]

    def sum(self):
        return self._one(F.coalesce(F.sum(self.name), F.lit(0)))

    def mean(self) -> float:
        return self._one(F.coalesce(F.avg(self.name), F.lit(NAN)))

    def min(self):
        return self._one(F.min(self.name))

    def max(self):
        return self._one(F.max(self.name))

    def _with(self, c: Column) -> Series:
        return Series(self.df.withColumn(self.name, c), self.name, self.order)

    def add_scalar(self, s: float) -> Series:
        return self._with(F.col(self.name) + s)

    def sub_scalar(self, s: float) -> Series:
        return self._with(F.col(self.name) - s)

    def mul_scalar(self, s: float) -> Series:
        return self._with(F.col(self.name) * s)

    def div_scalar(self, s: float) -> Series:
        return self._with(ieee_div(F.col(self.name).cast("double"), F.lit(float(s))))

    def filter(self, predicate: Column) -> Series:
        return Series(self.df.where(predicate), self.name, self.order)

    def get(self, i: int):
        """The value at position ``i`` in order; negative counts from the end."""
        rows = (self.head(i + 1) if i >= 0 else self.tail(-i)).collect()
        if len(rows) < (i + 1 if i >= 0 else -i):
            raise IndexError(i)
        return rows[-1][self.name]

    def set(self, key: object, value: object) -> Series:
        """The value where the order column is ``key``."""
        kind = self.df.schema[self.name].dataType
        return self._with(F.when(F.col(self.order) == F.lit(key), F.lit(value).cast(kind)).otherwise(F.col(self.name)))

    def clone(self) -> Series:
        return self

    def print(self, rows: int = 20) -> None:
        self.head(rows).show(rows, truncate=False)

    def to_array(self) -> list:
        """All values in order, on the driver."""
        return [r[self.name] for r in self.df.orderBy(self.order).collect()]

    def sort(self, descending: bool = False) -> DataFrame:
        c = F.col(self.name)
        return self.df.orderBy(c.desc() if descending else c.asc(), self.order)

    def head(self, n: int) -> DataFrame:
        return self.df.orderBy(self.order).limit(n)

    def tail(self, n: int) -> DataFrame:
        return self.df.orderBy(F.col(self.order).desc()).limit(n)


def _with_statistics(df: DataFrame, by: Sequence[str], aggregates: dict[str, Column]) -> DataFrame:
    """Statistics beside every row: windows by group; without groups one
    aggregated row, so that no task holds all rows."""
    if by:
        w = Window.partitionBy(*by)
        return df.withColumns({k: c.over(w) for k, c in aggregates.items()})
    return df.crossJoin(F.broadcast(df.agg(*(c.alias(k) for k, c in aggregates.items()))))


def zscore(df: DataFrame, x: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    v = F.col(x).cast("double")
    df = _with_statistics(df, by, {"__m": F.avg(v), "__s": F.stddev_pop(v), "__lo": F.min(v), "__hi": F.max(v)})
    sd = F.when(F.col("__lo") == F.col("__hi"), F.lit(0.0)).otherwise(F.col("__s"))
    return df.withColumn(out, nz(v - F.col("__m"), sd)).drop("__m", "__s", "__lo", "__hi")


def normalize(df: DataFrame, x: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    v = F.col(x).cast("double")
    df = _with_statistics(df, by, {"__lo": F.min(v), "__hi": F.max(v)})
    return df.withColumn(out, nz(v - F.col("__lo"), F.col("__hi") - F.col("__lo"))).drop("__lo", "__hi")


def pearsonr(df: DataFrame, x: str, y: str, out: str = "r", by: Sequence[str] = ()) -> DataFrame:
    d = df.dropna(subset=[x, y]).select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    s = d.groupBy(*by).agg(F.count("*").alias("n"), *(F.sum(e).alias(k) for k, e in (("sx", F.col("x")), ("sy", F.col("y")), ("xx", F.col("x") * F.col("x")), ("yy", F.col("y") * F.col("y")), ("xy", F.col("x") * F.col("y")))))
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    spread = (n * F.col("xx") - sx * sx) * (n * F.col("yy") - sy * sy)
    return s.select(*by, nz(n * F.col("xy") - sx * sy, F.sqrt(F.greatest(spread, F.lit(0.0)))).alias(out))


def weighted(df: DataFrame, x: str, w: str, by: Sequence[str] = ()) -> DataFrame:
    """Weighted mean, variance and standard deviation (of all, not a sample)."""
    a, b = F.col(x).cast("double"), F.col(w).cast("double")
    s = df.dropna(subset=[x, w]).groupBy(*by).agg(F.sum(b).alias("sw"), F.sum(a * b).alias("sx"), F.sum(a * a * b).alias("xx"))
    m = nz(F.col("sx"), F.col("sw"))
    v = F.greatest(nz(F.col("xx"), F.col("sw")) - m * m, F.lit(0.0))
    return s.select(*by, m.alias("weighted_mean"), v.alias("weighted_variance"), F.sqrt(v).alias("weighted_stddev"))


def covariance(df: DataFrame, x: str, y: str, by: Sequence[str] = (), ddof: int = 1) -> DataFrame:
    """``cov`` and ``corr`` of pairs that are both there; NaN where undefined."""
    a, b = F.col("x"), F.col("y")
    d = df.dropna(subset=[x, y]).select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    s = d.groupBy(*by).agg(F.count("*").alias("n"), F.covar_pop(a, b).alias("c"), F.var_pop(a).alias("vx"), F.var_pop(b).alias("vy"))
    n = F.col("n")
    return s.select(*by, nz(F.col("c") * n, F.greatest(n - ddof, F.lit(0))).alias("cov"), nz(F.col("c"), F.sqrt(F.col("vx") * F.col("vy"))).alias("corr"))


def weighted_quantile(df: DataFrame, x: str, w: str, q: float, out: str, by: Sequence[str] = ()) -> DataFrame:
    """The least x at which the cumulative weight reaches the share ``q``; rows
    without a positive weight do not count. Equal values are summed before the
    cumulative weights, so a group's window has its different values."""
    a, b = F.col(x).cast("double"), F.col(w).cast("double")
    d = df.where(a.isNotNull() & (b > 0)).groupBy(*by, a.alias("__x")).agg(F.sum(b).alias("__w"))
    up = Window.partitionBy(*by).orderBy("__x")
    d = d.withColumns({"__c": F.sum("__w").over(up), "__t": F.sum("__w").over(Window.partitionBy(*by))})
    return d.where(F.col("__c") >= F.lit(float(q)) * F.col("__t")).groupBy(*by).agg(F.min("__x").alias(out))


def weighted_median(df: DataFrame, x: str, w: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    return weighted_quantile(df, x, w, 0.5, out, by)


def unique_with_counts(df: DataFrame, x: str) -> DataFrame:
    return df.groupBy(F.col(x).alias("value")).agg(F.count("*").alias("count"))


def bincount(df: DataFrame, x: str, n: int, weight: str | None = None) -> DataFrame:
    """Occurrences (or weights) of 0 .. n - 1."""
    part = df.groupBy(F.col(x).cast("long").alias("bin")).agg((F.sum(weight) if weight else F.count("*")).alias("c"))
    return df.sparkSession.range(n).select(F.col("id").alias("bin")).join(part, "bin", "left").select("bin", F.coalesce("c", F.lit(0)).alias("count"))


def searchsorted(x: Column, edges: Sequence[float], side: str = "left") -> Column:
    """Where x would be put into the sorted edges."""
    a = F.array(*(F.lit(float(e)) for e in edges))
    return F.size(F.filter(a, (lambda e: e < x) if side == "left" else (lambda e: e <= x))).cast("long")


def histogram(df: DataFrame, x: str, low: float, high: float, bins: int) -> DataFrame:
    v = F.col(x).cast("double")
    slot = F.least(F.floor((v - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("long")
    return bincount(df.where((v >= low) & (v <= high)).select(slot.alias("__b")), "__b", bins)


#: Random columns by inverse distribution functions of ``rand(seed)``.
RANDOM = {
    "uniform": lambda s, lo=0.0, hi=1.0: lo + (hi - lo) * F.rand(s), "normal": lambda s, m=0.0, d=1.0: m + d * F.randn(s), "bernoulli": lambda s, p=0.5: F.rand(s) < p, "randint": lambda s, lo=0, hi=10: F.floor(lo + (hi - lo) * F.rand(s)).cast("long"),
    "exponential": lambda s, rate=1.0: -F.log(1 - F.rand(s)) / rate, "lognormal": lambda s, m=0.0, d=1.0: F.exp(m + d * F.randn(s)), "cauchy": lambda s, m=0.0, d=1.0: m + d * F.tan(math.pi * (F.rand(s) - 0.5)), "logistic": lambda s, m=0.0, d=1.0: m + d * (F.log(F.rand(s)) - F.log(1 - F.rand(s))),
    "weibull": lambda s, k=1.0, lam=1.0: lam * F.pow(-F.log(1 - F.rand(s)), F.lit(1 / k)), "pareto": lambda s, a=1.0, m=1.0: m / F.pow(1 - F.rand(s), F.lit(1 / a)), "gumbel": lambda s, m=0.0, d=1.0: m - d * F.log(-F.log(1 - F.rand(s))), "frechet": lambda s, a=1.0: F.pow(-F.log(1 - F.rand(s)), F.lit(-1 / a)),
    "rayleigh": lambda s, d=1.0: d * F.sqrt(-2 * F.log(1 - F.rand(s))), "arcsine": lambda s: F.pow(F.sin(F.rand(s) * (math.pi / 2)), F.lit(2.0)), "kumaraswamy": lambda s, a=1.0, b=1.0: F.pow(1 - F.pow(1 - F.rand(s), F.lit(1 / b)), F.lit(1 / a)), "power_function": lambda s, a=1.0: F.pow(F.rand(s), F.lit(1 / a)),
    "half_normal": lambda s, d=1.0: F.abs(F.randn(s)) * d, "laplace": lambda s, m=0.0, d=1.0: m - d * F.log(1 - F.rand(s)) * F.when(F.rand(s + 1) < 0.5, -1.0).otherwise(1.0), "log_logistic": lambda s, a=1.0, b=1.0: a * F.pow(F.rand(s) / (1 - F.rand(s)), F.lit(1 / b)),
}
