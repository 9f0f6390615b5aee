"""Array, sparse and linear-algebra operators over embeddings and lineitem."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import series
from tessera.operators.arrays import BINARY, LOSSES, UNARY, Coo, einsum, vec
from tessera.operators.linalg import gram, least_squares, per_group, per_group_with
from tessera.operators.sparse import Sparse

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
D = 5


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _vectors(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("a"), F.reverse("embedding").cast("array<double>").alias("b"))


_V = "(select vec_id, label, embedding::double[] as a, list_reverse(embedding)::double[] as b from embeddings)"


def _r(c):
    return F.round(c, D)


_SQL_UNARY = {
    "neg": "-x", "abs": "abs(x)", "square": "x * x", "sign": "sign(x)", "exp": "exp(x)", "exp2": "power(2, x)", "log": "case when x > 0 then ln(x) else 0 end", "sqrt": "case when x >= 0 then sqrt(x) else 0 end", "cbrt": "cbrt(x)", "floor": "floor(x)", "ceil": "ceil(x)",
    "sin": "sin(x)", "cos": "cos(x)", "tan": "tan(x)", "atan": "atan(x)", "sinh": "sinh(x)", "cosh": "cosh(x)", "tanh": "tanh(x)", "asinh": "asinh(x)", "deg2rad": "radians(x)", "rad2deg": "degrees(x)", "expit": "1 / (1 + exp(-x))",
    "relu": "greatest(x, 0)", "leaky_relu": "case when x >= 0 then x else x * 0.01 end", "elu": "case when x > 0 then x else exp(x) - 1 end", "sigmoid": "1 / (1 + exp(-x))", "silu": "x / (1 + exp(-x))", "softplus": "ln(1 + exp(x))", "softsign": "x / (1 + abs(x))", "hardtanh": "least(greatest(x, -1), 1)",
    "gelu": "0.5 * x * (1 + tanh(sqrt(2 / pi()) * (x + 0.044715 * x * x * x)))", "mish": "x * tanh(ln(1 + exp(x)))", "hardswish": "x * least(greatest(x / 6 + 0.5, 0), 1)", "tanhshrink": "x - tanh(x)",
}
_MASKED = {"log", "sqrt"}


@query(f"select vec_id, {', '.join(f'round(list_sum(list_transform(a, lambda x: {e})), {D}) as {k}' for k, e in _SQL_UNARY.items())} from {_V}")
def array_unary(spark, sf_dir):
    def one(k: str):
        value = lambda x: UNARY[k](x).cast("double")
        return F.transform("a", (lambda x: F.nanvl(value(x), F.lit(0.0))) if k in _MASKED else value)

    return _vectors(spark, sf_dir).select("vec_id", *(_r(vec.sum(one(k))).alias(k) for k in _SQL_UNARY))


_SQL_BINARY = {"add": "x + y", "sub": "x - y", "mul": "x * y", "maximum": "greatest(x, y)", "minimum": "least(x, y)", "hypot": "sqrt(x * x + y * y)", "atan2": "atan2(x, y)", "log_add_exp": "greatest(x, y) + ln(1 + exp(-abs(x - y)))", "gt": "case when x > y then 1 else 0 end", "le": "case when x <= y then 1 else 0 end", "copysign": "case when y < 0 then -abs(x) else abs(x) end"}


@query(f"select vec_id, {', '.join(f'round((select sum({e}) from (select unnest(a) as x, unnest(b) as y)), {D}) as f_{k}' for k, e in _SQL_BINARY.items())} from {_V}")
def array_binary(spark, sf_dir):
    one = lambda k: F.zip_with("a", "b", lambda x, y: BINARY[k](x, y).cast("double"))
    return _vectors(spark, sf_dir).select("vec_id", *(_r(vec.sum(one(k))).alias(f"f_{k}") for k in _SQL_BINARY))


@query(f"""select vec_id, round(list_sum(a), {D}) as s, round(list_avg(a), {D}) as m, round(list_var_pop(a), {D}) as v, list_min(a) as lo, list_max(a) as hi, round(list_median(a), {D}) as md, round(quantile_cont, {D}) as q,
list_position(a, list_max(a)) - 1 as at, list_position(a, list_min(a)) - 1 as am, round(sqrt(list_sum(list_transform(a, lambda x: x * x))), {D}) as n2, round(list_sum(list_transform(a, lambda x: abs(x))), {D}) as n1, list_max(list_transform(a, lambda x: abs(x))) as ni
from (select *, list_aggregate(a, 'quantile_cont', 0.3) as quantile_cont from {_V})""")
def array_reductions(spark, sf_dir):
    a = F.col("a")
    return _vectors(spark, sf_dir).select(
        "vec_id", _r(vec.sum(a)).alias("s"), _r(vec.mean(a)).alias("m"), _r(vec.variance(a)).alias("v"), F.array_min(a).alias("lo"), F.array_max(a).alias("hi"), _r(vec.median(a)).alias("md"), _r(vec.quantile(a, 0.3)).alias("q"),
        vec.argmax(a).cast("long").alias("at"), vec.argmin(a).cast("long").alias("am"), _r(vec.norm(a)).alias("n2"), _r(vec.norm(a, 1)).alias("n1"), vec.norm(a, float("inf")).alias("ni"),
    )


@query(f"""select vec_id, round(list_sum(list_transform(list_zip(a, b), lambda t: t[1] * t[2])), {D}) as d, round(list_cosine_similarity(a, b), {D}) as c, round(list_distance(a, b), {D}) as l from {_V}""")
def array_similarity(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", _r(vec.dot(F.col("a"), F.col("b"))).alias("d"), _r(vec.cosine_similarity(F.col("a"), F.col("b"))).alias("c"), _r(vec.pairwise_distance(F.col("a"), F.col("b"))).alias("l"))


@query(f"""with s as (select vec_id, a, list_max(a) as m from {_V}), e as (select vec_id, list_transform(a, lambda x: exp(x - m)) as e, m, a from s)
select vec_id, round(e[1] / list_sum(e), 7) as p0, round(m + ln(list_sum(e)), {D}) as z, round(a[2] - (m + ln(list_sum(e))), {D}) as l1 from e""")
def array_softmax(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", F.round(vec.softmax(F.col("a"))[0], 7).alias("p0"), _r(vec.logsumexp(F.col("a"))).alias("z"), _r(vec.log_softmax(F.col("a"))[1]).alias("l1"))


@query(f"""select vec_id, list_sort(a)[1:3] as s, list_reverse_sort(a)[1:2] as t, list_grade_up(a)[1] - 1 as g, round(list_sum(a[1:10]), {D}) as c9, round(a[5] - a[4], {D}) as d3, [a[1], a[64], a[2]] as tk, a[63] as r1 from {_V}""")
def array_order(spark, sf_dir):
    a = F.col("a")
    return _vectors(spark, sf_dir).select(
        "vec_id", F.slice(vec.sort(a), 1, 3).alias("s"), vec.topk(a, 2).alias("t"), vec.argsort(a)[0].cast("long").alias("g"), _r(vec.cumsum(a)[9]).alias("c9"), _r(vec.diff(a)[3]).alias("d3"), vec.take(a, [0, -1, 1]).alias("tk"), vec.roll(a, 2)[0].alias("r1")
    )


@query(f"""with s as (select vec_id, list_transform(a[1:32], lambda x: floor(x * 4)::bigint) as a, list_transform(a[33:64], lambda x: floor(x * 4)::bigint) as b from {_V})
select vec_id, list_sort(list_distinct(a)) as u, list_sort(list_distinct(list_concat(a, b))) as un, list_sort(list_distinct(list_intersect(a, b))) as i, list_sort(list_distinct(list_filter(a, lambda x: not list_contains(b, x)))) as d,
len(list_filter(a, lambda x: list_contains(b, x))) as n from s""")
def array_sets(spark, sf_dir):
    cut = lambda k: F.transform(F.slice("a", k, 32), lambda x: F.floor(x * 4))
    df = _vectors(spark, sf_dir).select("vec_id", cut(1).alias("p"), cut(33).alias("q"))
    p, q = F.col("p"), F.col("q")
    return df.select("vec_id", vec.unique(p).alias("u"), vec.union1d(p, q).alias("un"), vec.intersect1d(p, q).alias("i"), vec.setdiff1d(p, q).alias("d"), F.size(F.filter(vec.isin(p, q), lambda x: x)).cast("long").alias("n"))


@query(f"select vec_id, round(0.5 * a[1], {D}) as f0, round(0.5 * a[3] + 0.25 * a[2] - a[1], {D}) as f2, round(-a[64], {D}) as fl, 66 as n from {_V}")
def array_convolve(spark, sf_dir):
    c = vec.convolve(F.col("a"), [0.5, 0.25, -1.0])
    return _vectors(spark, sf_dir).select("vec_id", c.alias("c")).select("vec_id", _r(F.col("c")[0]).alias("f0"), _r(F.col("c")[2]).alias("f2"), _r(F.col("c")[65]).alias("fl"), F.size("c").alias("n"))


_SQL_LOSS = {"mse": "(p - t) * (p - t)", "l1": "abs(p - t)", "smooth_l1": "case when abs(p - t) < 1 then 0.5 * (p - t) * (p - t) else abs(p - t) - 0.5 end", "bce_with_logits": "greatest(p, 0) - p * t + ln(1 + exp(-abs(p)))", "hinge": "greatest(1 - p * t, 0)", "soft_margin": "ln(1 + exp(-p * t))", "poisson_nll": "exp(p) - t * p"}


@query(f"select user_id, {', '.join(f'round(avg({e}), 9) as {k}' for k, e in _SQL_LOSS.items())} from (select user_id, round(value) / 100 as p, (event_id % 2)::double as t from events) group by all")
def losses(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("user_id", "round(value) / 100 as p", "cast(event_id % 2 as double) as t")
    return df.groupBy("user_id").agg(*(F.round(F.avg(LOSSES[k](F.col("p"), F.col("t"))), 9).alias(k) for k in _SQL_LOSS))


# --- coordinate arrays: (vec_id, dimension) of the vectors ---

_M = "(select vec_id as i0, unnest(range(64)) as i1, unnest(embedding)::double as v from embeddings)"


def _matrix(spark, sf_dir) -> Coo:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    n = e.agg(F.coalesce(F.max("vec_id") + 1, F.lit(0))).first()[0]
    return Coo(e.select(F.col("vec_id").alias("i0"), F.posexplode("embedding").alias("i1", "v")).select("i0", F.col("i1").cast("long").alias("i1"), F.col("v").cast("double").alias("v")), (n, 64), True)


@query(f"select a.i1 as i0, b.i1 as i1, round(sum(a.v * b.v), {D}) as v from {_M} a join {_M} b on a.i0 = b.i0 group by all")
def coo_matmul(spark, sf_dir):
    m = _matrix(spark, sf_dir)
    return m.transpose().matmul(m).df.select("i0", "i1", _r("v").alias("v"))


@query(f"select a.i0 as i0, round(sum(a.v * b.v), {D}) as v from {_M} a join {_M} b on a.i0 = b.i0 and a.i1 = b.i1 group by all")
def einsum_rowwise(spark, sf_dir):
    m = _matrix(spark, sf_dir)
    return einsum("ij,ij->i", m, m).df.select("i0", _r("v").alias("v"))


@query(f"select (i0 * 64 + i1) // 320 as i0, (i0 * 64 + i1) % 320 as i1, v from (select (select max(vec_id) from embeddings) - i0 as i0, (i1 + 3) % 64 as i1, v from {_M})")
def coo_transforms(spark, sf_dir):
    m = _matrix(spark, sf_dir)
    # rows of 320 hold five of 64: the last one is filled up, so any count will do
    return m.flip(0).roll(3, 1).pad(0, 0, -m.shape[0] % 5).reshape((-1, 320)).df.select("i0", "i1", "v")


@query(f"select i0 - 10 as i0, i1, v from {_M} where i0 >= 10 and i0 < 60 and i1 - (i0 - 10) >= 2")
def coo_narrow_triu(spark, sf_dir):
    return _matrix(spark, sf_dir).narrow(0, 10, 50).triu(2).df.select("i0", "i1", "v")


@query(f"select i1, round(sum(v), {D}) as s, round(avg(v), {D}) as m, min(v) as lo, max(v) as hi, arg_min(i0 * 64 + i1, v) as am, round(sqrt(sum(v * v)), {D}) as n from {_M} group by i1")
def coo_reductions(spark, sf_dir):
    out = _matrix(spark, sf_dir).reduce_many({"s": "sum", "m": "mean", "lo": "min", "hi": "max", "am": "argmin", "n": "norm"}, [0])
    return out.withColumns({c: _r(c) for c in ("s", "m", "n")})


@query(f"select i0, i1, round(sum(v) over (partition by i0 order by i1 rows unbounded preceding), {D}) as c, round(exp(v - max(v) over (partition by i0)) / sum(exp(v - m)) over (partition by i0), 7) as p from (select *, max(v) over (partition by i0) as m from {_M})")
def coo_cumulative_softmax(spark, sf_dir):
    m = _matrix(spark, sf_dir)
    c = m.cumulative("sum", 1).df.select("i0", "i1", _r("v").alias("c"))
    return c.join(m.softmax(1).df.select("i0", "i1", F.round("v", 7).alias("p")), ["i0", "i1"])


@query(f"with b as (select i1, avg(v) as v from {_M} group by i1) select a.i0, a.i1, round(a.v - b.v, {D}) as v from {_M} a join b using (i1)")
def coo_broadcast(spark, sf_dir):
    m = _matrix(spark, sf_dir)
    mean = Coo(m.reduce("mean", [0]).select(F.lit(0).cast("long").alias("i0"), "i1", "v"), (1, 64), True)
    return m.binary(mean, "sub").df.select("i0", "i1", _r("v").alias("v"))


@query(f"""select i1, round(min(w), {D}) as lo, round(max(w), {D}) as hi, round(var_pop(w), {D}) as va, round(sum(exp(w)), {D}) as e from (select i0, i1, case when i1 - i0 >= 3 then v else 0 end as w from {_M}) group by i1""")
def coo_absent_elements(spark, sf_dir):
    """Elements that a triangle leaves out count as zeros."""
    t = _matrix(spark, sf_dir).triu(3)
    out = t.reduce_many({"lo": "min", "hi": "max", "va": "variance"}, [0]).join(t.map("exp").reduce("sum", [0]).withColumnRenamed("v", "e"), "i1")
    return out.select("i1", *(_r(c).alias(c) for c in ("lo", "hi", "va", "e")))


@query(f"""with u as (select i0 % 7 as i0, i1, sum(v) as u from {_M} where i0 % 3 = 1 group by all), g as (select i0, 63 - i1 as i1, v from {_M} where i1 % 2 = 1)
select m.i0, m.i1, round(m.v + coalesce(u, 0), {D}) as s, g.v as g, case when m.v > 0 then -1.0::double else m.v end as f, case when m.v > 0 then m.v else -m.v end as w, t.v as t
from {_M} m left join u using (i0, i1) left join g using (i0, i1) join {_M} t on t.i0 = m.i0 and t.i1 = (m.i1 * 5 + m.i0) % 64""")
def coo_indexing(spark, sf_dir):
    """Scatter, gather, masked fill, where and take along an axis."""
    m = _matrix(spark, sf_dir)
    scattered = m.scatter(m.df.where("i0 % 3 = 1").selectExpr("i0 % 7 as i0", "i1", "v"))
    odd = spark.range(32).selectExpr("62 - 2 * id as at", "2 * id + 1 as index")
    mask = Coo(m.df.withColumn("v", (F.col("v") > 0).cast("double")), m.shape, True)
    along = Coo(m.df.withColumn("v", ((F.col("i1") * 5 + F.col("i0")) % 64).cast("double")), m.shape, True)
    parts = {"s": scattered, "f": m.masked_fill(mask, -1.0), "w": mask.where(m, m.scalar("mul", -1.0)), "t": m.take_along_axis(1, along)}
    out = m.gather(1, odd).df.withColumnRenamed("v", "g")
    for name, part in parts.items():
        out = part.df.withColumnRenamed("v", name).join(out, ["i0", "i1"], "left")
    return out.withColumn("s", _r("s")).select("i0", "i1", "s", "g", "f", "w", "t")


@query(f"""select i0 % 5 as b, a.i1 as i, c.i1 as j, round(sum(a.v * c.v), 4) as v from {_M} a join {_M} c using (i0) group by all""")
def coo_batched_products(spark, sf_dir):
    """A batch of tall blocks, each with itself; the blocks are rows by number."""
    m = _matrix(spark, sf_dir)
    n = -(-m.shape[0] // 5)
    blocks = Coo(m.df.select((F.col("i0") % 5).alias("i0"), F.floor(F.col("i0") / 5).cast("long").alias("i1"), F.col("i1").alias("i2"), "v"), (5, n, 64))
    return blocks.transpose([0, 2, 1]).bmm(blocks).df.select(F.col("i0").alias("b"), F.col("i1").alias("i"), F.col("i2").alias("j"), F.round("v", 4).alias("v"))


@query(f"select i0 * 2 + j as i0, i1, v from {_M}, range(2) t(j)")
def coo_repeat(spark, sf_dir):
    return _matrix(spark, sf_dir).repeat(2, 0).df.select("i0", "i1", "v")


@query(f"select 63 - i1 as i0, i0 as i1, v from {_M}")
def coo_rot90(spark, sf_dir):
    return _matrix(spark, sf_dir).rot90().df.select("i0", "i1", "v")


@query(f"select i0, k as i1, i1 as i2, case when k = 0 then v else -v end as v from {_M}, range(2) t(k)")
def coo_stack(spark, sf_dir):
    m = _matrix(spark, sf_dir)
    return m.stack(m.map("neg"), 1).df.select("i0", "i1", "i2", "v")


# --- rows: indexing, losses and statistics of vectors ---

@query(f"""select vec_id, round(list_sum(list_transform(range(64), lambda i: (i + 1) * a[(i * 5) % 64 + 1])), {D}) as g, round(list_sum(list_transform(range(64), lambda i: (i + 1) * case when i = 3 then 9 when i = 60 then 8 else a[i + 1] end)), {D}) as p,
round(list_sum(list_transform(range(64), lambda i: (i + 1) * (a[i + 1] + case when i = 3 then 3 when i = 60 then 4 else 0 end))), {D}) as sa, round(list_sum(list_transform(a, lambda x: case when x < 0 then 0.5 else x end)), {D}) as mf, round(list_sum(list_transform(range(64), lambda i: (i + 1) * case when a[i + 1] > 0 then a[i + 1] else b[i + 1] end)), {D}) as w,
round((a[64] - a[63]) + (a[2] - a[1]) * 2 + (a[33] - a[31]) / 2, {D}) as gr, round(list_sum(a) - (a[1] + a[64]) / 2, {D}) as tr, a[1] as r0, a[2] as r3, a[33] as h0 from {_V}""")
def array_indexing(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    at = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i * 5 % 64)
    ints, nums = (lambda *x: F.array(*(F.lit(i) for i in x))), (lambda *x: F.array(*(F.lit(float(i)) for i in x)))
    weighted = lambda c: _r(vec.sum(F.transform(c, lambda x, i: (i + 1) * x)))
    grad = F.col("grad")
    df = _vectors(spark, sf_dir).withColumn("grad", vec.gradient(a))
    return df.select(
        "vec_id", weighted(vec.gather(a, at)).alias("g"), weighted(vec.put(a, ints(3, 60, 3), nums(7, 8, 9))).alias("p"), weighted(vec.scatter_add(a, ints(3, 60, 3), nums(1, 4, 2))).alias("sa"),
        _r(vec.sum(vec.masked_fill(a, F.transform(a, lambda x: x < 0), 0.5))).alias("mf"), weighted(vec.where(F.transform(a, lambda x: x > 0), a, b)).alias("w"),
        _r(grad[63] + grad[0] * 2 + grad[31]).alias("gr"), _r(vec.trapezoid(a)).alias("tr"), vec.repeat(a, 3)[2].alias("r0"), vec.repeat(a, 3)[3].alias("r3"), vec.split(a, 2)[1][0].alias("h0"),
    )


_C = "(vec_id % 64)"


@query(f"""with s as (select vec_id, a, b, list_max(a) as m, {_C} as c from {_V}), t as (select *, m + ln(list_sum(list_transform(a, lambda x: exp(x - m)))) as z, list_reduce(list_transform(range(64), lambda i: a[i + 1] * b[i + 1]), lambda x, y: x + y) / (list_reduce(list_transform(a, lambda x: x * x), lambda x, y: x + y)) as cs from s)
select vec_id, round(z - a[c + 1], {D}) as ce, round(case when c % 2 = 0 then 1 - cs else greatest(cs - 0.1, 0) end, {D}) as emb, round(greatest(sqrt(list_sum(list_transform(range(64), lambda i: power(a[i + 1] - b[i + 1], 2)))) - 0 + 1, 0), {D}) as tri,
round(list_sum(list_transform(range(64), lambda i: case when i = c then 0 else greatest(1 - a[c + 1] + a[i + 1], 0) end)) / 64, {D}) as mm, round(a[1] / (1 + exp(-a[33])), {D}) as g0 from t""")
def array_losses(spark, sf_dir):
    a, b, c = F.col("a"), F.col("b"), F.col("vec_id") % 64
    t = F.when(c % 2 == 0, 1).otherwise(-1)
    return _vectors(spark, sf_dir).select(
        "vec_id", _r(vec.cross_entropy(a, c)).alias("ce"), _r(vec.cosine_embedding(a, b, t, 0.1)).alias("emb"), _r(vec.triplet(a, b, a)).alias("tri"), _r(vec.multi_margin(a, c)).alias("mm"), _r(vec.glu(a)[0]).alias("g0")
    )


@query(f"""with s as (select vec_id, list_transform(range(64), lambda i: case when (i + vec_id) % 5 = 0 then 'NaN'::double else a[i + 1] end) as a from {_V}), n as (select vec_id, a, list_filter(a, lambda x: not isnan(x)) as f from s)
select vec_id, round(list_sum(f), {D}) as s, round(list_avg(f), {D}) as m, round(list_var_pop(f), {D}) as v, round(list_stddev_pop(f), {D}) as sd, list_min(f) as lo, list_max(f) as hi, round(list_median(f), {D}) as md, round(list_aggregate(f, 'quantile_cont', 0.3), {D}) as q, list_position(a, list_max(f)) - 1 as am from n""")
def array_nan_reductions(spark, sf_dir):
    gap = F.transform("a", lambda x, i: F.when((i + F.col("vec_id")) % 5 == 0, F.lit(float("nan"))).otherwise(x))
    df = _vectors(spark, sf_dir).select("vec_id", gap.alias("a"))
    r = lambda op, **k: _r(vec.nan_reduce(F.col("a"), op, **k))
    return df.select("vec_id", r("sum").alias("s"), r("mean").alias("m"), r("variance").alias("v"), r("stddev").alias("sd"), vec.nan_reduce(F.col("a"), "min").alias("lo"), vec.nan_reduce(F.col("a"), "max").alias("hi"), r("median").alias("md"), r("quantile", q=0.3).alias("q"), vec.nan_reduce(F.col("a"), "argmax").cast("long").alias("am"))


@query(f"""select vec_id, k, round(sum(x * cos(2 * pi() * k * i / 64)), 4) as re, round(-sum(x * sin(2 * pi() * k * i / 64)), 4) as im from (select vec_id, unnest(range(64)) as i, unnest(a) as x from {_V}), range(33) t(k) group by all""")
def array_rfft(spark, sf_dir):
    f = _vectors(spark, sf_dir).select("vec_id", F.posexplode(vec.rfft(F.col("a"))).alias("k", "c"))
    return f.select("vec_id", F.col("k").cast("long").alias("k"), F.round(F.col("c.re") + 0.0, 4).alias("re"), F.round(F.col("c.im") + 0.0, 4).alias("im"))


# --- sparse: customers by nation-like columns, values from orders ---

_SP = "(select o_custkey % 150 as row, o_orderkey % 97 as col, sum(floor(o_totalprice / 1000)) as val from orders group by all)"


def _sparse(spark, sf_dir) -> Sparse:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return Sparse(o.groupBy((F.col("o_custkey") % 150).alias("row"), (F.col("o_orderkey") % 97).alias("col")).agg(F.sum(F.floor(F.col("o_totalprice") / 1000).cast("double")).alias("val")), 150, 97)


@query(f"select row as i, sum(val * (col % 5)) as v from {_SP} group by all")
def sparse_matvec(spark, sf_dir):
    x = spark.range(97).select(F.col("id").alias("i"), (F.col("id") % 5).cast("double").alias("v"))
    return _sparse(spark, sf_dir).matvec(x)


@query(f"select col as i, sum(val * (row % 4)) as v from {_SP} group by all")
def sparse_transpose_matvec(spark, sf_dir):
    x = spark.range(150).select(F.col("id").alias("i"), (F.col("id") % 4).cast("double").alias("v"))
    return _sparse(spark, sf_dir).transpose_matvec(x)


@query(f"select a.col as row, b.col as col, sum(a.val * b.val) as val from {_SP} a join {_SP} b on a.row = b.row group by all")
def sparse_matmat(spark, sf_dir):
    s = _sparse(spark, sf_dir)
    return s.transpose_matmat(s).df


@query(f"""select r as i, count(val) as nnz, coalesce(sum(val), 0) as s, coalesce(sum(abs(val)), 0) as a, round(coalesce(sqrt(sum(val * val)), 0), {D}) as n from range(150) t(r) left join {_SP} on row = r group by all""")
def sparse_row_statistics(spark, sf_dir):
    return _sparse(spark, sf_dir).row_statistics().select("i", "nnz", F.col("sum").alias("s"), F.col("abs_sum").alias("a"), _r("norm").alias("n"))


@query(f"""select r as i, count(val) as nnz, coalesce(sum(val), 0) as s, round(coalesce(sqrt(sum(val * val)), 0), {D}) as n from range(97) t(r) left join {_SP} on col = r group by all""")
def sparse_column_statistics(spark, sf_dir):
    return _sparse(spark, sf_dir).column_statistics().select("i", "nnz", F.col("sum").alias("s"), _r("norm").alias("n"))


@query(f"""select count(*) as nnz, round(count(*) / (150 * 97)::double, 9) as density, sum(val) as total, round(sqrt(sum(val * val)), {D}) as frobenius, coalesce(sum(case when row = col then val end), 0) as trace, max(abs(row - col)) as bandwidth from {_SP}""")
def sparse_statistics(spark, sf_dir):
    s = _sparse(spark, sf_dir)
    row = (s.nnz(), round(s.density(), 9), s.sum(), round(s.frobenius_norm(), D), s.trace(), s.bandwidth())
    return spark.createDataFrame([row], "nnz long, density double, total double, frobenius double, trace double, bandwidth long")


@query(f"select r as row, c as col, coalesce(val, 0) as val from range(150) a(r) cross join range(97) b(c) left join {_SP} s on s.row = r and s.col = c")
def sparse_to_dense(spark, sf_dir):
    return _sparse(spark, sf_dir).to_dense()


@query(f"select col as row, row as col, val from {_SP} where row = col or true")
def sparse_transpose(spark, sf_dir):
    return _sparse(spark, sf_dir).transpose().df


# --- linear algebra, statistics, searches ---


@query(f"with m as (select unnest(range(64)) as k, vec_id, unnest(embedding)::double as v from embeddings) select a.k as i, b.k as j, round(sum(a.v * b.v), 4) as v from m a join m b using (vec_id) group by all")
def linalg_gram(spark, sf_dir):
    g = gram(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "embedding")
    rows = [(i, j, round(float(g[i, j]), 4)) for i in range(64) for j in range(64)]
    return spark.createDataFrame(rows, "i long, j long, v double")


@query("""with s as (select sum(x * x) xx, sum(x * z) xz, sum(z * z) zz, sum(x * y) xy, sum(z * y) zy from (select l_quantity as x, (l_linenumber)::double as z, round(l_extendedprice / 100) as y from lineitem))
select round((xy * zz - zy * xz) / (xx * zz - xz * xz), 6) as b0, round((zy * xx - xy * xz) / (xx * zz - xz * xz), 6) as b1 from s""")
def linalg_least_squares(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_quantity as x", "cast(l_linenumber as double) as z", "round(l_extendedprice / 100) as y")
    b = least_squares(df, ["x", "z"], "y")
    return spark.createDataFrame([tuple(round(float(v), 6) for v in b)], "b0 double, b1 double")


_E = "(select user_id, event_id, round(value) as x, (event_id % 13)::double as y from events)"


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("user_id", "event_id", "round(value) as x", "cast(event_id % 13 as double) as y")


@query(f"select event_id, round(case when min(x) over w = max(x) over w then 'NaN'::double else (x - avg(x) over w) / (stddev_pop(x) over w) end, 6) as z, round(case when min(x) over w = max(x) over w then 'NaN'::double else (x - min(x) over w) / (max(x) over w - min(x) over w) end, 6) as m from {_E} window w as (partition by user_id)")
def stats_zscore_normalize(spark, sf_dir):
    df = series.normalize(series.zscore(_events(spark, sf_dir), "x", "z", ["user_id"]), "x", "m", ["user_id"])
    return df.select("event_id", F.round("z", 6).alias("z"), F.round("m", 6).alias("m"))


@query(f"""select user_id, round(case when (n * xx - sx * sx) * (n * yy - sy * sy) = 0 then 'NaN'::double else (n * xy - sx * sy) / sqrt((n * xx - sx * sx) * (n * yy - sy * sy)) end, 6) as r
from (select user_id, count(*) n, sum(x) sx, sum(y) sy, sum(x * x) xx, sum(y * y) yy, sum(x * y) xy from {_E} group by user_id)""")
def stats_pearsonr(spark, sf_dir):
    return series.pearsonr(_events(spark, sf_dir), "x", "y", "r", ["user_id"]).select("user_id", F.round("r", 6).alias("r"))


@query(f"select user_id, round(case when sum(y) = 0 then 'NaN'::double else sum(x * y) / sum(y) end, 6) as weighted_mean from {_E} group by user_id")
def stats_weighted(spark, sf_dir):
    return series.weighted(_events(spark, sf_dir), "x", "y", ["user_id"]).select("user_id", F.round("weighted_mean", 6).alias("weighted_mean"))


@query(f"""select user_id, round(covar_samp(x, y), 6) as cov, round(case when stddev_pop(x) * stddev_pop(y) = 0 then 'NaN'::double else corr(x, y) end, 6) as corr from {_E} group by user_id having count(*) > 1""")
def stats_covariance(spark, sf_dir):
    many = _events(spark, sf_dir)
    some = many.groupBy("user_id").count().where("count > 1").select("user_id")
    return series.covariance(many.join(some, "user_id"), "x", "y", ["user_id"]).select("user_id", F.round("cov", 6).alias("cov"), F.round("corr", 6).alias("corr"))


@query(f"""with w as (select user_id, x, sum(y) as y from {_E} where y > 0 group by all), c as (select *, sum(y) over (partition by user_id order by x) as c, sum(y) over (partition by user_id) as t from w) select user_id, min(x) as m from c where c >= 0.5 * t group by user_id""")
def stats_weighted_median(spark, sf_dir):
    return series.weighted_median(_events(spark, sf_dir), "x", "y", "m", ["user_id"])


@query(f"select y as value, count(*) as count from {_E} group by y")
def unique_with_counts(spark, sf_dir):
    return series.unique_with_counts(_events(spark, sf_dir), "y")


# --- dense matrices of two by two, one a user: [[p, q], [q, s]], and a vector ---

_TWO = f"(select user_id, count(*) + sum(x * x) as p, sum(x * y) as q, count(*) + sum(y * y) as s, sum(x) as u, sum(y) as w from {_E} group by user_id)"


def _two(spark, sf_dir):
    e = _events(spark, sf_dir)
    n = F.count("*")
    m = e.groupBy("user_id").agg((n + F.sum(F.col("x") * F.col("x"))).alias("p"), F.sum(F.col("x") * F.col("y")).alias("q"), (n + F.sum(F.col("y") * F.col("y"))).alias("s"), F.sum("x").alias("u"), F.sum("y").alias("w"))
    cell = lambda i, j, c: F.struct(F.lit(i).alias("row"), F.lit(j).alias("col"), F.col(c).cast("double").alias("val"))
    long = lambda *cells: m.select("user_id", F.explode(F.array(*cells)).alias("c")).select("user_id", "c.*")
    return long(cell(0, 0, "p"), cell(0, 1, "q"), cell(1, 0, "q"), cell(1, 1, "s")), long(cell(0, 0, "u"), cell(1, 0, "w"))


@query(f"""select user_id, round((u * s - w * q) / (p * s - q * q), 6) as x0, round((w * p - u * q) / (p * s - q * q), 6) as x1, round(p * s - q * q, 2) as det, round(sqrt(p), 6) as c00, round(q / sqrt(p), 6) as c10, round(s / (p * s - q * q), 9) as i00,
round((p + s) / 2 - sqrt((p - s) * (p - s) / 4 + q * q), 3) as e0, round((p + s) / 2 + sqrt((p - s) * (p - s) / 4 + q * q), 3) as e1, round(sqrt(p * p + q * q), 4) as r00 from {_TWO}""")
def linalg_by_group(spark, sf_dir):
    """Factorizations and solutions of a small matrix per group."""
    a, b = _two(spark, sf_dir)
    parts = {
        "solve": {"x0": ("row = 0", 6), "x1": ("row = 1", 6)}, "det": {"det": ("true", 2)}, "cholesky": {"c00": ("row = 0 and col = 0", 6), "c10": ("row = 1 and col = 0", 6)}, "inverse": {"i00": ("row = 0 and col = 0", 9)},
        "eigh": {"e0": ("part = 'values' and row = 0", 3), "e1": ("part = 'values' and row = 1", 3)}, "qr": {"r00": ("part = 'r' and row = 0 and col = 0", 4)},
    }
    found = [(per_group_with(a, b, "user_id", op) if op == "solve" else per_group(a, "user_id", op)).withColumn("op", F.lit(op)) for op in parts]
    value = {"r00": F.abs("val")}
    numbers = [F.round(F.max(F.when((F.col("op") == op) & F.expr(where), value.get(name, F.col("val")))), digits).alias(name) for op, names in parts.items() for name, (where, digits) in names.items()]
    return reduce(DataFrame.unionAll, found).groupBy(F.col("key").alias("user_id")).agg(*numbers)


@query(f"select r as bin, count(y) as count from range(20) t(r) left join {_E} on y = r group by all")
def bincount(spark, sf_dir):
    return series.bincount(_events(spark, sf_dir), "y", 20)


@query(f"select event_id, (case when x > 5 then 1 else 0 end + case when x > 10 then 1 else 0 end + case when x > 50 then 1 else 0 end)::bigint as l, (case when x >= 5 then 1 else 0 end + case when x >= 10 then 1 else 0 end + case when x >= 50 then 1 else 0 end)::bigint as r from {_E}")
def searchsorted(spark, sf_dir):
    e = [5, 10, 50]
    return _events(spark, sf_dir).select("event_id", series.searchsorted(F.col("x"), e).alias("l"), series.searchsorted(F.col("x"), e, "right").alias("r"))


@query(f"select r as bin, count(x) as count from range(8) t(r) left join {_E} on x between 0 and 100 and least(floor(x / 12.5), 7) = r group by all")
def histogram(spark, sf_dir):
    return series.histogram(_events(spark, sf_dir), "x", 0, 100, 8)


@query("select k, n, 0.02 >= abs(m - e) as close from (values ('uniform', 20000, 0.5, 0.5), ('exponential', 20000, 1.0, 1.0), ('rayleigh', 20000, 1.0, 1.0), ('normal', 20000, 0.0, 0.0)) t(k, n, m, e)")
def random_moments(spark, sf_dir):
    """Means of seeded random columns against the distributions' own."""
    expected = {"uniform": 0.5, "exponential": 1.0, "rayleigh": 1.2533141373155003, "normal": 0.0}
    one = spark.range(0, 20000, 1, 4).select(*(series.RANDOM[k](7).alias(k) for k in expected)).agg(*(F.avg(k).alias(k) for k in expected))
    rows = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(20000).alias("n"), (F.abs(F.col(k) - e) <= 0.02).alias("close")) for k, e in expected.items()))
    return one.select(F.explode(rows).alias("r")).select("r.*")

