"""Relational operators over the test tables, with DuckDB SQL for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.frame import Frame
from tessera.plans.options import AsofOptions, SortOptions
from tessera.plans.profile_queries import rounded

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


def frame(spark: SparkSession, sf_dir: str, name: str, order: str, columns: tuple[str, ...] = (), where: str = "true") -> Frame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet").where(where)
    return Frame(df.selectExpr(*columns) if columns else df, [order])


def _orders(spark, sf_dir):
    return frame(spark, sf_dir, "orders", "o_orderkey", ("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"))


def _customers(spark, sf_dir, nulls=False):
    key = "case when c_custkey % 4 <> 0 then c_custkey end as c_custkey" if nulls else "c_custkey"
    return frame(spark, sf_dir, "customer", "c_id", ("c_custkey as c_id", key, "c_nationkey", "c_acctbal"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter, grouped statistics of two keys, sort."""
    f = Frame(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_shipdate"), ["l_shipdate"])
    f = f.filter_column_scalar("l_quantity", 45.0, "le")
    return rounded(f.group_by_stats_on(["l_returnflag", "l_linestatus"], "l_quantity", "q").orderBy("l_returnflag", "l_linestatus"))


QUERIES["flagship"] = flagship
ORACLE_SQL["flagship"] = """select l_returnflag, l_linestatus, count(*) as q_count, round(sum(l_quantity), 6) as q_sum, min(l_quantity) as q_min, max(l_quantity) as q_max, round(avg(l_quantity), 6) as q_mean
from lineitem where l_quantity <= 45 group by all"""


@query("select o_orderkey, o_totalprice from orders where o_totalprice > 200000")
def filter_scalar(spark, sf_dir):
    f = _orders(spark, sf_dir).filter_column_scalar("o_totalprice", 200000.0, "gt")
    return f.select(["o_orderkey", "o_totalprice"]).df


@query("select event_id, user_id from events where case when event_id % 3 <> 0 then value > 50 end")
def filter_column_mask(spark, sf_dir):
    f = frame(spark, sf_dir, "events", "event_id", ("event_id", "user_id", "case when event_id % 3 <> 0 then value > 50 end as m"))
    return f.filter_column_mask("m").df.drop("m")


@query("""select c_custkey, round(a + b, 6) as s, round(a - b, 6) as d, round(a * b, 6) as p, round(case when b = 0 then null else a / b end, 6) as q, round(a * 2, 6) as twice, a > b as gt, a = b as eq, a <= 10 as small
from (select c_custkey, floor(c_acctbal) as a, (c_custkey % 7 + 1)::double as b from customer)""")
def column_arithmetic(spark, sf_dir):
    f = frame(spark, sf_dir, "customer", "c_custkey", ("c_custkey", "cast(floor(c_acctbal) as double) as a", "cast(c_custkey % 7 + 1 as double) as b"))
    for op, out in (("add", "s"), ("sub", "d"), ("mul", "p"), ("div", "q")):
        f = f.binary_columns("a", "b", op, out)
    f = f.binary_column_scalar("a", 2.0, "mul", "twice").compare_columns("a", "b", "gt", "gt").compare_columns("a", "b", "eq", "eq").compare_column_scalar("a", 10.0, "le", "small")
    return rounded(f.df.drop("a", "b"))


@query("""with v as (select c_custkey, floor(c_acctbal) as a, case when c_custkey % 5 = 0 then 0 else 4 end::double as b from customer)
select c_custkey, case when b <> 0 then a / nullif(b, 0) when a = 0 then 'nan'::double when a > 0 then 'inf'::double else '-inf'::double end as q from v""")
def division_by_zero(spark, sf_dir):
    f = frame(spark, sf_dir, "customer", "c_custkey", ("c_custkey", "cast(floor(c_acctbal) as double) as a", "cast(case when c_custkey % 5 = 0 then 0 else 4 end as double) as b"))
    return f.binary_columns("a", "b", "div", "q").df.select("c_custkey", "q")


@query("select o_orderkey, o_totalprice from orders order by o_orderkey limit 25")
def head(spark, sf_dir):
    return _orders(spark, sf_dir).select(["o_orderkey", "o_totalprice"]).head(25).df


@query("select o_orderkey, o_totalprice from orders order by o_orderkey desc limit 25")
def tail(spark, sf_dir):
    return _orders(spark, sf_dir).select(["o_orderkey", "o_totalprice"]).tail(25).df


@query("select o_orderkey, o_custkey from orders order by o_orderkey limit 30 offset 100")
def slice_rows(spark, sf_dir):
    return _orders(spark, sf_dir).select(["o_orderkey", "o_custkey"]).slice_rows(100, 130).df


@query("""with i as (select s_suppkey as at, case when s_suppkey % 3 <> 0 then s_suppkey * 2 end as index from supplier), r as (select *, row_number() over (order by p_partkey) - 1 as pos from part)
select i.at, p_partkey, p_size from i left join r on i.index = r.pos""")
def take_optional(spark, sf_dir):
    f = frame(spark, sf_dir, "part", "p_partkey", ("p_partkey", "p_size"))
    idx = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("s_suppkey as at", "case when s_suppkey % 3 <> 0 then s_suppkey * 2 end as index")
    return f.take(idx, optional=True).select("at", "p_partkey", "p_size")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 40")
def top_k_by(spark, sf_dir):
    return _orders(spark, sf_dir).top_k_by("o_totalprice", 40, SortOptions(descending=True)).select("o_orderkey", "o_totalprice")


@query("select c_custkey, row_number() over (order by c_nationkey desc nulls last, c_custkey) - 1 as argsort from customer")
def argsort_by(spark, sf_dir):
    return frame(spark, sf_dir, "customer", "c_custkey", ("c_custkey", "c_nationkey")).argsort_by("c_nationkey", SortOptions(descending=True)).df.select("c_custkey", "argsort")


@query("""select c_custkey, row_number() over (order by v nulls last, c_custkey) as r_ordinal_rank, rank() over w as r_competition_rank, dense_rank() over w as r_dense_rank, round(percent_rank() over w, 9) as r_percent_rank, round(cume_dist() over w, 9) as r_cume_dist
from (select c_custkey, case when c_custkey % 9 <> 0 then c_nationkey end as v from customer) window w as (order by v nulls last)""")
def rank_profile_by(spark, sf_dir):
    f = frame(spark, sf_dir, "customer", "c_custkey", ("c_custkey", "case when c_custkey % 9 <> 0 then c_nationkey end as v")).rank_profile_by("v", "r")
    return rounded(f.df.drop("v"), 9)


@query("""select l_returnflag, count(*) as n from (select case when l_linenumber % 5 <> 0 then l_returnflag end as l_returnflag from lineitem) where l_returnflag is not null group by all""")
def group_by_count(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("case when l_linenumber % 5 <> 0 then l_returnflag end as l_returnflag", "l_orderkey")
    return Frame(df, ["l_orderkey"]).group_by_count("l_returnflag", "n")


@query("""select l_linenumber, sum(l_quantity) as s, min(l_quantity) as lo, max(l_quantity) as hi, round(avg(l_quantity), 6) as m from lineitem group by all""")
def group_by_value(spark, sf_dir):
    f = Frame(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_linenumber", "l_quantity", "l_orderkey"), ["l_orderkey"])
    out = f.group_by_sum("l_linenumber", "l_quantity", "s")
    for part in (f.group_by_min("l_linenumber", "l_quantity", "lo"), f.group_by_max("l_linenumber", "l_quantity", "hi"), f.group_by_mean("l_linenumber", "l_quantity", "m")):
        out = out.join(part, "l_linenumber")
    return rounded(out)


@query("""select l_returnflag, count(*) as q_count, sum(l_quantity) as q_sum, round(avg(l_quantity), 6) as q_mean, round(var_pop(l_quantity), 4) as q_variance, round(stddev_pop(l_quantity), 4) as q_stddev,
round((avg(l_quantity ** 3) - 3 * avg(l_quantity) * avg(l_quantity ** 2) + 2 * avg(l_quantity) ** 3) / stddev_pop(l_quantity) ** 3, 4) + 0.0 as q_skewness,
round((avg(l_quantity ** 4) - 4 * avg(l_quantity) * avg(l_quantity ** 3) + 6 * avg(l_quantity) ** 2 * avg(l_quantity ** 2) - 3 * avg(l_quantity) ** 4) / var_pop(l_quantity) ** 2 - 3, 4) as q_kurtosis from lineitem group by all""")
def group_by_profile(spark, sf_dir):
    f = Frame(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_quantity", "l_orderkey"), ["l_orderkey"])
    out = rounded(f.group_by_profile("l_returnflag", "l_quantity", "q"))
    return out.withColumns({f"q_{c}": F.round(f"q_{c}", 4) + F.lit(0.0) for c in ("variance", "stddev", "skewness", "kurtosis")})


@query("""select l_returnflag, l_linestatus, count(*) as q_count, sum(l_quantity) as q_sum, round(avg(l_quantity), 6) as q_mean, round(var_pop(l_quantity), 4) as q_variance, round(stddev_pop(l_quantity), 4) as q_stddev from lineitem group by all""")
def group_by_profile_on(spark, sf_dir):
    f = Frame(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_linestatus", "l_quantity", "l_orderkey"), ["l_orderkey"])
    out = rounded(f.group_by_profile_on(["l_returnflag", "l_linestatus"], "l_quantity", "q")).drop("q_skewness", "q_kurtosis")
    return out.withColumns({f"q_{c}": F.round(f"q_{c}", 4) for c in ("variance", "stddev")})


@query("""with d as (select count(c_custkey)::double a, count(c_acctbal)::double b, avg(c_custkey) am, avg(round(c_acctbal)) bm, min(c_custkey)::double an, min(round(c_acctbal)) bn, max(c_custkey)::double ax, max(round(c_acctbal)) bx from customer)
select 'count' as stat, a as c_custkey, b as v from d union all select 'mean', round(am, 6), round(bm, 6) from d union all select 'min', an, bn from d union all select 'max', ax, bx from d""")
def describe(spark, sf_dir):
    return rounded(frame(spark, sf_dir, "customer", "c_custkey", ("c_custkey", "round(c_acctbal) as v")).describe())


_NULL_KEY = "(select c_custkey as c_id, case when c_custkey % 4 <> 0 then c_custkey end as c_custkey, c_nationkey, c_acctbal from customer)"


@query(f"select o_orderkey, c_id, c_acctbal from orders join {_NULL_KEY} c on o_custkey = c_custkey")
def inner_join(spark, sf_dir):
    return _orders(spark, sf_dir).inner_join(_customers(spark, sf_dir, True), "o_custkey", "c_custkey").df.select("o_orderkey", "c_id", "c_acctbal")


@query(f"select o_orderkey, o_custkey, c_id from orders left join {_NULL_KEY} c on o_custkey = c_custkey")
def left_join(spark, sf_dir):
    return _orders(spark, sf_dir).left_join(_customers(spark, sf_dir, True), "o_custkey", "c_custkey").df.select("o_orderkey", "o_custkey", "c_id")


@query(f"select o_orderkey, coalesce(o_custkey, c_custkey) as o_custkey, c_id from orders full join {_NULL_KEY} c on o_custkey = c_custkey")
def full_join(spark, sf_dir):
    return _orders(spark, sf_dir).full_join(_customers(spark, sf_dir, True), "o_custkey", "c_custkey").df.select("o_orderkey", "o_custkey", "c_id")


@query(f"select o_orderkey from orders where o_custkey in (select c_custkey from {_NULL_KEY} where c_acctbal > 0 and c_custkey is not null)")
def semi_join(spark, sf_dir):
    c = _customers(spark, sf_dir, True).filter_column_scalar("c_acctbal", 0.0, "gt")
    return _orders(spark, sf_dir).semi_join(c, "o_custkey", "c_custkey").df.select("o_orderkey")


@query("select c_id, c_custkey from " + _NULL_KEY + " c where not exists (select 1 from orders o where o.o_custkey = c.c_custkey)")
def anti_join(spark, sf_dir):
    return _customers(spark, sf_dir, True).anti_join(_orders(spark, sf_dir), "c_custkey", "o_custkey").df.select("c_id", "c_custkey")


_S = "select s_suppkey, s_nationkey, s_suppkey % 3 as g, s_acctbal from supplier"
_C = "select c_custkey, c_nationkey, c_custkey % 3 as g, c_acctbal from customer"


def _both(spark, sf_dir):
    s = frame(spark, sf_dir, "supplier", "s_suppkey", ("s_suppkey", "s_nationkey", "s_suppkey % 3 as g", "s_acctbal"))
    return s, frame(spark, sf_dir, "customer", "c_custkey", ("c_custkey", "c_nationkey", "c_custkey % 3 as g", "c_acctbal"))


for _name, _how, _cols in (("inner_join_on", "join", "s_suppkey, c_custkey"), ("left_join_on", "left join", "s_suppkey, c_custkey"), ("full_join_on", "full join", "s_suppkey, c_custkey, coalesce(s_nationkey, c_nationkey) as s_nationkey, coalesce(s.g, c.g) as g")):

    def _on(spark, sf_dir, _name=_name, _full=_name.startswith("full")):
        s, c = _both(spark, sf_dir)
        out = getattr(s, _name)(c, ["s_nationkey", "g"], ["c_nationkey", "g"]).df
        return out.select("s_suppkey", "c_custkey", *(("s_nationkey", "g") if _full else ()))

    QUERIES[_name] = _on
    ORACLE_SQL[_name] = f"select {_cols} from ({_S}) s {_how} ({_C}) c on s_nationkey = c_nationkey and s.g = c.g"
for _name, _not in (("semi_join_on", ""), ("anti_join_on", "not ")):

    def _flt(spark, sf_dir, _name=_name):
        s, c = _both(spark, sf_dir)
        return getattr(s, _name)(c, ["s_nationkey", "g"], ["c_nationkey", "g"]).df.select("s_suppkey")

    QUERIES[_name] = _flt
    ORACLE_SQL[_name] = f"select s_suppkey from ({_S}) s where {_not}exists (select 1 from ({_C}) c where s_nationkey = c_nationkey and s.g = c.g)"

_EV = "(select event_id, user_id, value from events)"
_PU = "(select event_id as rid, user_id, event_id // 3 * 3 as k, value as quote from events where event_type = 'purchase')"


def _asof(strategy: str):
    def run(spark, sf_dir):
        e = Frame(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "value"), ["event_id"], ["user_id"])
        p = Frame(spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'purchase'").selectExpr("event_id as rid", "user_id", "cast(floor(event_id / 3) * 3 as bigint) as k", "value as quote"), ["rid"], ["user_id"])
        return e.asof_join(p, "event_id", "k", AsofOptions(strategy)).df.select("event_id", "quote")

    return run


_PREV = f"(select arg_min(struct_pack(k := k, rid := rid, quote := quote), (-k, rid)) from {_PU} p where p.user_id = e.user_id and p.k <= e.event_id)"
_NEXT = f"(select arg_min(struct_pack(k := k, rid := rid, quote := quote), (k, rid)) from {_PU} p where p.user_id = e.user_id and p.k >= e.event_id)"
_NEAR = f"(select arg_min(struct_pack(k := k, rid := rid, quote := quote), (abs(k - e.event_id), rid)) from {_PU} p where p.user_id = e.user_id)"
for _s, _e in (("previous", _PREV), ("next", _NEXT), ("nearest", _NEAR)):
    QUERIES[f"asof_join_{_s}"] = _asof(_s)
    ORACLE_SQL[f"asof_join_{_s}"] = f"select event_id, m.quote as quote from (select event_id, {_e} as m from {_EV} e)"


@query("select n_nationkey as k, n_name as v from nation union all select r_regionkey, r_name from region")
def concat_rows(spark, sf_dir):
    return frame(spark, sf_dir, "nation", "k", ("n_nationkey as k", "n_name as v")).concat_rows(frame(spark, sf_dir, "region", "k", ("r_regionkey as k", "r_name as v"))).df


@query("""select o_orderkey, k, o_totalprice from (select *, row_number() over (partition by k order by o_orderkey) as r from (select o_orderkey, case when o_custkey % 5 <> 0 then o_custkey % 50 end as k, o_totalprice from orders) where k is not null) where r = 1""")
def distinct_on(spark, sf_dir):
    return frame(spark, sf_dir, "orders", "o_orderkey", ("o_orderkey", "case when o_custkey % 5 <> 0 then o_custkey % 50 end as k", "o_totalprice")).distinct_on(["k"]).df


@query("select distinct k, s from (select case when o_custkey % 5 <> 0 then o_custkey % 50 end as k, o_orderstatus as s from orders) where k is not null and s is not null")
def distinct_rows(spark, sf_dir):
    f = frame(spark, sf_dir, "orders", "o_orderkey", ("o_orderkey", "case when o_custkey % 5 <> 0 then o_custkey % 50 end as k", "o_orderstatus as s"))
    return f.distinct_rows(["k", "s"]).df.select("k", "s")


@query("select o_orderkey, o_totalprice from orders where o_totalprice between 100000 and 150000")
def parquet_range_scan(spark, sf_dir):
    from tessera.sources.io import scan_parquet

    return scan_parquet(spark, f"{sf_dir}/orders.parquet").select(["o_orderkey", "o_totalprice"]).where_range("o_totalprice", 100000, 150000).collect()
