"""Every profile over the events table, per user, with DuckDB SQL for each.

Inputs are small whole numbers with nulls put in by rule, so sums are exact in
either engine; results are rounded to six places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.frame import Frame
from tessera.plans.options import BucketOptions, ClipOptions, EmaOptions, ExpandingOptions, LagOptions, RollingOptions

DIGITS = 6
ROLL, EXPAND, LAG = RollingOptions(5, 3), ExpandingOptions(2), LagOptions(1)

_X = "case when event_id % 7 <> 0 then cast(cast(floor(value) as bigint) % 20 as double) end"
_Y = "case when event_id % 11 <> 0 then cast((cast(floor(value / 2) as bigint) % 9) + event_id % 5 as double) end"
_Z = "case when event_id % 7 <> 0 then cast(cast(floor(value) as bigint) % 5 - 2 as double) end"
_B = "case when event_id % 5 <> 0 then value > 20 end"
_P = "case when event_id % 6 <> 0 then event_type in ('click', 'view') end"


def events(spark: SparkSession, sf_dir: str) -> Frame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", "user_id", f"{_X} as x", f"{_Y} as y", f"{_Z} as z", f"{_B} as b", f"{_P} as p")
    return Frame(df, ["event_id"], ["user_id"])


#: Steps that several profiles share: lags, signs, row numbers, then what builds on them.
_STEPS = f"""
with s0 as (select event_id, user_id, {_X} as x, {_Y} as y, {_Z} as z, {_B} as b, {_P} as p from events),
s1 as (select *, row_number() over wo as rn, lag(x) over wo as lx, lead(x) over wo as nx, lag(b) over wo as lb, x - y as sp,
         case when z > 0 then 1 when z < 0 then -1 when z = 0 then 0 end::bigint as s, case when x is not null and y is not null then x end as px, case when x is not null and y is not null then y end as py
       from s0 window wo as (partition by user_id order by event_id)),
s2 as (select *, x - lx as d, case when x > lx then 1 when x < lx then -1 when x = lx then 0 end::bigint as t, lag(s) over wo as ls, lag(sp) over wo as lsp,
         case when b is not null and lb is not null then b and not lb end as rise, case when b is not null and lb is not null then not b and lb end as fall, case when b is not null and lb is not null then b <> lb end as tog,
         case when b is not null and p is not null then b and p end as tp, case when b is not null and p is not null then not b and p end as fp,
         case when b is not null and p is not null then not b and not p end as tn, case when b is not null and p is not null then b and not p end as fn, case when b is not null and p is not null then b = p end as ok,
         x - y as e, abs(x - y) as ae, (x - y) * (x - y) as se, case when x = 0 and y is not null then 'NaN'::double else abs(x - y) / nullif(abs(x), 0) end as ape,
         case when abs(x) + abs(y) = 0 then 'NaN'::double else 2 * abs(x - y) / nullif(abs(x) + abs(y), 0) end as sm,
         least(greatest(x, 5.0), 12.0) as cl, x < 5 as lo, x > 12 as hi, x - 8 as th
       from s1 window wo as (partition by user_id order by event_id)),
s3 as (select *, coalesce(max(case when t is null then rn end) over we, 0) as gap, max(case when t <> 0 then rn end) over pre as lnz,
         arg_max(case when t <> 0 then t end, case when t <> 0 then rn end) over pre as lt, s <> ls as flip,
         case when sp is not null and lsp is not null then lsp <= 0 and sp > 0 end as up, case when sp is not null and lsp is not null then lsp >= 0 and sp < 0 end as dn
       from s2 window we as (partition by user_id order by event_id rows unbounded preceding), pre as (partition by user_id order by event_id rows between unbounded preceding and 1 preceding)),
s4 as (select *, case when t is not null then coalesce(lnz > gap, false) and t <> 0 and coalesce(t <> lt, false) end as rev from s3)
"""
_WINDOWS = """window wo as (partition by user_id order by event_id), we as (partition by user_id order by event_id rows unbounded preceding),
  wr as (partition by user_id order by event_id rows between 4 preceding and current row), pre as (partition by user_id order by event_id rows between unbounded preceding and 1 preceding),
  wall as (partition by user_id), wx as (partition by user_id order by x nulls last range unbounded preceding)"""

Columns = list[tuple[str, str, str]]


def _select(prefix: str, columns: Columns) -> str:
    """SQL of a query: kind f is rounded, others are taken as they are."""
    parts = [f"round({e}, {DIGITS}) as {prefix}_{n}" if k == "f" else f"{e} as {prefix}_{n}" for n, k, e in columns]
    return f"{_STEPS} select event_id, {', '.join(parts)} from s4 {_WINDOWS}"


def _nz(a: str, b: str) -> str:
    return f"(case when {b} = 0 then case when {a} is not null then 'NaN'::double end else {a} / nullif({b}, 0) end)"


def _run(cond: str, valid: str | None = None) -> str:
    e = f"rn - coalesce(max(case when not coalesce({cond}, false) then rn end) over we, 0)"
    return e if valid is None else f"case when {valid} is not null then {e} end"


_ROWS: dict[str, tuple[Callable[[Frame], Frame], Columns]] = {
    "lag_profile": (lambda f: f.lag_profile("x", "o", LAG), [("lag", "f", "lx"), ("diff", "f", "x - lx"), ("pct_change", "f", _nz("(x - lx)", "lx"))]),
    "lead_profile": (lambda f: f.lead_profile("x", "o", LAG), [("lead", "f", "nx"), ("forward_diff", "f", "nx - x"), ("forward_pct_change", "f", _nz("(nx - x)", "x"))]),
    "standardize_profile": (
        lambda f: f.standardize_profile("x", "o", EXPAND),
        [(n, "f", f"case when x is not null and count(x) over wall >= 2 then {e} end") for n, e in (("centered", "x - avg(x) over wall"), ("zscore", _nz("(x - avg(x) over wall)", "(stddev_pop(x) over wall)")), ("minmax", _nz("(x - min(x) over wall)", "(max(x) over wall - min(x) over wall)")))],
    ),
    "drawdown_profile": (
        lambda f: f.drawdown_profile("x", "o", EXPAND),
        [(n, "f", f"case when x is not null and count(x) over we >= 2 then {e} end") for n, e in (("running_peak", "max(x) over we"), ("drawdown", "x - max(x) over we"), ("drawdown_pct", _nz("(x - max(x) over we)", "(max(x) over we)")))],
    ),
    "extrema_profile": (
        lambda f: f.extrema_profile("x", "o", EXPAND),
        [(n, k, f"case when x is not null and count(x) over we >= 2 then {e} end") for n, k, e in (("running_low", "f", "min(x) over we"), ("running_high", "f", "max(x) over we"), ("new_low", "b", "(min(x) over pre is null or x < min(x) over pre)"), ("new_high", "b", "(max(x) over pre is null or x > max(x) over pre)"))],
    ),
    "clip_profile": (lambda f: f.clip_profile("x", "o", ClipOptions(5, 12)), [("clipped", "f", "case when x is not null then cl end"), ("below", "b", "lo"), ("above", "b", "hi"), ("in_range", "b", "not lo and not hi")]),
    "threshold_profile": (lambda f: f.threshold_profile("x", "o", 8.0), [("distance", "f", "th"), ("abs_distance", "f", "abs(th)"), ("above", "b", "th > 0"), ("below", "b", "th < 0"), ("at", "b", "th = 0")]),
    "bucket_profile": (
        lambda f: f.bucket_profile("x", "o", BucketOptions(4, 0.1, 0.9, 2)),
        [(n, k, f"case when x is not null and count(x) over wall >= 2 then {e} end") for n, k, e in (("ecdf", "f", "count(x) over wx / (count(x) over wall)::double"), ("bucket", "i", "least(((count(x) over wx - 1) * 4) // (count(x) over wall), 3)::bigint"), ("lower_tail", "b", "count(x) over wx / (count(x) over wall)::double <= 0.1"), ("upper_tail", "b", "count(x) over wx / (count(x) over wall)::double >= 0.9"))],
    ),
    "error_profile": (lambda f: f.error_profile("x", "y", "o"), [("error", "f", "e"), ("abs_error", "f", "ae"), ("squared_error", "f", "se"), ("ape", "f", "ape"), ("smape", "f", "sm")]),
    "crossover_profile": (lambda f: f.crossover_profile("x", "y", "o", LAG), [("spread", "f", "sp"), ("ratio", "f", _nz("x", "y")), ("cross_above", "b", "up"), ("cross_below", "b", "dn")]),
    "trend_profile": (lambda f: f.trend_profile("x", "o", LAG), [("trend", "i", "t"), ("up_streak", "i", _run("t = 1", "t")), ("down_streak", "i", _run("t = -1", "t")), ("flat_streak", "i", _run("t = 0", "t")), ("reversal", "b", "rev")]),
    "change_point_profile": (lambda f: f.change_point_profile("x", "o", 6.0, LAG), [("change_delta", "f", "d"), ("change_abs_delta", "f", "abs(d)"), ("change_pct", "f", _nz("d", "lx")), ("change_point", "b", "abs(d) >= 6")]),
    "sign_profile": (lambda f: f.sign_profile("z", "o", LAG), [("sign", "i", "s"), ("sign_flip", "b", "flip"), ("positive_streak", "i", _run("s = 1", "s")), ("negative_streak", "i", _run("s = -1", "s")), ("zero_streak", "i", _run("s = 0", "s"))]),
    "validity_profile": (lambda f: f.validity_profile("x", "o"), [("is_null", "b", "x is null"), ("is_valid", "b", "x is not null"), ("valid_streak", "i", _run("x is not null")), ("null_streak", "i", _run("x is null"))]),
    "classification_profile": (lambda f: f.classification_profile("b", "p", "o"), [("tp", "b", "tp"), ("fp", "b", "fp"), ("tn", "b", "tn"), ("fn", "b", "fn"), ("correct", "b", "ok")]),
    "bool_transition_profile": (lambda f: f.bool_transition_profile("b", "o", LAG), [("rising", "b", "rise"), ("falling", "b", "fall"), ("toggled", "b", "tog"), ("true_streak", "i", _run("b", "b")), ("false_streak", "i", _run("not b", "b"))]),
}


def _summaries(word: str, w: str, least: int, o: object) -> dict[str, tuple[Callable[[Frame], Frame], Columns]]:
    g = lambda of, e, row="": f"case when count({of}) over {w} >= {least} {row} then {e} end"
    hits = lambda c: f"coalesce(sum(({c})::int) over {w}, 0)::bigint"
    rate = lambda of, c: g(of, f"coalesce(sum(({c})::int) over {w}, 0)::double / count({of}) over {w}")
    n = lambda of: f"count({of}) over {w}"
    avg = lambda e: f"avg({e}) over {w}"
    here = "and x is not null"
    m, m2, m3, m4 = avg("x"), avg("x * x"), avg("x * x * x"), avg("x * x * x * x")
    flat = f"(min(x) over {w} = max(x) over {w})"
    var = f"greatest({m2} - ({m}) * ({m}), 0)"
    c3 = f"({m3} - 3 * ({m}) * ({m2}) + 2 * ({m}) * ({m}) * ({m}))"
    c4 = f"({m4} - 4 * ({m}) * ({m3}) + 6 * ({m}) * ({m}) * ({m2}) - 3 * ({m}) * ({m}) * ({m}) * ({m}))"
    q = lambda p: f"quantile_cont(x, {p}) over {w}"
    low, high = f"({q(0.25)} - 1.5 * ({q(0.75)} - {q(0.25)}))", f"({q(0.75)} + 1.5 * ({q(0.75)} - {q(0.25)}))"
    mad = f"mad(x) over {w}"
    k, sx, sy = n("px"), f"(sum(px) over {w})", f"(sum(py) over {w})"
    xx, yy, xy = f"(sum(px * px) over {w})", f"(sum(py * py) over {w})", f"(sum(px * py) over {w})"
    cov = f"({xy} / {k} - ({sx} / {k}) * ({sy} / {k}))"
    vx, vy = f"greatest({xx} / {k} - ({sx} / {k}) * ({sx} / {k}), 0)", f"greatest({yy} / {k} - ({sy} / {k}) * ({sy} / {k}), 0)"
    slope = _nz(f"({k} * {xy} - {sx} * {sy})", f"({k} * {xx} - {sx} * {sx})")
    icept = f"(({sy} - {slope} * {sx}) / {k})"
    fit, pair = f"({icept} + {slope} * px)", "and px is not null"
    flatx = f"({k} * {xx} - {sx} * {sx} = 0)"
    sse = f"(({k} * {yy} - {sy} * {sy}) - power({k} * {xy} - {sx} * {sy}, 2) / nullif({k} * {xx} - {sx} * {sx}, 0)) / {k}"
    resz = f"case when {flatx} or ({sse}) <= 1e-9 then 'NaN'::double else (py - {fit}) / sqrt(greatest({sse}, 0) / {k}) end"
    lst = f"list(x) filter (x is not null) over {w}"
    less, same = f"len(list_filter({lst}, lambda v: v < x))", f"len(list_filter({lst}, lambda v: v = x))"
    more = [("variance", "f", g("x", f"var_pop(x) over {w}")), ("stddev", "f", g("x", f"stddev_pop(x) over {w}"))] if word == "rolling" else [("min", "f", g("x", f"min(x) over {w}")), ("max", "f", g("x", f"max(x) over {w}"))]
    out: dict[str, tuple[Callable[[Frame], Frame], Columns]] = {
        "profile": (lambda f: getattr(f, f"{word}_profile")("x", "o", o), [("count", "i", n("x")), ("sum", "f", g("x", f"sum(x) over {w}")), ("mean", "f", g("x", m)), *more]),
        "moment_profile": (
            lambda f: getattr(f, f"{word}_moment_profile")("x", "o", o),
            [("moment_count", "i", n("x")), ("m3", "f", g("x", f"case when {flat} then 0 else {c3} end")), ("m4", "f", g("x", f"case when {flat} then 0 else {c4} end")),
             ("skewness", "f", g("x", f"case when {flat} then 'NaN'::double else {c3} / power({var}, 1.5) end")), ("kurtosis", "f", g("x", f"case when {flat} then 'NaN'::double else {c4} / (({var}) * ({var})) - 3 end"))],
        ),
        "normalize_profile": (
            lambda f: getattr(f, f"{word}_normalize_profile")("x", "o", o),
            [("centered", "f", g("x", f"x - {m}", here)), ("zscore", "f", g("x", f"case when {flat} then 'NaN'::double else (x - {m}) / (stddev_pop(x) over {w}) end", here)),
             ("minmax", "f", g("x", f"case when {flat} then 'NaN'::double else (x - min(x) over {w}) / (max(x) over {w} - min(x) over {w}) end", here))],
        ),
        "quantile_profile": (lambda f: getattr(f, f"{word}_quantile_profile")("x", "o", o), [(a, "f", g("x", e, here if word == "rolling" else "")) for a, e in (("q1", q(0.25)), ("median", q(0.5)), ("q3", q(0.75)), ("iqr", f"{q(0.75)} - {q(0.25)}"))]),
        "bool_profile": (
            lambda f: getattr(f, f"{word}_bool_profile")("b", "o", o),
            [("true_count", "i", hits("b")), ("false_count", "i", hits("not b")), *((a, kind, g("b", e, "and b is not null")) for a, kind, e in (("true_rate", "f", f"{hits('b')}::double / {n('b')}"), ("any", "b", f"{hits('b')} > 0"), ("all", "b", f"{hits('not b')} = 0")))],
        ),
        "robust_profile": (
            lambda f: getattr(f, f"{word}_robust_profile")("x", "o", o),
            [(a, kind, g("x", e, here)) for a, kind, e in (("median_centered", "f", f"x - {q(0.5)}"), ("mad_zscore", "f", f"case when {mad} = 0 then 'NaN'::double else 0.6744897501960817 * (x - {q(0.5)}) / nullif({mad}, 0) end"), ("iqr_outlier", "b", f"x < {low} or x > {high}"), ("winsorized", "f", f"least(greatest(x, {low}), {high})"))],
        ),
        "rank_profile": (
            lambda f: getattr(f, f"{word}_rank_profile")("x", "o", o),
            [("rank_count", "i", n("x")), ("rank", "i", g("x", f"({less} + 1)::bigint", here)), ("percent_rank", "f", g("x", f"case when {n('x')} <= 1 then 0 else {less}::double / ({n('x')} - 1) end", here)), ("cume_dist", "f", g("x", f"({less} + {same})::double / {n('x')}", here))],
        ),
        "trend_profile": (lambda f: getattr(f, f"{word}_trend_profile")("x", "o", LAG, o), [("trend_count", "i", n("t")), *((a, "f", rate("t", c)) for a, c in (("up_rate", "t = 1"), ("down_rate", "t = -1"), ("flat_rate", "t = 0"), ("reversal_rate", "rev")))]),
        "change_point_profile": (
            lambda f: getattr(f, f"{word}_change_point_profile")("x", "o", 6.0, LAG, o),
            [("change_count", "i", n("d")), ("change_point_count", "i", hits("abs(d) >= 6")), ("change_rate", "f", rate("d", "abs(d) >= 6")), ("mean_abs_delta", "f", g("d", avg("abs(d)"))), ("max_abs_delta", "f", g("d", f"max(abs(d)) over {w}"))],
        ),
        "sign_profile": (lambda f: getattr(f, f"{word}_sign_profile")("z", "o", LAG, o), [("sign_count", "i", n("s")), *((a, "f", rate("s", c)) for a, c in (("positive_rate", "s = 1"), ("negative_rate", "s = -1"), ("zero_rate", "s = 0"), ("sign_flip_rate", "flip")))]),
        "clip_profile": (
            lambda f: getattr(f, f"{word}_clip_profile")("x", "o", ClipOptions(5, 12), o),
            [("clip_count", "i", n("x")), ("mean_clipped", "f", g("x", avg("case when x is not null then cl end"))), *((a, "f", rate("x", c)) for a, c in (("clipped_rate", "lo or hi"), ("clip_below_rate", "lo"), ("clip_above_rate", "hi"), ("clip_in_range_rate", "not lo and not hi")))],
        ),
        "threshold_profile": (
            lambda f: getattr(f, f"{word}_threshold_profile")("x", "o", 8.0, o),
            [("threshold_count", "i", n("x")), ("mean_distance", "f", g("x", avg("th"))), ("mean_abs_distance", "f", g("x", avg("abs(th)"))), *((a, "f", rate("x", c)) for a, c in (("above_rate", "th > 0"), ("below_rate", "th < 0"), ("at_rate", "th = 0")))],
        ),
        "error_profile": (lambda f: getattr(f, f"{word}_error_profile")("x", "y", "o", o), [("error_count", "i", n("e")), ("mae", "f", g("e", avg("ae"))), ("rmse", "f", g("e", f"sqrt({avg('se')})")), ("mape", "f", g("e", avg("ape"))), ("smape", "f", g("e", avg("sm")))]),
        "crossover_profile": (
            lambda f: getattr(f, f"{word}_crossover_profile")("x", "y", "o", LAG, o),
            [("cross_count", "i", n("sp")), ("cross_above_count", "i", hits("up")), ("cross_below_count", "i", hits("dn")), ("cross_above_rate", "f", rate("sp", "up")), ("cross_below_rate", "f", rate("sp", "dn")), ("mean_abs_spread", "f", g("sp", avg("abs(sp)")))],
        ),
        "classification_profile": (
            lambda f: getattr(f, f"{word}_classification_profile")("b", "p", "o", o),
            [("class_count", "i", n("ok")), *((f"{a}_count", "i", hits(a)) for a in ("tp", "fp", "tn", "fn")), ("accuracy", "f", rate("ok", "ok")),
             ("precision", "f", g("ok", _nz(f"{hits('tp')}::double", f"({hits('tp')} + {hits('fp')})"))), ("recall", "f", g("ok", _nz(f"{hits('tp')}::double", f"({hits('tp')} + {hits('fn')})")))],
        ),
        "bool_transition_profile": (
            lambda f: getattr(f, f"{word}_bool_transition_profile")("b", "o", LAG, o),
            [("transition_count", "i", n("tog")), ("rising_count", "i", hits("rise")), ("falling_count", "i", hits("fall")), ("toggle_count", "i", hits("tog")), ("rising_rate", "f", rate("tog", "rise")), ("falling_rate", "f", rate("tog", "fall")), ("toggle_rate", "f", rate("tog", "tog"))],
        ),
        "correlation_profile": (
            lambda f: getattr(f, f"{word}_correlation_profile")("x", "y", "o", o),
            [("pair_count", "i", k), ("covariance", "f", g("px", cov)), ("correlation", "f", g("px", _nz(cov, f"sqrt({vx} * {vy})"))), ("beta", "f", g("px", _nz(cov, vx)))],
        ),
        "linear_fit_profile": (
            lambda f: getattr(f, f"{word}_linear_fit_profile")("x", "y", "o", o),
            [("pair_count", "i", k), ("slope", "f", g("px", slope)), ("intercept", "f", g("px", icept)), ("fitted", "f", g("px", fit, pair)), ("residual", "f", g("px", f"py - {fit}", pair)), ("residual_zscore", "f", g("px", resz, pair))],
        ),
        "validity_profile": (
            lambda f: getattr(f, f"{word}_validity_profile")("x", "o", o),
            [("validity_count", "i", n("*")), ("valid_count", "i", n("x")), ("null_count", "i", hits("x is null")), ("valid_rate", "f", g("*", f"{n('x')}::double / {n('*')}")), ("null_rate", "f", g("*", f"{hits('x is null')}::double / {n('*')}"))],
        ),
    }
    if word == "rolling":
        out["range_profile"] = (
            lambda f: f.rolling_range_profile("x", "o", o),
            [(a, "f", g("x", e, here)) for a, e in (("low", f"min(x) over {w}"), ("high", f"max(x) over {w}"), ("range", f"max(x) over {w} - min(x) over {w}"), ("position", _nz(f"(x - min(x) over {w})", f"(max(x) over {w} - min(x) over {w})")))],
        )
        peak = f"arg_max(rn, x * 1000000000 + rn) filter (x is not null) over {w}"
        out["drawdown_profile"] = (
            lambda f: f.rolling_drawdown_profile("x", "o", o),
            [("peak", "f", g("x", f"max(x) over {w}", here)), ("drawdown", "f", g("x", f"x - max(x) over {w}", here)), ("drawdown_pct", "f", g("x", _nz(f"(x - max(x) over {w})", f"(max(x) over {w})"), here)), ("peak_age", "i", g("x", f"rn - {peak}", here))],
        )
    return {f"{word}_{name}": (f, [(f"{word}_{s}", kind, e) for s, kind, e in cols]) for name, (f, cols) in out.items()}


SPECS = _ROWS | _summaries("rolling", "wr", 3, ROLL) | _summaries("expanding", "we", 2, EXPAND)

_FIT = f"""{_STEPS}, a as (select *, count(px) over wall as n, sum(px) over wall as sx, sum(py) over wall as sy, sum(px * px) over wall as xx, sum(px * py) over wall as xy from s4 window wall as (partition by user_id)),
f as (select *, {_nz("(n * xy - sx * sy)", "(n * xx - sx * sx)")} as k from a), h as (select *, (sy - k * sx) / n + k * px as fit from f),
r as (select *, py - fit as res, sqrt(avg((py - fit) * (py - fit)) over (partition by user_id)) as sd from h)
select event_id, {", ".join(f"round(case when px is not null and n >= 2 then {e} end, {DIGITS}) as o_{c}" for c, e in (("fitted", "fit"), ("residual", "res"), ("residual_zscore", _nz("res", "sd")), ("slope", "k")))} from r"""
_ROBUST = f"""{_STEPS}, q as (select user_id, quantile_cont(x, 0.25) as q1, quantile_cont(x, 0.5) as q2, quantile_cont(x, 0.75) as q3, mad(x) as m, count(x) as n from s0 group by user_id)
select event_id, {", ".join(f"round(case when x is not null and n >= 2 then {e} end, {DIGITS}) as o_{c}" for c, e in (("median_centered", "x - q2"), ("mad_zscore", _nz("(0.6744897501960817 * (x - q2))", "m")), ("winsorized", "least(greatest(x, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1))")))},
case when x is not null and n >= 2 then x < q1 - 1.5 * (q3 - q1) or x > q3 + 1.5 * (q3 - q1) end as o_iqr_outlier from s0 join q using (user_id)"""
_EMA = f"""with recursive s0 as (select event_id, user_id, {_X} as x from events),
v as (select *, row_number() over (partition by user_id order by event_id) as i from s0 where x is not null),
e as (select user_id, event_id, i, x, x as ema from v where i = 1 union all select v.user_id, v.event_id, v.i, v.x, 0.25 * v.x + 0.75 * e.ema from v join e on v.user_id = e.user_id and v.i = e.i + 1)
select s0.event_id, round(case when i >= 2 then ema end, {DIGITS}) as o_ema, round(case when i >= 2 then e.x - ema end, {DIGITS}) as o_ema_residual, round(case when i >= 2 then {_nz("e.x", "ema")} end, {DIGITS}) as o_ema_ratio from s0 left join e using (event_id)"""


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def _query(f: Callable[[Frame], Frame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = f(events(spark, sf_dir)).df
        return rounded(out.select("event_id", *(c for c in out.columns if c.startswith("o_"))))

    return run


QUERIES = {name: _query(f) for name, (f, _) in SPECS.items()} | {
    "linear_fit_profile": _query(lambda f: f.linear_fit_profile("x", "y", "o", EXPAND)),
    "robust_profile": _query(lambda f: f.robust_profile("x", "o", EXPAND)),
    "ema_profile": _query(lambda f: f.ema_profile("x", "o", EmaOptions(0.25, 2))),
}


def rolling_profile_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame without a partition key, in blocks."""
    f = Frame(events(spark, sf_dir).df, ["event_id"])
    out = f.rolling_blocked(lambda g: g.rolling_profile("x", "o", ROLL), behind=ROLL.window - 1).df
    return rounded(out.select("event_id", *(c for c in out.columns if c.startswith("o_"))))


QUERIES["rolling_profile_blocked"] = rolling_profile_blocked
ORACLE_SQL = {name: _select("o", cols) for name, (_, cols) in SPECS.items()} | {"linear_fit_profile": _FIT, "robust_profile": _ROBUST, "ema_profile": _EMA}
ORACLE_SQL["rolling_profile_blocked"] = ORACLE_SQL["rolling_profile"].replace("wr as (partition by user_id order", "wr as (order")
