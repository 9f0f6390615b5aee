"""Relational operators on small frames with nulls and ties."""

from __future__ import annotations

import math

import pytest

from tessera.operators.frame import Frame, empty_frame, frame_of
from tessera.plans.options import AsofOptions, LagOptions, RollingOptions, SortOptions


def column(frame, name):
    return [r[name] for r in frame.collect()]


@pytest.fixture(scope="module")
def sides(spark):
    left = frame_of(spark, [(0, 1, 10.0), (1, 2, 20.0), (2, 3, 30.0), (3, 2, 21.0), (4, None, 90.0)], "rid int, id int, value double")
    right = frame_of(spark, [(0, 2, 200.0), (1, 2, 201.0), (2, 3, 300.0), (3, None, 900.0)], "rid int, id int, value double")
    return left, right


def test_inner_join_skips_null_keys_and_renames(sides):
    left, right = sides
    out = left.inner_join(right, "id", "id").df
    assert out.columns == ["rid", "id", "value", "rid_right", "value_right"]
    assert sorted((r["id"], r["value"], r["value_right"]) for r in out.collect()) == [(2, 20.0, 200.0), (2, 20.0, 201.0), (2, 21.0, 200.0), (2, 21.0, 201.0), (3, 30.0, 300.0)]


def test_left_semi_anti(sides):
    left, right = sides
    assert column(left.semiJoin(right, "id", "id"), "value") == [20.0, 30.0, 21.0]
    assert column(left.antiJoin(right, "id", "id"), "value") == [10.0, 90.0]
    assert column(left.leftJoin(right, "id", "id"), "value_right").count(None) == 2
    assert left.left_join(right, "id", "id").df.count() == 7


def test_full_join_keeps_null_keys_of_both(sides):
    left, right = sides
    out = left.full_join(right, "id", "id").df.collect()
    assert sum(r["id"] is None for r in out) == 2
    assert len(out) == 8


def test_join_types_must_match(sides, spark):
    other = frame_of(spark, [(0, 2)], "rid int, id long")
    with pytest.raises(TypeError):
        sides[0].inner_join(other, "id", "id")


@pytest.mark.parametrize(("strategy", "expected"), [("previous", [None, 10, 60, 100, None]), ("next", [10, 60, 60, None, None]), ("nearest", [10, 10, 60, 100, None])])
def test_asof(spark, strategy, expected):
    left = frame_of(spark, [(0, 1), (1, 7), (2, 10), (3, 20), (4, None)], "rid int, time int")
    right = frame_of(spark, [(0, 5, 10), (1, 5, 20), (2, 10, 60), (3, 10, 61), (4, 15, 100), (5, None, 7)], "rid int, time int, quote int")
    assert column(left.asof_join(right, "time", "time", AsofOptions(strategy)), "quote") == expected


def test_distinct_drops_null_keys_and_keeps_first(spark):
    f = frame_of(spark, [(0, 1, 10), (1, 1, 11), (2, None, 12), (3, 2, 13)], "rid int, id int, v int")
    assert column(f.distinct_on(["id"]), "v") == [10, 13]


def test_sort_is_stable_and_nulls_last(spark):
    f = frame_of(spark, [(0, 1.0), (1, None), (2, float("nan")), (3, 1.0)], "rid int, v double")
    assert [r["rid"] for r in f.sort_by("v", SortOptions(descending=True)).collect()] == [2, 0, 3, 1]


def test_types_are_checked(spark):
    f = frame_of(spark, [(0, 1, 2, True)], "rid int, a int, b int, c boolean")
    with pytest.raises(TypeError):
        f.binary_columns("a", "b", "div", "q")
    with pytest.raises(TypeError):
        f.compare_columns("c", "c", "gt", "q")
    with pytest.raises(ValueError):
        f.with_column("a", f.df["b"])


def test_ieee_division_and_nan_comparison(spark):
    nan = float("nan")
    f = frame_of(spark, [(0, 1.0, 0.0), (1, -1.0, 0.0), (2, 0.0, 0.0), (3, nan, nan)], "rid int, a double, b double")
    q = column(f.binary_columns("a", "b", "div", "q"), "q")
    assert q[0] == math.inf and q[1] == -math.inf and math.isnan(q[2])
    assert column(f.compare_columns("a", "b", "eq", "e"), "e")[3] is False


@pytest.mark.parametrize("bad", [lambda: RollingOptions(0), lambda: RollingOptions(3, 4), lambda: RollingOptions(3, 0), lambda: LagOptions(0)])
def test_options_refuse_bad_shapes(bad):
    with pytest.raises(ValueError):
        bad()


def test_group_by_skips_null_keys_and_values(spark):
    f = frame_of(spark, [(0, 1, 2), (1, 1, None), (2, None, 5), (3, 2, None)], "rid int, k int, v int")
    out = f.group_by_stats("k", "v", "s").collect()
    assert [(r["k"], r["s_count"], r["s_sum"], r["s_mean"]) for r in out] == [(1, 1, 2, 2.0)]
    assert dict(f.group_by_sum("k", "v", "s").dtypes)["s"] == "int"


def test_nan_scalars_filter_as_ieee_has_it(spark):
    f = frame_of(spark, [(0, 1.0), (1, float("nan")), (2, None)], "rid int, x double")
    kept = {op: [r["rid"] for r in f.filter_column_scalar("x", float("nan"), op).collect()] for op in ("eq", "ne", "lt", "le", "gt", "ge")}
    assert kept == {"eq": [], "ne": [0, 1], "lt": [], "le": [], "gt": [], "ge": []}


def test_join_names_stay_apart(spark):
    a = frame_of(spark, [(0, 1, 2, 3)], "rid int, k int, v int, v_right int")
    b = frame_of(spark, [(0, 1, 9)], "rid int, k int, v int")
    assert a.inner_join(b, "k", "k").df.columns == ["rid", "k", "v", "v_right", "rid_right", "v_right_right"]


def test_masks_matrices_and_sinks(spark, tmp_path, capsys):
    f = frame_of(spark, [(2, 2.0, 5), (0, 0.5, None), (1, 1.0, 4)], "rid int, x double, n int")
    assert [r["rid"] for r in f.filter([True, False, True]).collect()] == [0, 2]
    with pytest.raises(ValueError):
        f.filter([True])
    m = f.to_matrix().to_numpy()
    assert m[:, 0].tolist() == [0.5, 1.0, 2.0] and m[1:, 1].tolist() == [4.0, 5.0] and m[0, 1] != m[0, 1]
    f.write_parquet(str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3
    f.write_csv(str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 3
    assert empty_frame(spark, "rid int, x double", ["rid"]).shape() == (0, 2)
    assert f.column("x").to_array() == [0.5, 1.0, 2.0]
    at = spark.createDataFrame([(0, 2), (1, 0)], "at int, index int")
    assert [r["rid"] for r in f.take(at).orderBy("at").collect()] == [2, 0]
    f.print()


@pytest.fixture(scope="module")
def spread(spark):
    """Rows too many for Spark's samples of ranges to hold them all, in several
    ranges although they are small."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark.range(0, 60_000, 1, 6).selectExpr("id * 7919 % 60000 as rid", "case when id % 9 <> 0 then cast(id * id % 25 as double) end as v", "cast(id % 7 as string) as s")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("o", [SortOptions(), SortOptions(descending=True), SortOptions(nulls="first"), SortOptions(True, "first")])
def test_positions_of_tables_beyond_a_sample(spread, o):
    rows = [(r["v"], r["rid"]) for r in spread.collect()]
    nulls = lambda v: (v is not None) if o.nulls == "first" else (v is None)
    want = [rid for _, rid in sorted(rows, key=lambda r: (nulls(r[0]), (-1 if o.descending else 1) * (r[0] or 0), r[1]))]
    out = Frame(spread, ["rid"]).argsort_by("v", o).df
    assert [r["rid"] for r in sorted(out.collect(), key=lambda r: r["argsort"])] == want
    assert sorted(r["argsort"] for r in out.select("argsort").collect()) == list(range(60_000))


def test_ranks_of_tables_beyond_a_sample(spark, spread):
    spread.createOrReplaceTempView("spread")
    want = spark.sql("select rid, row_number() over (order by v nulls last, rid) as o, rank() over w as c, dense_rank() over w as d, percent_rank() over w as p, cume_dist() over w as u from spread window w as (order by v nulls last)")
    out = Frame(spread, ["rid"]).rank_profile_by("v", "r").df.select("rid", "r_ordinal_rank", "r_competition_rank", "r_dense_rank", "r_percent_rank", "r_cume_dist")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))
    distinct = Frame(spread, ["rid"]).rank_profile_by("rid", "r").df
    assert all(r["rid"] + 1 == r["r_ordinal_rank"] == r["r_competition_rank"] == r["r_dense_rank"] for r in distinct.collect())


def test_positions_by_keys_of_any_type(spark, spread):
    f = Frame(spread, ["s", "rid"])
    want = [(r["s"], r["rid"]) for r in spread.orderBy("s", "rid").collect()]
    assert [tuple(r) for r in f._numbered("i").orderBy("i").select("s", "rid").collect()] == want
    at = spark.createDataFrame([(i, i) for i in (0, 1, 29_999, 59_999, 60_000)], "at long, index long")
    assert {r["at"]: (r["s"], r["rid"]) for r in f.take(at).collect()} == {i: want[i] for i in (0, 1, 29_999, 59_999)}
    nan = float("nan")
    odd = spark.createDataFrame([(i, x, (x, i)) for i, x in enumerate([nan, -0.0, 0.0, None, 1.5, nan, None, float("-inf")] * 20)], "rid int, x double, k struct<x:double,i:int>")
    for names in (["x", "rid"], ["k"]):
        found = Frame(odd, names)._numbered("i").orderBy("i").collect()
        assert [r["i"] for r in found] == list(range(160))
        assert [r["rid"] for r in found][:20 * 2] == [i for i in range(160) if i % 8 in (3, 6)]
    none = odd.where("rid < 0")
    assert Frame(none, ["rid"]).argsort_by("x").df.collect() == [] == Frame(none, ["rid"]).rank_profile_by("x", "r").df.collect()
    one = Frame(odd.where("rid = 4"), ["rid"]).rank_profile_by("x", "r").df.first()
    assert (one["r_ordinal_rank"], one["r_dense_rank"], one["r_percent_rank"], one["r_cume_dist"]) == (1, 1, 0.0, 1.0)
