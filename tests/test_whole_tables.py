"""Registered queries take whole tables: fixtures larger than any id subset."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessera.plans import relational_queries
from tessera.plans.array_queries import QUERIES


@pytest.fixture(scope="module")
def vectors(tmp_path_factory):
    at, a = tmp_path_factory.mktemp("vectors"), np.random.default_rng(4).normal(size=(253, 64)).astype(np.float32)
    a[252, 3] = 9.0
    pq.write_table(pa.table({"vec_id": np.arange(253), "label": np.arange(253) % 3, "embedding": a.tolist()}), at / "embeddings.parquet")
    return str(at), a.astype(float)


def test_coordinate_queries_take_all_vectors(spark, vectors):
    at, a = vectors
    run = lambda name: QUERIES[name](spark, at).toPandas()

    def dense(df, shape, v="v"):
        out = np.full(shape, np.nan)
        out[tuple(df[f"i{k}"].to_numpy() for k in range(len(shape)))] = df[v].to_numpy()
        assert len(df) == np.sum(~np.isnan(out))
        return out

    close = lambda x, y: np.testing.assert_allclose(x, y, atol=1e-5)
    close(dense(run("coo_matmul"), (64, 64)), a.T @ a)
    close(dense(run("einsum_rowwise"), (253,)), (a * a).sum(1))
    moved = np.roll(a[::-1], 3, 1).ravel()
    close(dense(run("coo_transforms"), (51, 320)).ravel()[: moved.size], moved)
    close(dense(run("coo_narrow_triu"), (50, 64)), np.where(np.triu(np.ones((50, 64)), 2) > 0, a[10:60], np.nan))
    r = run("coo_reductions").sort_values("i1")
    for name, want in {"s": a.sum(0), "m": a.mean(0), "lo": a.min(0), "hi": a.max(0), "am": a.argmin(0) * 64 + np.arange(64), "n": np.sqrt((a * a).sum(0))}.items():
        close(r[name], want)
    c, e = run("coo_cumulative_softmax"), np.exp(a)
    close(dense(c, a.shape, "c"), a.cumsum(1))
    close(dense(c, a.shape, "p"), e / e.sum(1, keepdims=True))
    close(dense(run("coo_broadcast"), a.shape), a - a.mean(0))


def test_sets_take_both_halves_of_a_vector(spark, vectors):
    at, a = vectors
    for r in QUERIES["array_sets"](spark, at).collect():
        p, q = (np.floor(x * 4).astype(int).tolist() for x in (a[r["vec_id"], :32], a[r["vec_id"], 32:]))
        want = [sorted(set(p)), sorted({*p, *q}), sorted({*p} & {*q}), sorted({*p} - {*q}), sum(x in q for x in p)]
        assert [r["u"], r["un"], r["i"], r["d"], r["n"]] == want


def test_sparse_product_takes_all_columns(spark, tmp_path):
    rng = np.random.default_rng(6)
    cust, key, price = rng.integers(0, 400, 900), np.arange(900), rng.integers(0, 90, 900) * 1000.0
    pq.write_table(pa.table({"o_custkey": cust, "o_orderkey": key, "o_totalprice": price}), tmp_path / "orders.parquet")
    s, seen = np.zeros((150, 97)), np.zeros((150, 97))
    np.add.at(s, (cust % 150, key % 97), price // 1000)
    np.add.at(seen, (cust % 150, key % 97), 1)
    seen = seen > 0
    got = {(r["row"], r["col"]): r["val"] for r in QUERIES["sparse_matmat"](spark, str(tmp_path)).collect()}
    assert got == {(i, j): (s.T @ s)[i, j] for i, j in np.argwhere(seen.T.astype(int) @ seen.astype(int)).tolist()}


def test_joins_on_two_keys_take_all_customers(spark, tmp_path):
    s = [(k, k * 7 % 25, float(k)) for k in range(1, 13)]
    c = [(k, k * 11 % 25, float(k)) for k in range(1, 41)]
    spark.createDataFrame(s, "s_suppkey long, s_nationkey long, s_acctbal double").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.createDataFrame(c, "c_custkey long, c_nationkey long, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    keys = lambda rows: {r[0]: (r[1], r[0] % 3) for r in rows}
    left, right = keys(s), keys(c)
    pairs = {(a, b) for a in left for b in right if left[a] == right[b]}
    met, of = {a for a, _ in pairs}, {b for _, b in pairs}
    assert met != set(left) and any(b % 10 != 1 for b in of)
    alone = {(a, None) for a in set(left) - met}
    rest = {(None, b) for b in set(right) - of}
    rows = lambda name: sorted(relational_queries.QUERIES[name](spark, str(tmp_path)).collect(), key=str)
    by = lambda found: sorted(found, key=str)
    assert by(tuple(r) for r in rows("inner_join_on")) == by(pairs)
    assert by(tuple(r) for r in rows("left_join_on")) == by(pairs | alone)
    assert by(tuple(r) for r in rows("full_join_on")) == by((a, b, *(left[a] if a else right[b])) for a, b in pairs | alone | rest)
    assert by(r[0] for r in rows("semi_join_on")) == by(met)
    assert by(r[0] for r in rows("anti_join_on")) == by(set(left) - met)
