"""Dense linear algebra on matrices that fit one machine, plain and per group,
and tall matrices as tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lu(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(p, l, u) with p @ a = l @ u, by partial pivoting."""
    u, n = np.array(a, float), len(a)
    l, p = np.eye(n), np.eye(n)
    for k in range(n):
        m = k + int(np.argmax(np.abs(u[k:, k])))
        if u[m, k] == 0:
            continue
        u[[k, m]], p[[k, m]] = u[[m, k]], p[[m, k]]
        l[[k, m], :k] = l[[m, k], :k]
        l[k + 1 :, k] = u[k + 1 :, k] / u[k, k]
        u[k + 1 :] -= np.outer(l[k + 1 :, k], u[k])
    return p, l, np.triu(u)


def solve_triangular(a: np.ndarray, b: np.ndarray, lower: bool = True, unit: bool = False) -> np.ndarray:
    a, x = np.asarray(a, float), np.array(b, float)
    order = range(len(a)) if lower else range(len(a) - 1, -1, -1)
    for i in order:
        done = slice(0, i) if lower else slice(i + 1, None)
        x[i] -= a[i, done] @ x[done]
        if not unit:
            if a[i, i] == 0:
                raise np.linalg.LinAlgError("zero on the diagonal")
            x[i] /= a[i, i]
    return x


def matrix_norm(a: np.ndarray, order: str = "fro") -> float:
    return float(np.linalg.norm(a, {"fro": "fro", "one": 1, "inf": np.inf, "two": 2, "nuclear": "nuc"}[order]))


MATRIX: dict[str, Callable] = {
    "cholesky": np.linalg.cholesky, "qr": np.linalg.qr, "svd": np.linalg.svd, "singular_values": lambda a: np.linalg.svd(a, compute_uv=False), "matrix_rank": np.linalg.matrix_rank, "cond": np.linalg.cond, "pinv": np.linalg.pinv,
    "matrix_norm": matrix_norm, "eigh": np.linalg.eigh, "eigvalsh": np.linalg.eigvalsh, "lstsq": lambda a, b: np.linalg.lstsq(a, b, rcond=None)[0], "lu": lu, "solve_triangular": solve_triangular, "det": np.linalg.det,
    "inverse": np.linalg.inv, "solve": np.linalg.solve, "trace": np.trace, "matmul": np.matmul, "matvec": np.matmul, "eye": np.eye, "matrix_power": np.linalg.matrix_power,
}


def det(a: np.ndarray) -> np.ndarray:
    """Determinants of a stack. Small matrices are eliminated in extended
    precision, so that those of whole numbers come out whole."""
    n = a.shape[-1]
    if n > 16 or a.shape[-2] != n:
        return np.linalg.det(a)
    u, out, m = np.array(a, np.longdouble), np.ones(len(a), np.longdouble), np.arange(len(a))
    for k in range(n):
        at = k + np.argmax(np.abs(u[:, k:, k]), 1)
        u[m, at], u[:, k] = u[:, k].copy(), u[m, at]
        out *= np.where(at == k, 1, -1) * u[:, k, k]
        with np.errstate(divide="ignore", invalid="ignore"):
            by = np.where((u[:, k, k] == 0)[:, None], 0, u[:, k + 1 :, k] / u[:, k, k][:, None])
        u[:, k + 1 :] -= by[:, :, None] * u[:, k][:, None]
    return out.astype(float)


#: Those that need other calls for a stack of matrices.
STACKED: dict[str, Callable] = {"trace": lambda a: np.trace(a, axis1=1, axis2=2), "det": det}


#: Names of the parts of results that are several arrays.
PARTS = {"qr": ("q", "r"), "svd": ("u", "s", "vt"), "eigh": ("values", "vectors"), "lu": ("p", "l", "u")}
LONG = "part string, row long, col long, val double"


#: Functions that take one matrix at a time; the others take stacks.
ALONE = {"matrix_norm", "lstsq", "lu", "solve_triangular"}


def _cells(df: DataFrame, key: str, name: str, row: str, col: str, val: str) -> DataFrame:
    """One row a group, its matrix as a list of cells."""
    return df.groupBy(F.col(key).alias("key")).agg(F.collect_list(F.struct(F.col(row).cast("long").alias("i"), F.col(col).cast("long").alias("j"), F.col(val).cast("double").alias("v"))).alias(name))


def _stacks(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which groups, their matrices as a stack), by shape."""
    cells, sizes = lists.flatten().flatten(), lists.value_lengths().to_numpy()
    if cells[0].null_count or cells[1].null_count:
        raise ValueError("a cell without a row or a column")
    i, j, v = (c.to_numpy(zero_copy_only=False) for c in cells)
    starts, of = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(lists)), sizes)
    shapes, which = np.unique(np.stack([np.maximum.reduceat(i, starts), np.maximum.reduceat(j, starts)], 1) + 1, axis=0, return_inverse=True)
    for k, (rows, cols) in enumerate(shapes):
        groups, mine = np.flatnonzero(which.ravel() == k), which.ravel()[of] == k
        a = np.zeros((len(groups), rows, cols))
        a[np.searchsorted(groups, of[mine]), i[mine], j[mine]] = v[mine]
        yield groups, a


def _long(keys: pa.Array, op: str, found: object) -> Iterator[pa.RecordBatch]:
    """Numbers, arrays or several a group as rows (key, part, row, col, val); a
    vector is a column."""
    parts = found if isinstance(found, tuple) else (found,)
    for name, x in zip(PARTS.get(op, ("",)), parts, strict=True):
        x = np.asarray(x, float)
        x = x.reshape(*x.shape, *(1,) * (3 - x.ndim))
        g, i, j = (n.ravel() for n in np.indices(x.shape))
        yield pa.RecordBatch.from_arrays([keys.take(pa.array(g)), pa.array([name]).take(pa.array(np.zeros_like(g))), pa.array(i), pa.array(j), pa.array(x.ravel())], ["key", "part", "row", "col", "val"])


def _alone(f: Callable, *stacks: np.ndarray) -> object:
    found = [f(*one) for one in zip(*stacks, strict=True)]
    return tuple(np.stack(p) for p in zip(*found, strict=True)) if isinstance(found[0], tuple) else np.stack(found)


def _each(groups: DataFrame, op: str, names: Sequence[str]) -> DataFrame:
    """``op`` of the matrices ``names`` of every row. Matrices of equal shapes in
    a batch of groups are one stack, so that a small one costs no call."""
    f = (lambda *x: _alone(MATRIX[op], *x)) if op in ALONE else STACKED.get(op, MATRIX[op])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            first, *rest = (list(_stacks(b.column(n))) for n in names)
            for groups, a in first:
                if not rest:
                    yield from _long(b.column("key").take(pa.array(groups)), op, f(a))
                for others, c in (x for r in rest for x in r):
                    both, at, to = np.intersect1d(groups, others, assume_unique=True, return_indices=True)
                    if len(both):
                        yield from _long(b.column("key").take(pa.array(both)), op, f(a[at], c[to]))

    return groups.mapInArrow(run, f"key {groups.schema['key'].dataType.simpleString()}, {LONG}")


def per_group(df: DataFrame, key: str, op: str, row: str = "row", col: str = "col", val: str = "val") -> DataFrame:
    """One matrix a group, as (key, part, row, col, val); ``op`` gives a number,
    an array, or several arrays, told apart by ``part``. A group's matrix fits one
    worker; groups are spread over the cluster."""
    return _each(_cells(df, key, "a", row, col, val), op, ["a"])


def per_group_with(a: DataFrame, b: DataFrame, key: str, op: str, row: str = "row", col: str = "col", val: str = "val") -> DataFrame:
    """Operators of two matrices (solve, lstsq, solve_triangular, matmul, matvec)
    by group; groups of one side only are left out. Both may come from one table:
    the key of ``b`` has a name of its own."""
    right = _cells(b, key, "b", row, col, val).withColumnRenamed("key", "__key")
    both = _cells(a, key, "a", row, col, val).join(right, F.col("key").eqNullSafe(F.col("__key")))
    return _each(both.select("key", "a", "b"), op, ["a", "b"])


def tall_qr(df: DataFrame, vector: str) -> tuple[DataFrame, np.ndarray]:
    """(rows with ``q``, R) of a tall matrix of full column rank: R is the
    Cholesky factor of A^T A, and Q = A R^-1 is a projection of each row."""
    r = np.linalg.cholesky(gram(df, vector)).T
    inverse = np.linalg.inv(r)
    dot = lambda c: F.aggregate(F.zip_with(vector, F.array(*(F.lit(float(x)) for x in c)), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    return df.withColumn("q", F.array(*(dot(inverse[:, j]) for j in range(r.shape[1])))), r


def gram(df: DataFrame, vector: str) -> np.ndarray:
    """A^T A of a tall matrix of rows ``vector``: partial sums by task, so only
    d x d numbers a task are moved."""
    d = len(df.select(vector).first()[0])

    def run(batches):
        g = np.zeros((d, d))
        for b in batches:
            x = np.stack(b[vector].to_numpy()).astype(float)
            g += x.T @ x
        i, j = np.indices(g.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": g.ravel()})

    out = np.zeros((d, d))
    for r in df.select(vector).mapInPandas(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = r["v"]
    return out


def tall_singular_values(df: DataFrame, vector: str) -> np.ndarray:
    return np.sqrt(np.maximum(np.linalg.eigvalsh(gram(df, vector))[::-1], 0))


def least_squares(df: DataFrame, features: list[str], target: str) -> np.ndarray:
    """Ordinary least squares (no intercept) by one aggregation of products."""
    names = [*features, target]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    r = df.dropna(subset=names).agg(*(F.sum(F.col(a).cast("double") * F.col(b)).alias(f"s{i}") for i, (a, b) in enumerate(pairs))).first()
    m = {p: r[i] for i, p in enumerate(pairs)}
    k = len(features)
    a = np.array([[m.get((features[i], features[j]), m.get((features[j], features[i]))) for j in range(k)] for i in range(k)])
    return np.linalg.solve(a, np.array([m[(f, target)] for f in features]))
