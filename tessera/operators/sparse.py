"""Sparse matrices as tables (row, col, val); products are joins."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Sparse:
    """Vectors are tables (i, v). Compressed forms are read and written, not
    kept: a shuffled table has no row pointers."""

    df: DataFrame
    rows: int
    cols: int

    @classmethod
    def from_csr(cls, spark: SparkSession, indptr, indices, data, shape: tuple[int, int]) -> Sparse:
        indptr, indices, data = np.asarray(indptr, np.int64), np.asarray(indices, np.int64), np.asarray(data, float)
        if len(indptr) != shape[0] + 1 or indptr[0] != 0 or indptr[-1] != len(indices) or len(indices) != len(data) or (np.diff(indptr) < 0).any():
            raise ValueError("row pointers do not fit")
        if len(indices) and (indices.min() < 0 or indices.max() >= shape[1]):
            raise IndexError("column out of bounds")
        rows = np.repeat(np.arange(shape[0]), np.diff(indptr))
        return cls(spark.createDataFrame(list(zip(rows.tolist(), indices.tolist(), data.tolist(), strict=True)), "row long, col long, val double"), *shape)

    @classmethod
    def from_csc(cls, spark: SparkSession, indptr, indices, data, shape: tuple[int, int]) -> Sparse:
        return cls.from_csr(spark, indptr, indices, data, shape[::-1]).transpose()

    @classmethod
    def from_dense(cls, spark: SparkSession, a: np.ndarray) -> Sparse:
        i, j = np.nonzero(a)
        return cls(spark.createDataFrame(list(zip(i.tolist(), j.tolist(), np.asarray(a, float)[i, j].tolist(), strict=True)), "row long, col long, val double"), *np.shape(a))

    def to_csr(self) -> Sparse:
        return self

    def to_dense(self) -> DataFrame:
        """Every element; the result has rows * cols rows."""
        grid = self.df.sparkSession.range(self.rows * self.cols).select(F.floor(F.col("id") / self.cols).cast("long").alias("row"), (F.col("id") % self.cols).alias("col"))
        return grid.join(self.df, ["row", "col"], "left").select("row", "col", F.coalesce("val", F.lit(0.0)).alias("val"))

    def nnz(self) -> int:
        return self.df.count()

    def density(self) -> float:
        return self.nnz() / (self.rows * self.cols) if self.rows * self.cols else 0.0

    def transpose(self) -> Sparse:
        return Sparse(self.df.select(F.col("col").alias("row"), F.col("row").alias("col"), "val"), self.cols, self.rows)

    def get(self, row: int, col: int) -> float:
        r = self.df.where((F.col("row") == row) & (F.col("col") == col)).agg(F.sum("val")).first()[0]
        return 0.0 if r is None else r

    # --- products ---

    def matvec(self, x: DataFrame) -> DataFrame:
        return self.df.join(x, self.df["col"] == x["i"]).groupBy(F.col("row").alias("i")).agg(F.sum(F.col("val") * F.col("v")).alias("v"))

    def transpose_matvec(self, x: DataFrame) -> DataFrame:
        return self.transpose().matvec(x)

    def matmat(self, other: Sparse) -> Sparse:
        b = other.df.select(F.col("row").alias("k"), F.col("col").alias("j"), F.col("val").alias("w"))
        out = self.df.join(b, self.df["col"] == b["k"]).groupBy("row", F.col("j").alias("col")).agg(F.sum(F.col("val") * F.col("w")).alias("val"))
        return Sparse(out, self.rows, other.cols)

    def transpose_matmat(self, other: Sparse) -> Sparse:
        return self.transpose().matmat(other)

    # --- statistics ---

    def _total(self, c: Column) -> float:
        return float(self.df.agg(F.coalesce(c, F.lit(0)).cast("double")).first()[0])

    def sum(self) -> float:
        return self._total(F.sum("val"))

    def abs_sum(self) -> float:
        return self._total(F.sum(F.abs("val")))

    def frobenius_norm(self) -> float:
        return self._total(F.sqrt(F.sum(F.col("val") * F.col("val"))))

    def trace(self) -> float:
        return self._total(F.sum(F.when(F.col("row") == F.col("col"), F.col("val"))))

    def bandwidth(self) -> int:
        return int(self._total(F.max(F.abs(F.col("row") - F.col("col")))))

    def zero_diagonal_count(self) -> int:
        return int(self._total(F.count_if((F.col("row") == F.col("col")) & (F.col("val") == 0))))

    def missing_diagonal_count(self) -> int:
        if self.rows != self.cols:
            raise ValueError("not square")
        return self.rows - int(self._total(F.count_if(F.col("row") == F.col("col"))))

    def _by(self, axis: str, agg: Column, n: int) -> DataFrame:
        every = self.df.sparkSession.range(n).select(F.col("id").alias("i"))
        part = self.df.groupBy(F.col(axis).alias("i")).agg(agg.alias("v"))
        return every.join(part, "i", "left").select("i", F.coalesce("v", F.lit(0)).alias("v"))

    def _statistics(self, axis: str, n: int) -> DataFrame:
        v = F.col("val")
        part = self.df.groupBy(F.col(axis).alias("i")).agg(F.count("*").alias("nnz"), F.sum(v).alias("sum"), F.sum(F.abs(v)).alias("abs_sum"), F.sqrt(F.sum(v * v)).alias("norm"))
        every = self.df.sparkSession.range(n).select(F.col("id").alias("i"))
        return every.join(part, "i", "left").select("i", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("nnz", "sum", "abs_sum", "norm")))

    def row_statistics(self) -> DataFrame:
        """(i, nnz, sum, abs_sum, norm) of every row, in one pass."""
        return self._statistics("row", self.rows)

    def column_statistics(self) -> DataFrame:
        return self._statistics("col", self.cols)

    def row_nnz(self) -> DataFrame:
        return self._by("row", F.count("*"), self.rows)

    def column_nnz(self) -> DataFrame:
        return self._by("col", F.count("*"), self.cols)

    def row_sums(self) -> DataFrame:
        return self._by("row", F.sum("val"), self.rows)

    def column_sums(self) -> DataFrame:
        return self._by("col", F.sum("val"), self.cols)

    def row_abs_sums(self) -> DataFrame:
        return self._by("row", F.sum(F.abs("val")), self.rows)

    def column_abs_sums(self) -> DataFrame:
        return self._by("col", F.sum(F.abs("val")), self.cols)

    def row_norms(self) -> DataFrame:
        return self._by("row", F.sqrt(F.sum(F.col("val") * F.col("val"))), self.rows)

    def column_norms(self) -> DataFrame:
        return self._by("col", F.sqrt(F.sum(F.col("val") * F.col("val"))), self.cols)

    def diagonal(self) -> DataFrame:
        return Sparse(self.df.where("row = col"), self.rows, self.cols)._by("row", F.sum("val"), min(self.rows, self.cols))

    def structurally_symmetric(self) -> bool:
        t = self.transpose().df
        return self.rows == self.cols and self.df.join(t, ["row", "col"], "left_anti").isEmpty()

    def numerically_symmetric(self, tolerance: float = 0.0) -> bool:
        t = self.transpose().df.withColumnRenamed("val", "w")
        gap = F.abs(F.coalesce("val", F.lit(0.0)) - F.coalesce("w", F.lit(0.0)))
        return self.rows == self.cols and self.df.join(t, ["row", "col"], "full").where(gap > tolerance).isEmpty()

    def solve_triangular(self, b: np.ndarray, lower: bool = True, unit: bool = False) -> np.ndarray:
        """Substitution is sequential by nature; it runs on the driver and is for
        matrices that fit there."""
        a = np.zeros((self.rows, self.cols))
        for r in self.df.toLocalIterator():
            a[r["row"], r["col"]] = r["val"]
        from tessera.operators.linalg import solve_triangular

        return solve_triangular(a, b, lower, unit)
