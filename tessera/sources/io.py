"""Sources and sinks: CSV text, Parquet scans, Arrow tables, array archives."""

from __future__ import annotations

import csv
import io
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class ParquetScan:
    """A lazy scan: projection and range become Spark's own pushed filters, so
    row groups are pruned and rows are filtered exactly."""

    spark: SparkSession
    path: str
    names: tuple[str, ...] | None = None
    ranges: tuple[tuple[str, object, object], ...] = ()

    def select(self, names: Sequence[str]) -> ParquetScan:
        return replace(self, names=tuple(names))

    def where_range(self, name: str, low: object = None, high: object = None) -> ParquetScan:
        return replace(self, ranges=(*self.ranges, (name, low, high)))

    def collect(self) -> DataFrame:
        df = self.spark.read.parquet(self.path)
        for name, low, high in self.ranges:
            if low is not None:
                df = df.where(F.col(name) >= F.lit(low))
            if high is not None:
                df = df.where(F.col(name) <= F.lit(high))
        return df.select(*self.names) if self.names is not None else df

    lazy = collect

    def explain(self) -> None:
        self.collect().explain("formatted")


def scan_parquet(spark: SparkSession, path: str) -> ParquetScan:
    return ParquetScan(spark, path)


def read_csv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """A CSV file. A column is bigint, double or boolean if every cell parses as
    that, in this order, else string; without a header names are col0, col1, ...
    Types are found by one aggregation over the text, not by a sample."""
    df = spark.read.csv(path, header=header, inferSchema=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, nullValue="\x00")
    if not header:
        df = df.toDF(*(f"col{i}" for i in range(len(df.columns))))
    tests = {"bigint": lambda c: c.rlike(r"^[+-]?\d{1,18}$"), "double": lambda c: c.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(nan|NaN|inf|Infinity)$"), "boolean": lambda c: F.lower(c).isin("true", "false")}
    found = df.agg(*(F.min(F.coalesce(t(F.col(f"`{c}`")), F.lit(False))).alias(f"{i}|{k}") for i, c in enumerate(df.columns) for k, t in tests.items())).first()
    kinds = [next((k for k in tests if found[f"{i}|{k}"]), "string") for i in range(len(df.columns))]
    return df.select(*(F.col(f"`{c}`").cast(k).alias(c) for c, k in zip(df.columns, kinds, strict=True)))


def parse_csv(spark: SparkSession, text: str, header: bool = True) -> DataFrame:
    """CSV text on the driver; blank lines are skipped, ragged rows are refused."""
    rows = [[c.strip(" \t\"") for c in r] for r in csv.reader(io.StringIO(text)) if any(c.strip() for c in r)]
    if len({len(r) for r in rows}) > 1:
        raise ValueError("rows differ in length")
    names, body = (rows[0], rows[1:]) if header and rows else ([f"col{i}" for i in range(len(rows[0]) if rows else 0)], rows)
    if not names:
        raise ValueError("no columns")

    def typed(cells: list[str]) -> tuple[T.DataType, list]:
        for kind, parse in ((T.LongType(), int), (T.DoubleType(), float), (T.BooleanType(), lambda c: {"true": True, "false": False}[c.lower()])):
            try:
                return kind, [parse(c) for c in cells]
            except (ValueError, KeyError):
                continue
        return T.StringType(), cells

    cols = [typed([r[i] for r in body]) for i in range(len(names))]
    schema = T.StructType([T.StructField(n, k) for n, (k, _) in zip(names, cols, strict=True)])
    return spark.createDataFrame(list(zip(*(v for _, v in cols), strict=True)), schema)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, quote="")


def from_arrow(spark: SparkSession, table: pa.Table | pa.RecordBatch, columns: Sequence[str] | None = None) -> DataFrame:
    table = pa.Table.from_batches([table]) if isinstance(table, pa.RecordBatch) else table
    return spark.createDataFrame(table.select(list(columns)) if columns is not None else table)


def empty_from_arrow_schema(spark: SparkSession, schema: pa.Schema) -> DataFrame:
    return spark.createDataFrame(schema.empty_table())


def to_arrow_batches(df: DataFrame) -> list[pa.RecordBatch]:
    return df.toArrow().to_batches()


def save_array(spark: SparkSession, array: np.ndarray, path: str, rows_per_block: int = 1 << 16) -> None:
    """An array archive: Parquet rows (start, bytes) of a flat little-endian
    buffer, with type and shape in every row."""
    flat = np.ascontiguousarray(array).reshape(-1)
    step = rows_per_block
    rows = [(i, bytearray(flat[i : i + step].tobytes())) for i in range(0, max(1, len(flat)), step)]
    df = spark.createDataFrame(rows, "start long, data binary")
    df.select("*", F.lit(str(array.dtype)).alias("dtype"), F.array(*(F.lit(int(n)) for n in array.shape)).cast("array<long>").alias("shape")).write.mode("overwrite").parquet(path)


def load_array(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(path).orderBy("start").collect()
    return np.frombuffer(b"".join(bytes(r["data"]) for r in rows), rows[0]["dtype"]).reshape(rows[0]["shape"])
