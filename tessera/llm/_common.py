"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch. Documents are kilobytes to megabytes long, so a
#: batch of Spark's default 10,000 rows would not fit a Python worker.
ARROW_ROWS = 256


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of Python workers that receive whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def _root(spark: SparkSession) -> str:
    """This application's folder in the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` is read from the session. Only a session on one
    machine, such as a test's, may do without: then it is a temporary folder. On a
    cluster parts of a table would lie on separate machines, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"


#: Folders that this process made, in order.
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder name in the shared folder."""
    _MADE.append(f"{_root(spark)}/{uuid.uuid4().hex}")
    return _MADE[-1]


def made() -> int:
    """How many folders were made so far, for ``release``."""
    return len(_MADE)


def release(spark: SparkSession, first: int, keep: int = 0) -> None:
    """Delete the folders made from the ``first`` on, but for the last ``keep``.
    What was read from them must not be read any more."""
    gone = _MADE[first : len(_MADE) - keep]
    del _MADE[first : len(_MADE) - keep]
    jvm = spark.sparkContext._jvm
    for path in gone:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and reread it: lineage ends there, and
    a lost executor costs a reread, not a recomputation."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; -1 for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus, F.lit(-1))
