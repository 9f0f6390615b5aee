"""Bounded samples of labelled documents for the trained operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import remainder

#: Characters of one text that are learned from: of a longer text, a window that
#: begins at a place chosen by a hash. Scoring takes whole texts of any length.
LEARN_CHARS = 20_000
#: Characters of all texts that are learned from, shared by the label values.
LEARN_TOTAL = 24_000_000


def labelled(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(labels (k, y), texts (k, t)) by id. Labels that repeat count once; an id
    with two different labels has none."""
    y = F.col(f"`{label}`")
    one = labels.where(y.isNotNull()).groupBy(F.col(f"`{id_col}`").alias("k")).agg(F.min(y).alias("y"), F.max(y).alias("z"))
    return one.where("y = z").select("k", "y"), docs.select(F.col(f"`{id_col}`").alias("k"), F.col(f"`{text_col}`").alias("t"))


def sample(keyed: DataFrame, texts: DataFrame | None, per_class: int, allowed: Column, chars: int = LEARN_CHARS, total: int = LEARN_TOTAL) -> list[tuple[str, object]]:
    """At most ``per_class`` (text, label) of every label value, those of the
    least hashes of the ids among the rows that ``allowed`` lets through.

    ``keyed`` has (k, y), and the text t too where ``texts`` is None. Labels are
    counted once; then one pass over the texts takes the rows whose hash lies
    under the share of their label that is wanted. What comes to the driver is
    bounded by ``per_class``, ``chars`` and ``total``.
    """
    keyed = keyed.where(allowed & F.col("y").isNotNull())
    wanted = {r["y"]: 1.5 * per_class / r["n"] for r in keyed.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not wanted:
        return []
    chars = max(1, min(chars, total // len(wanted)))
    spark = keyed.sparkSession
    kind = keyed.schema["y"].dataType.simpleString()
    shares = spark.createDataFrame(list(wanted.items()), f"y {kind}, share double")
    hashed = (F.xxhash64(F.col("k")) / F.lit(float(1 << 63)) + 1) / 2
    few = keyed.join(F.broadcast(shares), "y").where(hashed < F.col("share")).drop("share")
    # 1.5 * per_class rows of a label value or so
    rows = few if texts is None else texts.join(F.broadcast(few), "k")
    size = F.length("t")
    begin = F.when(size > chars, 1 + F.pmod(F.xxhash64("k", "y"), size - chars + 1)).otherwise(F.lit(1)).cast("int")
    rows = rows.where(F.col("t").isNotNull()).select("y", F.substring("t", begin, F.lit(chars)).alias("t"), F.xxhash64("k").alias("h"), "k")
    out, seen = [], {y: [0, 0] for y in wanted}
    for r in rows.orderBy("h", "k", "t").select("t", "y").toLocalIterator():
        n = seen[r["y"]]
        if n[0] < per_class and n[1] + len(r["t"]) <= total // len(wanted):
            n[0] += 1
            n[1] += len(r["t"])
            out.append((r["t"], r["y"]))
    return out


def learnable(id_col: str, modulus: int, held_out: int) -> Column:
    """Rows that may be learned from: crc32 of the id as text, modulo
    ``modulus``, is not ``held_out``; rows without an id are not."""
    r = remainder(F.col(id_col), modulus)
    return (r != held_out) & (r >= 0)
