"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and reread as the next stage's ``docs``. All but the last
return the columns of ``documents``, and any more that ``docs`` has.

Defined results, stage by stage, are those of the operators: a null, empty or
blank text fails the quality rules; of rows that repeat, id and text, one is
kept; ids may be null; an empty table stays empty; texts of any length are taken
whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import line_dedup, near_dup, packing, phrase_index, quality_rules
from tessera.llm._common import made, materialize, read, release

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that pass the quality rules."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that repeat an earlier one; documents left without a word go."""
    out = line_dedup.dedup_lines(docs)
    whole = F.col(out.columns[-1]).isNull()  # the report of removed lines
    out = out.where(whole | (F.regexp_replace("text", quality_rules.WHITE_RUN, "") != ""))
    length = F.when(whole, F.col("n_chars")).otherwise(F.length("text"))
    return out.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies."""
    return near_dup.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a window of the benchmark."""
    return phrase_index.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 1024 tokens."""
    pieces = packing.cut(docs, "byte_bpe_50k.json", end_id=0, window=1024, with_ids=False).drop("ids")
    return packing.pack(pieces, 1024, rows=docs.count()).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("quality rules", quality), ("line dedup", lines), ("near copies", near_copies), ("decontamination", decontaminate), ("packing", pack)]

#: SQL has neither the samples of near-copy detection nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, first = read(spark, sf_dir, "documents"), made()
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
        # what the stage wrote on its way, and what the one before it left
        release(spark, first, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
