"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import grammar_shards, language_kernel, line_dedup, main_text, near_dup, packing, phrase_index, quality_machine, quality_rules, toxicity_kernel
from tessera.llm._common import read, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics and verdict of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words", "failed_rules"
    )


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.cut(docs, "byte_bpe_50k.json", end_id=0, window=1024, with_ids=False).drop("ids")
    return packing.pack(pieces, 1024, rows=docs.count()).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query
def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token ids, written to grammar-compressed shards and read
    back from them."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    path = shared_dir(spark)
    grammar_shards.write_shards(docs, path, "word_bpe_49k.json", end_id=1)
    return grammar_shards.read_documents(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a window of any benchmark item."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = phrase_index.contamination(docs, read(spark, sf_dir, "benchmark").select("item_id", "text"))
    items = F.array_sort(F.array_distinct(F.array_compact(F.transform("spans", lambda s: s["item_id"].cast("string")))))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_kernel.predict(docs, language_kernel.train(docs))


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity_kernel.score(docs, toxicity_kernel.train(docs, read(spark, sf_dir, "labels")))


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_machine.score(docs, quality_machine.train(docs, read(spark, sf_dir, "labels")))


@query
def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return main_text.main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that repeat an earlier one."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    n_lines = F.size(F.split("text", "\n"))
    out = line_dedup.dedup_lines(docs.withColumn("n_lines", n_lines))
    return out.select("doc_id", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("_ld_removed"), F.lit(0)).cast("long").alias("n_removed"), F.sha2("text", 256).alias("text_sha256"))


ORACLE_SQL["op3_line_dedup"] = r"""
with docs as (select doc_id, text, string_split(text, chr(10)) as ls from documents),
  lines as (select doc_id, text, i - 1 as n, ls[i] as line, list_filter(regexp_split_to_array(ls[i], '[ \t\x0b\x0c\r]+'), lambda x: x <> '') as w
            from (select doc_id, text, ls, unnest(range(1, len(ls) + 1)) as i from docs)),
  able as (select doc_id, n, array_to_string(w, ' ') as s, w, len(w) as c from lines where len(w) >= 1),
  uniq as (select s, any_value(w) as w, any_value(c) as c, min((doc_id, n)) as first from able group by s),
  spread as (select s, first, c, w, unnest(range(1, c + 1)) as i from uniq where c >= 5),
  keys as (
    select 'S' || i || '/' || c || '/' || array_to_string(list_concat(w[:i - 1], w[i + 1:]), ' ') as key, 0 as kind, s, first from spread
    union all select 'D' || array_to_string(list_concat(w[:i - 1], w[i + 1:]), ' '), 1, s, first from spread
    union all select distinct 'D' || s, 2, s, first from spread),
  best as (select key, min(first) filter (kind = 0) as swap, min(first) filter (kind = 1) as dropped, min(first) filter (kind = 2) as own from keys group by key having count(*) > 1),
  near as (select k.s, min(case kind when 0 then swap when 1 then own else dropped end) as by
           from keys k join best using (key)
           where case kind when 0 then swap when 1 then own else dropped end < k.first group by k.s),
  gone as (select a.doc_id, a.n from able a join uniq u using (s) left join near m on m.s = a.s where m.by is not null or u.first < (a.doc_id, a.n)),
  kept as (select l.doc_id, count(*) as n_lines, count(g.n) as n_removed, string_agg(case when g.n is null then l.line end, chr(10) order by l.n) as text
           from lines l left join gone g on g.doc_id = l.doc_id and g.n = l.n group by l.doc_id)
select d.doc_id, coalesce(k.n_lines, 0)::bigint as n_lines, coalesce(k.n_removed, 0)::bigint as n_removed,
  case when d.text is null then null else sha256(coalesce(k.text, '')) end as text_sha256
from documents d left join kept k using (doc_id)
"""


@query
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document: near copies share one."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dup.near_duplicates(docs).select("doc_id", "class_id", "keeper")


_FORMS = ", ".join("'" + w.replace("'", "''") + "'" for w in quality_rules.STOP_FORMS)
_OUTER = quality_rules.OUTER.replace("'", "''")
ORACLE_SQL["op7_quality_rules"] = rf"""
with d as (select doc_id, coalesce(text, '') as t from documents),
  w as (select doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
  g as (select doc_id, i, array_to_string(w[i:i + 4], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from w)),
  many as (select doc_id, g from g group by doc_id, g having count(*) > 1),
  covered as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 5)) as p from g join many using (doc_id, g)) group by doc_id),
  m as (select doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars, (length(t) - length(translate(t, '#*$%&|<>', '')))::bigint as n_symbols,
          (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words, len(ls)::bigint as n_lines, len(list_filter(w, lambda x: list_contains([{_FORMS}], trim(x, '{_OUTER}'))))::bigint as n_stop_words
        from w left join covered c using (doc_id)),
  r as (select *, n_words >= 10 as r1, coalesce(n_repeat_words <= 0.2::double * n_words and n_words > 0, false) as r2, coalesce(word_chars / nullif(n_words, 0) between 2 and 15, false) as r3, coalesce(n_symbols / nullif(n_words, 0) <= 0.2::double, false) as r4,
          coalesce(n_stop_words / nullif(n_words, 0) >= 0.02::double, false) as r5, coalesce(n_dup_lines / nullif(n_lines, 0) <= 0.5::double, false) as r6 from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, not (r1 and r2) as base_failed, r1 and r2 and r3 and r4 and r5 and r6 as kept, n_lines, n_stop_words,
  list_filter([case when not r1 then 'enough_words' end, case when not r2 then 'few_repeats' end, case when not r3 then 'word_length' end, case when not r4 then 'symbols' end, case when not r5 then 'stop_words' end, case when not r6 then 'dup_lines' end], lambda x: x is not null) as failed_rules
from r
"""

ORACLE_SQL["op1_decontamination"] = r"""
with f as (select 'd' as kind, doc_id as id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
           union all select 'b', item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
  b as (select distinct id as item, least(len(w), 10) as n, array_to_string(w[i:i + 9], ' ') as win from (select id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from f where kind = 'b' and len(w) > 0)),
  s as (select distinct n from b),
  x as (select id, i, n, array_to_string(w[i:i + n - 1], ' ') as win from (select id, w, n, unnest(range(1, len(w) - n + 2)) as i from f cross join s where kind = 'd' and len(w) >= n)),
  h as (select x.id, x.i, x.n, b.item from x join b using (n, win)),
  c as (select id, count(distinct p) as n_hit from (select id, unnest(range(i, i + n)) as p from h) group by id),
  k as (select id, count(distinct item) as n_items, string_agg(distinct item::varchar, ',' order by item::varchar) as items from h group by id)
select f.id as doc_id, coalesce(len(w), 0)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from f left join c using (id) left join k using (id) where kind = 'd'
"""
