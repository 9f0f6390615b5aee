"""The registered queries against their contracts, by plain means."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from tessera.llm.queries import ORACLE_SQL, QUERIES
from tessera.llm.tokens import load
from tests.llm.test_models_and_tokens import alike_by_hand, weighted_by_hand

COLUMNS = {
    "op1_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op2_language": "doc_id held_out lang_pred score",
    "op4_main_text": "page_id url text n_chars",
    "op5_toxicity": "doc_id held_out score predicted",
    "op6_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op7_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op8_token_ids": "doc_id start n_tokens ids_crc32",
    "op9_near_duplicates": "doc_id class_id",
    "op10_quality": "doc_id held_out score predicted",
}
SOUNDS = {"en": "th ing ou wh er st ly ed".split(), "fr": "eau oi ç que elle é ment ch".split()}


def made(at, spark, flip=0):
    """Tables in a folder. ``flip``: labels of the rows that must not be learned
    from are turned round, for the modulus given."""
    rng = random.Random(12)
    held = lambda d, m, k: zlib.crc32(str(d).encode()) % m == k
    docs, labels = [], []
    for d in range(260):
        lang = ("en", "fr")[d % 2]
        w = ["".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randint(2, 4))) for _ in range(rng.randint(30, 90))]
        toxic, good = int(d % 4 == 1), int(d % 3 > 0)
        for _ in range(3 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(["grumblefink", "snarkwort", "Grumblefink,"]))
        if not good:
            w = [x + rng.choice(["##", "$$", "||", "**"]) for x in w]
        shown = lang
        if flip == 5 and held(d, 5, 0):
            shown = {"en": "fr", "fr": "en"}[lang]
        if flip == 3 and held(d, 3, 1):
            toxic, good = 1 - toxic, 1 - good
        docs.append((d, " ".join(w), shown, "s", 1))
        labels.append((d, good, toxic))
    docs += [(300, None, "en", "s", None), (301, "", None, None, 0), (302, "12 34", "fr", "s", 5), (303, docs[3][1], "fr", "s", 1), (304, docs[3][1] + " one more", "fr", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, " ".join(docs[7][1].split()[2:15])), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    page = "<body><nav><a href='/'>Home</a></nav><article><p>Some &amp; text of the page.</p></article><footer>foot</footer></body>"
    spark.createDataFrame([(1, "u", page), (2, None, None)], "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    return at, *made(at, spark)


@pytest.fixture(scope="module")
def results(spark, tables):
    return {name: QUERIES[name](spark, tables[0]).collect() for name in COLUMNS}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(results, tables, name):
    got = results[name]
    assert set(COLUMNS[name].split()) <= set(got[0].asDict())
    if name not in ("op4_main_text", "op6_packing"):
        assert sorted(r["doc_id"] for r in got) == sorted(d for d, *_ in tables[1])
    assert name in ORACLE_SQL or name in ("op2_language", "op4_main_text", "op5_toxicity", "op6_packing", "op8_token_ids", "op9_near_duplicates", "op10_quality")


def test_language(results, tables):
    docs = {d: (t, y) for d, t, y, *_ in tables[1]}
    right = []
    for r in results["op2_language"]:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        if r["doc_id"] >= 300 and r["doc_id"] <= 302:
            assert r["lang_pred"] == "und"
        elif r["held_out"]:
            right.append(r["lang_pred"] == docs[r["doc_id"]][1])
    assert np.mean(right) > 0.95


@pytest.mark.parametrize(("name", "label", "threshold", "least"), [("op5_toxicity", 2, 0.7, 0.9), ("op10_quality", 1, 0.5, 0.9)])
def test_scores_of_held_out_documents(results, tables, name, label, threshold, least):
    of = {row[0]: row[label] for row in tables[2]}
    right = []
    for r in results[name]:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold)
        if r["held_out"] and r["doc_id"] in of:
            right.append(r["predicted"] == of[r["doc_id"]])
    assert np.mean(right) >= least


@pytest.mark.parametrize(("flip", "names"), [(5, ["op2_language"]), (3, ["op5_toxicity", "op10_quality"])])
def test_held_out_labels_are_not_learned(spark, results, tmp_path, flip, names):
    made(str(tmp_path), spark, flip)
    for name in names:
        again = {r["doc_id"]: r["score"] for r in QUERIES[name](spark, str(tmp_path)).collect()}
        assert again == pytest.approx({r["doc_id"]: r["score"] for r in results[name]})


def test_main_text(results):
    assert sorted((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in results["op4_main_text"]) == [(1, "u", "Some & text of the page.", 24), (2, None, "", 0)]


def plain_ids(name, text, end):
    return np.array(load(name).encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def test_packing(results, tables):
    ids = {d: plain_ids("byte_bpe_50k.json", t, 0) for d, t, *_ in tables[1]}
    seen, ends = {}, {}
    for r in sorted(results["op6_packing"], key=lambda r: (r["sequence_id"], r["offset"])):
        own = ids[r["doc_id"]]
        part = own[r["start"] : r["start"] + r["length"]]
        assert r["length"] == len(part) > 0 and r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(part.tobytes())
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
        seen.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    assert max(ends.values()) <= 1024 and 1024 * len(ends) < 1.1 * sum(map(len, ids.values())) + 1024
    for d, parts in seen.items():
        parts.sort()
        assert [s for s, _ in parts] == np.cumsum([0, *(n for _, n in parts)])[:-1].tolist() and sum(n for _, n in parts) == len(ids[d])
    assert set(seen) == set(ids)


def test_token_ids(results, tables):
    at, by = 0, {r["doc_id"]: r for r in results["op8_token_ids"]}
    for d, t, *_ in sorted(tables[1], key=lambda x: x[0]):
        own = plain_ids("word_bpe_49k.json", t, 1)
        assert (by[d]["start"], by[d]["n_tokens"], by[d]["ids_crc32"]) == (at, len(own), zlib.crc32(own.tobytes()))
        at += len(own)


def test_near_duplicates(results, tables):
    docs = tables[1]
    sets = weighted_by_hand([t for _, t, *_ in docs])
    root = [d for d, *_ in docs]
    for i in range(len(docs)):
        for j in range(i):
            if alike_by_hand(sets[i], sets[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert {r["doc_id"]: r["class_id"] for r in results["op9_near_duplicates"]} == dict(zip([d for d, *_ in docs], root, strict=True))
    assert root[-1] == root[-2] == 3

