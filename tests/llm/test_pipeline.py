"""The pipeline against a plain version of every stage."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import quality_rules
from tessera.llm.tokens import load
from tests.llm.test_models_and_tokens import alike_by_hand, weighted_by_hand
from tests.llm.test_text_operators import hits_by_hand, near_by_hand, rules_by_hand


def keeps(t):
    n, chars, symbols, dup, repeats = rules_by_hand(t)
    lines = [x for x in (t or "").split("\n") if x.strip()]
    stops = sum(w in quality_rules.STOP_FORMS for w in (t or "").split())
    return n >= 10 and 5 * repeats <= n and 2 <= chars / n <= 15 and 5 * symbols <= n and 50 * stops >= n and 2 * dup <= len(lines)


def classes(docs):
    sets = weighted_by_hand([t for _, t in docs])
    root = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if alike_by_hand(sets[i], sets[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_pipeline_equals_its_plain_version(spark, tmp_path):
    rng = random.Random(9)
    word = lambda: rng.choice(["the", "of", "and", "to"]) if rng.random() < 0.2 else "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7)))
    line = lambda: " ".join(word() for _ in range(rng.randint(12, 30)))
    shared, docs = [line() for _ in range(4)], []
    for i in range(50):
        t = "\n".join([line() for _ in range(rng.randint(3, 6))] + rng.sample(shared, rng.choice([0, 0, 1])))
        docs.append((i, t))
    # near copies that no line gives away: words changed all over
    for i, (_, t) in enumerate(docs[:8]):
        lines = [x.split(" ") for x in t.split("\n")]
        for w in lines:
            for k in rng.sample(range(len(w)), 2):
                w[k] = "changed"
        docs.append((100 + i, "\n".join(map(" ".join, lines))))
    docs += [(200, docs[20][1]), (201, None), (202, ""), (203, "# " * 50), (204, "too few words")]
    tests = [(1, docs[30][1].split("\n")[1]), (2, "nothing of this is in any document at all here")]
    spark.createDataFrame([(d, t, None, "s", None if t is None else len(t)) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(tests, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    left = [(d, t) for d, t in docs if keeps(t)]
    gone = near_by_hand(left)
    left = [(d, "\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) not in gone)) for d, t in left]
    left = [(d, t) for d, t in left if t.strip()]
    left = [x for i, x in enumerate(left) if classes(left)[i] == i]
    bad = {d for d, _, n, _ in hits_by_hand(left, tests) if n}
    left = [(d, t) for d, t in left if d not in bad]
    assert 30 not in dict(left) and 30 in dict(docs)

    tok, seen = load("byte_bpe_50k.json"), {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        seen.setdefault(r["doc_id"], [0, r["doc_tokens"]])[0] += r["length"]
    assert seen == {d: [n := len(tok.encode(t, add_special_tokens=False).ids) + 1, n] for d, t in left}


def test_stages_of_odd_tables(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, extra columns
    with the names that operators use, and an empty table, through every stage."""
    rng = random.Random(2)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) if rng.random() < 0.7 else "the" for _ in range(n))
    one, long = text(60), "\n".join(text(40) for _ in range(300))
    rows = [(1, one, "en", "s", 5), (1, one, "en", "s", 5), (None, text(50), None, None, None), (None, None, None, None, None), (3, "", "en", "s", 0), (4, long, "en", None, 9), (5, one + " more", "en", "s", 1)]
    names = ("_ld_removed", "_nd_digest", "n_words", "row", "k", "g", "t", "d", "gone", "kept", "removed")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(c) for c in names})
    spark.createDataFrame([(1, " ".join(one.split()[:12])), (None, None), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and stage(spark, docs.where("false"), str(tmp_path)).count() == 0
        docs = corpus_pipeline.materialize(out)
        found = docs.collect()
        assert all(r[c] == c for r in found for c in names)
        kept[name] = sorted(((r["doc_id"] or 0) for r in found))
    assert kept["quality rules"] == [0, 1, 1, 4, 5] and kept["line dedup"] == [0, 1, 1, 4] and kept["near copies"] == [0, 1, 4] and kept["decontamination"] == [0, 4]
    packed = corpus_pipeline.pack(spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == {None, 4} and corpus_pipeline.pack(spark, docs.where("false"), str(tmp_path)).count() == 0
