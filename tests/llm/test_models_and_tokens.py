"""Tokens, shards, packing, near duplicates and the trained operators."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import grammar_shards, language_kernel, near_dup, packing, quality_machine, toxicity_kernel
from tessera.llm.tokens import ChunkEncoder, load

TOKENIZERS = ("byte_bpe_50k.json", "word_bpe_49k.json")


@pytest.mark.parametrize("name", TOKENIZERS)
def test_chunks_encode_as_whole_texts(name):
    rng = random.Random(1)
    letters = " \n\t'ab1.é \x1c\x85　​́SΣ\x00,<|"
    wide = [chr(c) + p for c in range(0xC0, 0x250) for p in ("!", "a.", " :", "\"")] + ["İ" + p for p in ".,:;!?*#$%&|)\""]
    texts = ["", " ", "a\n\nb", "it's they'll", "<|endoftext|> a", "hello <|endoftext|> world", "A<|startoftext|>", *wide, *("".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(3000))]
    whole, encoder = load(name), ChunkEncoder(name, cache=500)
    for got, text in zip(encoder.encode(texts), texts, strict=True):
        assert np.frombuffer(got, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_repair_round_trip_and_random_access():
    rng = np.random.default_rng(0)
    docs = [np.append(rng.integers(2, 6, n), 1).astype("<u4") for n in (0, 1, 5, 3000, 700)]
    blob = grammar_shards.encode_shard([3, None, 1, 1, 2], [d.tobytes() for d in docs], 10, 1)
    shard = grammar_shards.Shard.parse(blob)
    assert shard.doc_ids == [3, None, 1, 1, 2] and len(shard.rules) > 0
    for i, d in enumerate(docs):
        assert shard.document(i).tolist() == d.tolist()
        for a, z in ((0, len(d)), (0, 1), (len(d) // 2, len(d) // 2 + 7), (len(d), len(d))):
            assert shard.tokens(i, a, z).tolist() == d[a:z].tolist()
    with pytest.raises(ValueError):
        grammar_shards.Shard.parse(b"x" * 100)


@pytest.mark.parametrize("base", [50, 50_000, 65_536, 200_000])
def test_repair_goes_on_until_no_pair_is_frequent(base):
    rng = np.random.default_rng(1)
    phrases = [rng.integers(2, base, 30) for _ in range(20)]
    parts = [np.append(np.concatenate([phrases[rng.integers(20)], rng.integers(2, base, 5)]), 1) for _ in range(1500)]
    tokens = np.concatenate([*parts, np.full(40_000, 7), [1]])
    symbols, rules = grammar_shards.repair(tokens, base, 1)
    at, flat = grammar_shards.expansions(rules, base)
    back = np.concatenate([flat[at[x - base] : at[x - base + 1]] if x >= base else [x] for x in symbols.tolist()])
    assert (back == tokens).all() and len(symbols) < len(tokens) / 3
    pairs = symbols[:-1] << 32 | symbols[1:]
    pairs, n = np.unique(pairs[(symbols[:-1] != 1) & (symbols[1:] != 1)], return_counts=True)
    # a run of one pair counts it twice as often as it can be replaced
    assert n[(pairs >> 32) != (pairs & 0xFFFFFFFF)].max() < grammar_shards.FREQUENT
    blob = grammar_shards.encode_shard([0], [tokens.astype("<u4").tobytes()], base, 1)
    assert grammar_shards.Shard.parse(blob).document(0).tolist() == tokens.tolist()


def test_rows_of_one_id_are_dealt_among_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(grammar_shards, "BUCKET_DOCS", 50)
    df = spark.range(900).selectExpr("case when id % 3 = 0 then 7 when id % 3 = 1 then null else id end as doc_id", "'same text' as text").repartition(4)
    grammar_shards.write_shards(df, str(tmp_path / "hot"), "word_bpe_49k.json", 1)
    sizes = [r["n"] for r in spark.read.parquet(str(tmp_path / "hot")).groupBy("bucket").agg(F.sum("n_docs").alias("n")).collect()]
    assert sum(sizes) == 900 and max(sizes) < 150
    out = grammar_shards.read_documents(spark, str(tmp_path / "hot")).orderBy("start").collect()
    ids = [r["doc_id"] for r in out]
    assert ids == sorted(ids, key=lambda x: (x is not None, x)) and [r["start"] for r in out] == [3 * i for i in range(900)]
    grammar_shards.write_shards(df.where("false"), str(tmp_path / "none"), "word_bpe_49k.json", 1)
    assert grammar_shards.read_documents(spark, str(tmp_path / "none")).count() == 0


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    texts = [None, "", "word", "a " * 3000, *(" ".join(rng.choice(["the", "cat", "runs", "quickly", "étage"]) for _ in range(rng.randint(1, 1500))) for _ in range(30))]
    rows = [(None if i == 2 else i, t, 1) for i, t in enumerate(texts)] + [(7, texts[7], 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids long").repartition(3)


def test_shards_hold_all_documents_in_order(spark, docs, tmp_path):
    path = str(tmp_path / "shards")
    grammar_shards.write_shards(docs, path, "word_bpe_49k.json", 1)
    out = sorted(grammar_shards.read_documents(spark, path).collect(), key=lambda r: r["start"])
    tok, at = load("word_bpe_49k.json"), 0
    ids = [r["doc_id"] for r in out]
    assert ids == sorted(ids, key=lambda x: (x is not None, x)) and len(out) == docs.count()
    by = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in out:
        expected = np.array(tok.encode(by[r["doc_id"]] or "", add_special_tokens=False).ids + [1], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(expected), zlib.crc32(expected.tobytes()))
        at += len(expected)


def test_packing_covers_all_ids_once(docs):
    pieces = packing.cut(docs, "byte_bpe_50k.json", 0, window=128)
    out = packing.pack(pieces, 128, rows=40, group_rows=10).collect()
    tok, spans, fills = load("byte_bpe_50k.json"), {}, {}
    for r in out:
        spans.setdefault((r["doc_id"], r["row"], r["doc_tokens"]), []).append((r["start"], r["length"], r["ids"], r["ids_crc32"]))
        fills.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for (d, _, n), parts in spans.items():
        ids = np.frombuffer(b"".join(bytes(x[2]) for x in sorted(parts)), "<u4").tolist()
        assert ids == tok.encode(texts[d] or "", add_special_tokens=False).ids + [0] and n == len(ids)
        assert all(zlib.crc32(bytes(x[2])) == x[3] for x in parts)
    for parts in fills.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= 128


def test_checksums_of_cuts():
    rng = random.Random(3)
    for _ in range(200):
        data, at = rng.randbytes(rng.randint(0, 4000)), rng.random()
        k = int(at * len(data))
        assert packing.crc_of_rest(zlib.crc32(data), zlib.crc32(data[:k]), len(data) - k) == zlib.crc32(data[k:])


def test_sum_of_squares_equals_trying_all_levels():
    rng = np.random.default_rng(8)
    lengths, window = rng.integers(1, 30, 400), 30
    number, offset = packing.sum_of_squares(lengths, window)
    fills = {}
    for n, w, at in zip(lengths.tolist(), number.tolist(), offset.tolist(), strict=True):
        assert fills.get(w, 0) == at
        count = Counter(f for f in fills.values() if f < window)

        def cost(level, n=n, count=count):
            c = Counter(count)
            if level:
                c[level] -= 1
            if level + n < window:
                c[level + n] += 1
            return sum(v * v for v in c.values())

        able = [0, *(f for f, v in count.items() if v and f + n <= window)]
        assert cost(at) == min(map(cost, able))
        fills[w] = at + n


def test_open_windows_are_closed_up(spark):
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 1024, 3000)
    number, _ = packing.sum_of_squares(lengths, 1024)
    pieces = packing.close_up(number, lengths, 1024)
    parts, fills = {}, Counter()
    for item, first, n, w in pieces:
        parts.setdefault(item, []).append((first, n))
        fills[w] += n
    for item, own in parts.items():
        assert sorted(own) == [(sum(n for _, n in sorted(own)[:k]), n) for k, (_, n) in enumerate(sorted(own))] and sum(n for _, n in own) == lengths[item]
    assert len(parts) == 3000 and max(fills.values()) <= 1024 and len(pieces) < 4000
    assert 1024 * len(fills) <= 1.01 * lengths.sum() + 1024
    words = ["alpha", "beta", "gamma ray", "delta"]
    texts = [" ".join(words[i] for i in rng.integers(0, 4, k)) for k in rng.integers(1, 900, 300)]
    df = spark.createDataFrame([*enumerate(texts), (None, None), (3, texts[3])], "doc_id long, text string").withColumns({"row": F.lit(1), "begins": F.lit(2)})
    out = packing.pack(packing.cut(df, "byte_bpe_50k.json", 0), 1024).collect()
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in out)
    assert packing.pack(packing.cut(df.where("false"), "byte_bpe_50k.json", 0), 1024).count() == 0


def test_sum_of_squares_picks_the_least_increase():
    number, offset = packing.sum_of_squares(np.array([6, 6, 4, 4, 10]), 10)
    assert offset.tolist() == [0, 0, 6, 6, 0] and number[2] != number[3]


def words_of(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(n)]


def weighted_by_hand(texts):
    """Five-word shingles and weights, from the definition."""
    bags = []
    for t in texts:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
        bags.append(Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else Counter([tuple(w)] if w else []))
    df, n = Counter(g for b in bags for g in b), sum(map(bool, bags))
    return [{g: k * (1 + math.log(n / df[g]) / math.log(n)) for g, k in b.items()} for b in bags]


def alike_by_hand(a, b):
    both = sum(min(v, b[g]) for g, v in a.items() if g in b)
    return both / (sum(a.values()) + sum(b.values()) - both) if a and b else 0


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(25):
        base = words_of(rng, rng.randint(60, 200))
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 4])):
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = "edited"
            texts.append(" ".join(w))
    texts += [None, "", "two words", "Two  words!", texts[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("g", F.lit(1)).repartition(3)
    sets = weighted_by_hand(texts)
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if alike_by_hand(sets[i], sets[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(df).collect()}
    assert got == dict(enumerate(root))
    kept = near_dup.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root))


def test_one_odd_member_does_not_repeat_a_bucket(spark):
    main = spark.range(5000).selectExpr("7L as band", "cast(cast(id as string) as binary) as g", "cast('m' as binary) as label", "cast('m' as binary) as main", "5001L as n", "1L as n_odd")
    odd = spark.createDataFrame([(7, b"z", b"z", b"m", 5001, 1)], main.schema)
    dealt = near_dup._dealt(main.unionAll(odd)).collect()
    assert len(dealt) == 5001 + 20 and {(r["i"], r["j"]) for r in dealt if r["odd"]} == {(0, j) for j in range(20)}


def test_blocks_of_a_bucket_find_every_link(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    rng = np.random.default_rng(3)
    base = np.sort(rng.integers(1, 1 << 63, 60).astype(np.uint64))
    one, sets, want = np.ones(60, np.int64), [], 0
    for i in range(40):
        s = base.copy()
        s[rng.permutation(60)[: int(rng.integers(0, 9))]] += np.uint64((i + 1) << 33)
        sets.append(near_dup.pack(np.sort(s), np.full(60, 32), one))
    root = list(range(40))
    for i in range(40):
        for j in range(i):
            if near_dup.similarity(sets[i], sets[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    name = [f"{i:02d}".encode() for i in range(40)]
    rest = spark.createDataFrame([(1, name[i], name[i], name[0], 40, 39) for i in range(40)], "band long, g binary, label binary, main binary, n long, n_odd long")
    links = near_dup._meet(rest, spark.createDataFrame(list(zip(name, sets, strict=True)), "g binary, x binary"), 0.8).collect()
    got = list(range(40))
    for r in links:
        a, b = got[int(bytes(r["a"]))], got[int(bytes(r["b"]))]
        got = [min(a, b) if x in (a, b) else x for x in got]
    assert got == root and 1 < len(set(root)) < 40


def test_near_duplicates_of_odd_tables(spark):
    t = "one two three four five six seven eight nine ten"
    rows = [("b", t, 1), ("a", t, 2), ("a", t, 3), (None, t, 4), ("c", None, 5), ("c", None, 6), (None, "", 7), ("d", "...", 8), ("e", t + " x" * 50_000, 9)]
    df = spark.createDataFrame(rows, "doc_id string, text string, _nd_digest int").withColumns({"row": F.lit(1), "g": F.lit("g"), "k": F.lit("k")})
    got = sorted((r["doc_id"] or "", r["class_id"] or "", r["keeper"]) for r in near_dup.near_duplicates(df).collect())
    assert got == sorted([("b", "a", False), ("a", "a", True), ("a", "a", True), ("", "a", False), ("c", "c", True), ("c", "c", True), ("", "", True), ("d", "d", True), ("e", "e", True)])
    kept = near_dup.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(r["_nd_digest"] for r in kept.collect())[1:] == [5, 6, 7, 8, 9] and kept.count() == 6
    assert near_dup.drop_near_duplicates(df.where("false")).count() == 0


def test_samples_agree_as_often_as_sets_are_alike():
    rng = np.random.default_rng(1)
    a, b = rng.choice(4000, (2, 600), replace=False).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x, y = np.sort(np.concatenate([a, b[:150]])), np.sort(np.concatenate([a, b[150:300]]))
    samples = []
    for s in (x, y):
        rows = []
        for seed in near_dup._SEED:
            with np.errstate(over="ignore"):
                v = near_dup._TABLE[(s * seed) >> np.uint64(64 - near_dup._PLACES)] ^ (s & np.uint64(0xFFFFFFFF))
            rows.append(int(v.min()) & 0xFFFFFFFF)
        samples.append(rows)
    same = np.mean([p == q for p, q in zip(*samples, strict=True)])
    assert abs(same - 600 / 900) < 0.12


def test_language_kernel_on_small_texts():
    rows = [("the house and the garden of the king", "en"), ("das haus und der garten von dem könig", "de"), ("this is what they said to us", "en"), ("das ist was sie zu uns sagten", "de")] * 3
    model = language_kernel.fit(rows, landmarks=4)
    assert [model.languages[k] for k in model.scores(["the king said", "der könig sagte"]).argmax(1)] == ["en", "de"]


def test_predictions_of_odd_texts(spark, docs):
    out = language_kernel.predict(docs.limit(5), None).collect()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in out)
    assert toxicity_kernel.score(docs, None).where("score <> 0 or predicted <> 0").count() == 0
    assert quality_machine.score(docs.where("false"), None).count() == 0


def test_toxicity_tolerates_gaps():
    rng = random.Random(6)
    clean = [" ".join(words_of(rng, 30)) for _ in range(300)]
    toxic = [t + " " + rng.choice(["grumblefink", "snarkwort"]) + " " + " ".join(words_of(rng, 5)) for t in clean[:150]]
    model = toxicity_kernel.fit([(t, 0) for t in clean] + [(t, 1) for t in toxic], landmarks=120)
    fresh = " ".join(words_of(rng, 30))
    assert model.score(fresh + " grumblefink") > 0.7 > model.score(fresh)
    assert model.score(fresh + " grumble-fink") > 0.7 and model.score(fresh + " g r u m b l e f i n k end") > 0.7
    assert 0 <= model.score(None) == model.score("") < 0.7


def test_toxicity_kernel_equals_enumeration():
    """Subsequences of the shapes, enumerated; distinct ones take part apart."""
    from itertools import combinations

    def features(word):
        w, out = f"^{word}$", {}
        for n in (3, 4, 5):
            for at in combinations(range(len(w)), n):
                span = at[-1] - at[0] + 1
                if span - n <= {3: 2, 4: 1, 5: 0}[n]:
                    key = "".join(w[i] for i in at)
                    out.setdefault(key, []).append(0.5 ** (span - n))
        return out

    shapes = [s for s in toxicity_kernel.SHAPES]
    assert sorted(shapes) == sorted({tuple(i - at[0] for i in at) for n in (3, 4, 5) for at in combinations(range(5), n) if at[-1] - at[0] + 1 - n <= {3: 2, 4: 1, 5: 0}[n]})
    words = ["clown", "cl-own", "crown", "table"]

    def plain(a, b):
        f, g = features(a), features(b)
        norm = lambda x: sum(v * v for vs in x.values() for v in vs) ** 0.5
        return sum(sum(f[k]) * sum(g[k]) for k in f if k in g) / norm(f) / norm(g)

    want = [[plain(a, b) for b in words] for a in words]
    np.testing.assert_allclose(toxicity_kernel.kernel(words, words), want, atol=2e-3)
    assert want[0][1] > want[0][3]


def test_long_texts_without_spaces_are_scored_in_parts():
    model = toxicity_kernel.Model(np.zeros(toxicity_kernel.TABLE, np.float32), 0.0, np.array([1.0, -2.0]))
    model.table[toxicity_kernel.subsequences(["grumble"])[1]] = 1
    flat = "abcdefgh" * 40_000
    assert model.score(flat) < model.score(flat + "grumble") and model.score(flat + " grumble") > 0.5


def test_languages_of_odd_and_long_texts(spark):
    rows = [(i, t, y, "s") for i, (t, y) in enumerate([("the house and the garden of the king", "en"), ("das haus und der garten von dem könig", "de")] * 20)]
    odd = [(100, "²½①", None, "s"), (101, "—“”…😀。", None, "s"), (102, None, "en", None), (103, "", None, None), (104, "das haus und der garten. " * 30_000, None, "s"), (None, "the king", "en", "s"), (1, "das haus", "en", "s"), (1, "das haus", "en", "s")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, lang_pred string")
    model = language_kernel.train(df)
    got = language_kernel.predict(df, model).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 48 and [by[i]["lang_pred"] for i in (100, 101, 102, 103)] == ["und"] * 4 and by[104]["lang_pred"] == "de"
    assert by[102]["score"] == 0 and all(0 <= r["score"] <= 1 for r in got) and by[None]["held_out"] is False
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    t = "das haus und der garten. " * 30_000
    np.testing.assert_allclose(model.scores([t])[0], model.scores([t[: language_kernel.PIECE]])[0], atol=0.02)


def test_samples_take_every_label_and_no_doubtful_id(spark):
    from tessera.llm import _learn

    docs = spark.range(4000).selectExpr("id as doc_id", "concat('text ', id, repeat('x', int(id % 7) * 9000)) as text")
    labels = docs.selectExpr("doc_id", "doc_id % 1500 as y").unionAll(spark.createDataFrame([(5, 77), (6, 6), (7, None)], "doc_id long, y long"))
    keyed, texts = _learn.labelled(docs, labels, "y")
    got = _learn.sample(keyed, texts, 2, _learn.learnable("k", 3, 1))
    ids = [int(t[5:].split("x")[0]) for t, _ in got if t.startswith("text ")]
    assert all(zlib.crc32(str(i).encode()) % 3 != 1 for i in ids) and 5 not in ids
    assert all(len(t) <= _learn.LEARN_CHARS for t, _ in got)
    most = max(sum(1 for _, y in got if y == k) for k in {y for _, y in got})
    assert most <= 2 and len({y for _, y in got}) > 1200
    assert _learn.sample(keyed.where("false"), texts, 2, F.lit(True)) == []


def test_factorisation_machine_identity_and_fit():
    rng = np.random.default_rng(2)
    x = rng.random((400, 6))
    y = (x[:, 0] * x[:, 1] > 0.25).astype(float)
    m = quality_machine.fit(x, y, rank=3, epochs=60, decay=0.0)
    v, w = m.factors.astype(float), m.linear.astype(float)
    pairs = sum((v[i] @ v[j]) * x[:, i] * x[:, j] for i in range(6) for j in range(i))
    np.testing.assert_allclose(m.margins(x), m.bias + x @ w + pairs, atol=1e-4)
    assert ((m.margins(x) > 0) == (y == 1)).mean() > 0.9
