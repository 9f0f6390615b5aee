"""Quality rules, phrase index, line dedup, main text: edge cases, brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import line_dedup, main_text, phrase_index, quality_rules, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["alpha", "beta", "gamma", "delta", "the", "of", "and", "ßtraße", "x", "#tag", "é"]


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    texts = [None, "", " \n\t ", "one", "the of and " * 40, "line one is here\n\nline one is here\nother", "# * $ % & | < >", "a b c d e " * 3 + "f g", "A" * 5000]
    texts += [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 60))) + rng.choice(["", "\n", "\nend of it"]) for _ in range(60)]
    rows = [(i if i != 3 else None, t, None, "s", None) for i, t in enumerate(texts)] + [(5, texts[5], "en", None, 1)] * 2
    return spark.createDataFrame(rows, DOCS)


def rules_by_hand(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    many, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if many[g] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_rules_equal_brute_force(odd):
    for r in quality_rules.judge(odd).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == rules_by_hand(r["text"])
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_stop_words_count_beside_punctuation(spark):
    texts = ["Haus (den, Baum des. Wald «De», rot Pas! blau \"THE\" grün", "den,des and/or d'en -- ... the1 Xthe", "the, " * 3 + "word " * 9]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["n_stop_words"] for r in quality_rules.judge(df).orderBy("doc_id").collect()] == [5, 0, 3]
    clean = spark.createDataFrame([(1, "Alte Bäume stehen still, wo Wasser rauscht; Vögel singen den, Kinder spielen")], "doc_id long, text string")
    assert quality_rules.judge(clean).first()["kept"]


def test_quality_rules_are_native_and_a_filter_stays_small(odd):
    kept = quality_rules.keep_good(odd.withColumn("n_words", F.lit("clash")))
    assert kept.columns == [*odd.columns, "n_words"]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and len(plan) < 100_000
    assert kept.count() > 0 and kept.where("text is null").count() == 0


def test_quality_rules_of_long_texts_and_clashing_names(spark):
    rng = random.Random(1)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) if rng.random() < 0.7 else "the" for _ in range(200_000))
    df = spark.createDataFrame([(1, long, "x"), (2, "few", "y")], "doc_id long, text string, n_words string").withColumn("kept", F.lit("z"))
    got = {r["doc_id"]: r for r in quality_rules.judge(df).collect()}
    n, _, _, _, repeats = rules_by_hand(long)
    assert (got[1]["n_words"], got[1]["n_repeat_words"], got[1]["kept"], got[2]["kept"]) == (n, repeats, True, False)
    assert [tuple(r)[2:] for r in quality_rules.keep_good(df).collect()] == [("x", "z")]


def test_folders_are_shared_or_refused(spark):
    from tessera.llm import _common

    class Lone:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://a:1", "getConf": staticmethod(dict)})

    with pytest.raises(ValueError, match="share"):
        _common.shared_dir(Lone)
    first = _common.made()
    a, b = _common.materialize(spark.range(3)), _common.materialize(spark.range(4))
    _common.release(spark, first, keep=1)
    assert _common.made() == first + 1 and b.count() == 4
    with pytest.raises(Exception):
        a.count()


def test_empty_tables(spark, odd):
    none = odd.where("false")
    assert quality_rules.judge(none).count() == 0
    assert line_dedup.dedup_lines(none).count() == 0
    assert main_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    tests = spark.createDataFrame([], "item_id long, text string")
    assert phrase_index.contamination(none, tests).count() == 0
    assert phrase_index.contamination(odd, tests).where("n_hit > 0").count() == 0


def hits_by_hand(docs, items):
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for k, t in items:
        w = fold(t)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(k)
    out = []
    for d, t in docs:
        w, covered, found = fold(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if owners := windows.get(tuple(w[i : i + n])):
                    found |= owners
                    covered.update(range(i, i + n))
        out.append((d, len(w), len(covered), frozenset(found)))
    return Counter(out)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_contamination_equals_brute_force(spark, odd, block_bytes):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    long = " ".join(t for _, t in docs[10:14])
    items = [(1, "One"), (2, None), (3, ""), (4, " ".join(docs[12][1].split()[:12])), (5, long[:300].upper()), (5, "the of and the of and"), (6, "not in there at all")]
    tests = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    found = phrase_index.contamination(odd, tests, block_bytes=block_bytes, scan_bytes=2 * block_bytes)
    got = Counter((r["doc_id"], r["n_words"], r["n_hit"], frozenset(s["item_id"] for s in r["spans"])) for r in found.collect())
    assert got == hits_by_hand(docs, items)


def spans_by_hand(words, terms, within):
    """Shortest spans of at most ``within`` words that hold all terms."""
    out = []
    for i in range(len(words)):
        for j in range(i, min(len(words), i + within)):
            part = words[i : j + 1]
            if terms <= set(part) and not terms <= set(part[1:]) and not terms <= set(part[:-1]):
                out.append((i, j + 1))
    return out


@pytest.mark.parametrize("within", [3, 8, 200])
def test_proximity_equals_brute_force(spark, within):
    rng = random.Random(within)
    docs = [(f"d{i}", " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 90)))) for i in range(30)] + [("none", None), ("long", "a " + "z " * 150 + "b"), ("next", "c d")]
    items = [("x", "a b c"), ("y", "h h"), ("z", "c d a"), ("q", "absent a"), ("e", ""), ("n", None)]
    tests = spark.createDataFrame(items, "item_id string, text string")
    df = spark.createDataFrame(docs, "doc_id string, text string").coalesce(2)
    found = phrase_index.contamination(df, tests, within=within, block_bytes=8, scan_bytes=16).collect()
    got = {(r["doc_id"], s["item_id"], s["start"], s["stop"]) for r in found for s in r["near"]}
    want = {(d, k, *x) for d, t in docs for k, q in items if q for x in spans_by_hand((t or "").split(), set(q.split()), within)}
    assert got == want and len(found) == len(docs)


def test_drop_contaminated_keeps_columns(spark, odd):
    tests = spark.createDataFrame([(1, "one")], "item_id long, text string")
    out = phrase_index.drop_contaminated(odd, tests)
    assert out.columns == odd.columns
    clash = odd.withColumns({"gone": F.lit(1), "row": F.lit(2), "_px_key": F.lit("k")})
    assert phrase_index.drop_contaminated(clash, tests).columns == clash.columns
    assert out.count() == odd.where("text is null or not lower(text) rlike '(^|[^a-z0-9])one([^a-z0-9]|$)'").count()


def one_edit(a, b):
    """One word replaced, inserted or deleted, by trying all."""
    if len(a) < len(b):
        a, b = b, a
    return len(a) - len(b) <= 1 and any(a[:i] + a[i + 1 :] == (b if len(a) > len(b) else b[:i] + b[i + 1 :]) for i in range(len(a)))


def near_by_hand(docs, least=1, near=5):
    lines = [((d, n), re.findall(r"[^ \t\r\x0b\x0c\n]+", x)) for d, t in docs for n, x in enumerate((t or "").split("\n"))]
    lines = [x for x in lines if len(x[1]) >= least]
    gone = set()
    for at, w in lines:
        for other, v in lines:
            if other < at and (w == v or len(w) >= near and len(v) >= near and one_edit(w, v)):
                gone.add(at)
    return gone


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(5)
    base = [[rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.randint(4, 16))] for _ in range(12)]

    def line():
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + ["new"] + w[i:], w[:i] + ["sub"] + w[i + 1 :]])
        return " ".join(w)

    docs = [(i, "\n".join(line() for _ in range(rng.randint(1, 5)))) for i in range(60)] + [(100, None), (101, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("d", F.lit("clash")).repartition(3)
    gone = near_by_hand(docs)
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(df).collect()}
    for d, t in docs:
        keep = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) not in gone)
        assert out[d]["text"] == keep and out[d]["d"] == "clash"


def test_line_dedup_of_odd_tables(spark):
    long = "\n".join(f"line {i} of a long text" for i in range(3000))
    rows = [(None, "same words here\nown", 1), (5, "same words here", 2), (5, "first at five\n\n \nother", 3), (9, "same  words here\nfirst at five\n\n", 4), (9, None, 5), (11, long, 6), (12, long + "\n" + "word " * 6000, 7), (13, "word " * 5999, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _ld_removed int").withColumns({c: F.lit(c) for c in ("d", "k", "t", "row", "removed")})
    out = line_dedup.dedup_lines(df)
    assert out.columns == [*df.columns, "_ld_removed_"]
    got = {r["_ld_removed"]: r for r in out.collect()}
    assert [got[i]["text"] for i in range(1, 6)] == ["own", "same words here", "first at five\n\n \nother", "\n", None]
    assert got[6]["text"].split("\n")[0] == "line 0 of a long text" and got[7]["text"] == ("word " * 6000) and got[8]["text"] == ""
    assert all(r["removed"] == "removed" and r["d"] == "d" for r in got.values())
    assert [tuple(x) for x in got[4]["_ld_removed_"]] == [(0, 5, 0), (1, 5, 0)]
    words = line_dedup.dedup_lines(df.withColumn("doc_id", F.concat(F.lit("x"), "doc_id")))
    assert words.count() == 8


def test_fields_hold_all_their_keys(spark):
    rng = np.random.default_rng(0)
    keys = rng.integers(-(1 << 63), 1 << 63, 5000, dtype=np.int64)
    field = line_dedup.Field(spark.createDataFrame([(int(k),) for k in keys], "key long"))
    other = rng.integers(-(1 << 63), 1 << 63, 5000, dtype=np.int64)
    assert field.has(keys).all() and field.has(other).mean() < 0.02
    assert not line_dedup.Field(spark.createDataFrame([], "key long")).has(other).any()


def test_line_dedup_query_takes_short_lines(spark, tmp_path):
    rng = random.Random(8)
    base = [[rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.randint(1, 9))] for _ in range(14)]

    def line():
        w = list(rng.choice(base))
        if rng.random() < 0.4:
            w[rng.randrange(len(w))] = rng.choice(["new", "sub"])
        return " ".join(w)

    docs = [(i, "\n".join([line() for _ in range(rng.randint(1, 4))] + ["", " "])) for i in range(40)] + [(50, None), (51, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    gone = Counter(d for d, _ in near_by_hand(docs))
    rows = queries.QUERIES["op3_line_dedup"](spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["n_removed"] for r in rows} == {d: gone[d] for d, _ in docs}


PAGE = """<html><head><title>T</title><script>var t = "</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li><li><a>News</a></li></ul></nav>
<div id="cookie-notice"><p>We use cookies on this site.</p></div><article><h1>Title &amp; more</h1><p>First <b>bold</b> text with a <a href="x" title="a > b">link</a>.<br>Second&nbsp;line &lt;here&gt;.
<p>Third<ul><li>Item</li></ul><div class="advert">Buy now</div></article><section id="comments"><p>I liked this article very much, thank you.</p></section><footer>&copy; us</footer></body></html>"""


def test_main_text(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "v", ""), (4, "w", "<div"), (5, "x", "<article><p>a</article>" * 3)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in main_text.main_text(df.withColumn("text", F.lit(1))).collect()}
    assert got[1] == "Title & more\nFirst bold text with a link.\nSecond line <here>.\nThird\nItem"
    assert got[2] == got[3] == "" and got[5] == "a\na\na"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><p>where <math><mi>x</mi><mo>=</mo><mi>y</mi></math> holds for all.</p></article>", "where x=y holds for all."),
        ("<article><p>text of the article here</p><section id='related-work'><p>Others did it before us.</p></section><div class='related-posts'><p>Read this now</p></div></article>", "text of the article here\nOthers did it before us."),
        ("<article><p>words <i title='a > b' class=x>before</i> words here</p></article>", "words before words here"),
        ("<article><p>words <i title=\"" + "a > b " * 2000 + "\">before</i> words here</p></article>", "words before words here"),
        ("<article><p>see the <a href=http://x/>words of a link</a> here</p><p>it's 5 o'clock</p></article>", "see the words of a link here\nit's 5 o'clock"),
    ],
)
def test_markup_that_misleads(page, text):
    assert "\n".join(main_text.extract(page, main_text.train())) == text


def test_link_words_of_an_unquoted_address_count():
    assert [(b.words, b.link_words) for b in main_text.blocks("<p><a href=http://x/>four words of link</a> and</p>")] == [(5, 4)]


def test_pages_without_marks():
    menu = "".join(f"<div><a href='/{i}'>Section {i}</a></div>" for i in range(6))
    body = [" ".join(["plain words of the text follow each other"] * n) for n in (6, 9, 5)]
    foot = "".join(f"<div><a href='/f{i}'>More {i}</a></div>" for i in range(4))
    page = f"<body><div>Site name</div>{menu}<div>A title of six words here</div>{''.join(f'<div>{b}</div>' for b in body)}<div>Read more</div>{foot}</body>"
    assert main_text.extract(page, main_text.train()) == ["A title of six words here", *body]
    used = {main_text.FEATURES[f] for f in main_text.train().feature if f >= 0}
    assert {"words", "link_density"} <= used and used & {"prev_words", "next_words", "prev_link_density", "next_link_density"}


def blocks_by_hand(page):
    """Texts of a page's blocks by the library's own reader of markup."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.text, self.raw = [], [], 0

        def flush(self):
            if t := " ".join("".join(self.text).split()):
                self.out.append(t)
            self.text = []

        def handle_starttag(self, tag, attrs):
            self.raw += tag in ("script", "style", "title", "button")
            if tag in main_text._BLOCK:
                self.flush()

        def handle_endtag(self, tag):
            self.raw -= tag in ("script", "style", "title", "button")
            if tag in main_text._BLOCK:
                self.flush()

        def handle_data(self, data):
            if not self.raw:
                self.text.append(data)

    r = Reader()
    r.feed(page)
    r.close()
    r.flush()
    return r.out


def test_blocks_equal_a_plain_reader():
    rng = random.Random(7)
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(3, 30)):
            tag = rng.choice(["p", "div", "li", "h2", "section", "article"])
            text = " ".join(rng.choice(["alpha", "b &amp; c", "&lt;x&gt;", "<b>bold</b>", "<a href='/q?a=1' title=\"x > y\">link</a>", "caf\u00e9\n"]) for _ in range(rng.randint(0, 12)))
            parts.append(f"<{tag} class=\"k{rng.randint(0, 9)}\">{text}</{tag}>" + rng.choice(["", "<br>", "<script>if (a < b) { x(); }</script>", "tail text"]))
        page = "<html><head><title>T</title></head><body>" + "".join(parts) + "</body></html>"
        assert [b.text for b in main_text.blocks(page)] == blocks_by_hand(page)


def test_main_text_of_repeated_long_and_deep_pages(spark):
    deep = "<div>" * 3000 + "<article><p>" + "some words of it " * 30_000 + "</p></article>" + "</b>" * 3000
    df = spark.createDataFrame([(1, "u", deep), (1, "u", deep), (None, "v", "<article><p>short text stands here</p></article>")], "page_id long, url string, html string").withColumns({"text": F.lit(1), "blocks": F.lit(2)})
    got = main_text.main_text(df).collect()
    assert sorted(len(r["text"]) for r in got) == [22, 17 * 30_000 - 1, 17 * 30_000 - 1]


def test_tree_learns_its_table():
    t = main_text.train()
    assert all((t.predict(__import__("numpy").array([r[:-1]], float))[0] >= 0.5) == (r[-1] == 1) for r in main_text.TABLE)
