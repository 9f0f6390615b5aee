"""Heuristic quality rules compiled into one Spark projection.

The rules are a table of (metric, comparison, threshold). ``measure`` turns
texts into metrics with built-in expressions only, and ``verdict`` compiles the
table into one boolean expression, so the whole operator is a narrow
projection: no shuffle, no Python, no state.

Defined results: a null, empty or blank text has no words and no lines, fails
the rule on the number of words and is rejected. Texts are taken whole, rows
are judged one by one (so repeated rows get the same verdict). ``keep_good``
passes all columns through, whatever their names; ``judge`` replaces columns of
the names that it adds. The five-word windows of a text are one array of some
five times its size, in the memory of one task.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that separates words.
WHITE = " \t\n\x0b\x0c\r"
WHITE_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Frequent function words of English, French, German, Spanish.
STOP_WORDS = (
    "a", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with",
    "au", "avec", "dans", "des", "du", "en", "est", "et", "la", "le", "les", "par", "pas", "pour", "que", "qui", "sur", "un", "une",
    "auf", "das", "dem", "den", "der", "die", "ein", "eine", "für", "im", "ist", "mit", "nicht", "sich", "und", "von", "zu",
    "al", "como", "con", "de", "del", "el", "las", "lo", "los", "no", "para", "por", "se", "su", "y",
)
#: As they occur: lower case, with a capital, in capitals. Looking forms up is
#: several times cheaper than lowering every word.
STOP_FORMS = tuple(dict.fromkeys(f for w in STOP_WORDS for f in (w, w.capitalize(), w.upper())))
#: What may touch a word from outside without making it another word.
OUTER = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»‹›“”„‟‘’‚…–—·"


@dataclass(frozen=True)
class Rule:
    """``metric`` must be at least ``low`` and at most ``high`` (None: open)."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None

    def passes(self) -> Column:
        m = F.col(self.metric)
        parts = [F.lit(True)]
        if self.low is not None:
            parts.append(m >= F.lit(self.low))
        if self.high is not None:
            parts.append(m <= F.lit(self.high))
        return F.coalesce(reduce(lambda a, b: a & b, parts), F.lit(False))


#: The base rules, and the thresholds on ratios. No rule has an upper bound on
#: length: long clean documents are kept.
BASE_RULES = (
    Rule("enough_words", "n_words", low=10),
    Rule("few_repeats", "repeat_ratio", high=0.2),
)
RULES = (
    Rule("word_length", "mean_word_chars", low=2, high=15),
    Rule("symbols", "symbol_ratio", high=0.2),
    Rule("stop_words", "stop_word_ratio", low=0.02),
    Rule("dup_lines", "dup_line_ratio", high=0.5),
)


def _trim(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def measure(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the metrics of every whole text.

    ``n_repeat_words`` counts the words that lie in a window of five words
    found at least twice in the text. The windows that recur are found by
    sorting (window, position) within the row; only texts whose windows are not
    all distinct pay for the sort.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    words = F.when(_trim(t) == "", F.array().cast("array<string>")).otherwise(F.split(_trim(t), WHITE_RUN))
    lines = F.filter(F.split(t, "\n"), lambda x: _trim(x) != "")
    df = df.withColumns({"_qr_words": words, "_qr_lines": lines})
    n = F.size("_qr_words")
    df = df.withColumn("_qr_grams", F.when(n >= WINDOW, F.transform(F.slice("_qr_words", 1, n - (WINDOW - 1)), lambda w, i: F.concat_ws(" ", w, *(F.get("_qr_words", i + k) for k in range(1, WINDOW))))).otherwise(F.array().cast("array<string>")))
    recurs = F.size(F.array_distinct("_qr_grams")) < F.size("_qr_grams")
    empty = F.array().cast("array<struct<g:string,p:int>>")
    df = df.withColumn("_qr_sorted", F.when(recurs, F.sort_array(F.transform("_qr_grams", lambda g, i: F.struct(g.alias("g"), i.alias("p"))))).otherwise(empty))
    s = F.col("_qr_sorted")
    twice = lambda x, i: (x["g"] == F.get(s, i - 1)["g"]) | (x["g"] == F.get(s, i + 1)["g"])
    df = df.withColumn("_qr_starts", F.sort_array(F.transform(F.filter(s, lambda x, i: F.coalesce(twice(x, i), F.lit(False))), lambda x: x["p"])))
    starts = F.col("_qr_starts")
    covered = F.aggregate(
        F.transform(starts, lambda p, i: F.when(i == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), p - F.get(starts, i - 1)))),
        F.lit(0),
        lambda a, x: a + x,
    )
    df = df.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.regexp_replace(t, WHITE_RUN, "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("_qr_lines") - F.size(F.array_distinct("_qr_lines"))).cast("long"),
            "n_lines": F.size("_qr_lines").cast("long"),
            # always true, and never pushed below: a filter on a verdict would
            # otherwise be inlined into the steps above, term by term
            "n_repeat_words": F.when(F.monotonically_increasing_id() >= 0, covered).cast("long"),
            "n_stop_words": F.size(F.filter("_qr_words", lambda w: F.btrim(w, F.lit(OUTER)).isin(*STOP_FORMS))).cast("long"),
        }
    ).drop("_qr_words", "_qr_lines", "_qr_grams", "_qr_sorted", "_qr_starts")
    ratio = lambda a, b: F.col(a) / F.when(F.col(b) > 0, F.col(b))
    return df.withColumns(
        {
            "mean_word_chars": ratio("word_chars", "n_words"),
            "symbol_ratio": ratio("n_symbols", "n_words"),
            "stop_word_ratio": ratio("n_stop_words", "n_words"),
            "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
            "repeat_ratio": ratio("n_repeat_words", "n_words"),
        }
    )


def verdict(df: DataFrame, base: tuple[Rule, ...] = BASE_RULES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add ``base_failed``, ``kept`` and ``failed_rules`` to measured rows."""
    ok = reduce(lambda a, b: a & b, (r.passes() for r in base), F.lit(True))
    more = reduce(lambda a, b: a & b, (r.passes() for r in rules), F.lit(True))
    failed = F.array_compact(F.array(*(F.when(~r.passes(), F.lit(r.name)) for r in (*base, *rules))))
    return df.withColumns({"base_failed": ~ok, "kept": ok & more, "failed_rules": failed})


def judge(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Metrics and verdict of every row."""
    return verdict(measure(df, text_col))


def keep_good(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that pass all rules, with their own columns only. Metrics live
    under reserved names while they are needed, so no column can clash."""
    cols = df.columns
    bare = df.select(F.struct(*(F.col(f"`{c}`") for c in cols)).alias("_qr_row"), F.col(f"`{text_col}`").alias("_qr_text"))
    return judge(bare, "_qr_text").where("kept").select("_qr_row.*")
