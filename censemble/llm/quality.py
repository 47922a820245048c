"""Quality rules, line first: bad lines go, then documents that lose too much text go.

Everything is a DataFrame expression on one row; nothing is shuffled.

Defined results: a null text counts as an empty one (no words, base failed); lines without a word
are neither good nor bad; repeated rows are judged one by one; an empty table gives no rows. Extra
columns of the input are never read.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
WINDOW = 8
MAX_REPEATED_PERCENT = 30
# A document goes if more than this share of its word characters stood in bad lines.
MAX_LOST_PERCENT = 60
# Marks of a shouted or garbled line: more than one symbol to two words.
LINE_MARKS = SYMBOLS + "!"
NAVIGATION_MARKS = "|>»•·"
SENTENCE_END = r"[.!?…。]['\")\]”’»]*(\s|$)"
BOILERPLATE = (
    r"(?i)\b(cookies?|javascript|privacy policy|terms of (use|service)|all rights reserved|copyright|"
    r"licensed under|subscribe|newsletter|sign (in|up)|log ?in|click here|read more|share this|"
    r"powered by)\b"
)
BOILERPLATE_WORDS = 25


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than space, tab, newline, VT, FF and CR."""
    return F.regexp_extract_all(text, F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))


def _n_chars_in(text: Column, chars: str) -> Column:
    """How many of the characters the text has; most have none, which a search shows faster."""
    counted = F.length(text) - F.length(F.translate(text, chars, ""))
    return F.when(text.rlike(f"[{re.escape(chars)}]"), counted).otherwise(0)


def _has_word(text: Column) -> Column:
    return text.rlike("[^ \\t\\n\\x0b\\f\\r]")


def _word_chars(text: Column) -> Column:
    return F.length(F.translate(text, SPACES, ""))


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """How many words lie in a window of ``width`` words that the list holds twice or more."""

    def covered(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            twin = F.filter(
                s,
                lambda x, k: F.coalesce(x["h"] == F.get(s, k - 1)["h"], F.lit(False))
                | F.coalesce(x["h"] == F.get(s, k + 1)["h"], F.lit(False)),
            )
            return F.sort_array(F.transform(twin, lambda x: x["i"]))

        def length(r: Column) -> Column:
            steps = F.transform(r, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(r, k + 1) - x, F.lit(width))))
            return F.aggregate(steps, F.lit(0), lambda acc, x: acc + x)

        found = let(let(pairs, starts), length)
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(found)

    def hashed(h: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(h) - width)
        windows = F.transform(places, lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(width)]))
        return F.when(F.size(h) >= width, let(windows, covered)).otherwise(0)

    return let(F.transform(words, lambda w: F.xxhash64(w)), hashed)


def bad_line(line: Column) -> Column:
    """Whether a line with words fails a punctuation, navigation or boilerplate rule."""

    def failing(n_words: Column) -> Column:
        marked = line.rlike(f"[{re.escape(LINE_MARKS + NAVIGATION_MARKS)}]")
        garbled = _n_chars_in(line, LINE_MARKS) * 2 > n_words
        navigation = _n_chars_in(line, NAVIGATION_MARKS) * 4 >= n_words
        boilerplate = (n_words <= BOILERPLATE_WORDS) & line.rlike(BOILERPLATE)
        return ~line.rlike(SENTENCE_END) | marked & (garbled | navigation) | boilerplate

    trimmed = F.trim(line)
    return let(F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "), F.lit(""))) + 1, failing)


def good_lines(text: Column) -> Column:
    """The lines that hold no word or pass every rule, in order."""
    return F.filter(F.split(text, "\n"), lambda x: ~_has_word(x) | ~bad_line(x))


def quality(docs: DataFrame, text: str = "text", out_name: str = "quality") -> DataFrame:
    """Adds the struct ``out_name``: base figures, verdicts and ``clean_text`` (good lines only)."""
    # A name that no input column has, so that the text can be cleaned up once.
    whole = fresh(docs, "whole")
    lines, words = fresh(docs, "lines"), fresh(docs, "words")
    out = docs.withColumn(whole, F.coalesce(F.col(text), F.lit("")))
    out = out.withColumn(lines, F.filter(F.split(F.col(whole), "\n"), _has_word))
    out = out.withColumn(words, words_of(F.col(whole)))
    # Figures leave through a generator, which later projections and filters cannot work out anew.
    out = out.select(
        *docs.columns,
        whole,
        F.explode(F.array(F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            _n_chars_in(F.col(whole), SYMBOLS).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            repeated_words(F.col(words)).cast("long").alias("n_repeat_words"),
            F.array_join(good_lines(F.col(whole)), "\n").alias("clean_text"),
        ))).alias(out_name),
    )
    q = F.col(out_name)
    base_failed = (q["n_words"] < MIN_WORDS) | (
        q["n_repeat_words"] * 100 > q["n_words"] * MAX_REPEATED_PERCENT
    )
    same = q["clean_text"] == F.col(whole)
    left = F.when(same, q["word_chars"]).otherwise(_word_chars(q["clean_text"]).cast("long"))
    lost_much = (q["word_chars"] - left) * 100 > q["word_chars"] * MAX_LOST_PERCENT
    out = out.withColumn(out_name, q.withField("base_failed", base_failed).withField("kept_chars", left))
    kept = ~F.col(out_name)["base_failed"] & ~lost_much
    return out.withColumn(out_name, F.col(out_name).withField("kept", kept)).drop(whole)


def fresh(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def keep_good(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """The documents that pass, with bad lines cut out of their text; the columns stay the same."""
    columns, name = docs.columns, fresh(docs, "quality")
    out = quality(docs, text, name)
    out = out.where(F.col(name)["kept"]).withColumn(text, F.col(name)["clean_text"])
    if n_chars in columns:
        out = out.withColumn(n_chars, F.length(text).cast(docs.schema[n_chars].dataType))
    return out.select(*columns)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures and the verdict for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    q = F.col("quality")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_chars"]
    return quality(docs).select("doc_id", *[q[n].alias(n) for n in names])
