"""Text and date policy: which requests and outputs are refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from censemble.functions import fixed

# Word boundaries follow Unicode letters whatever the Java version.
_UNICODE = "(?U)"
REQUEST = list(zip(fixed.REQUEST_ANCHORS, fixed.REQUEST_PATTERNS, strict=True))
OUTPUT = list(zip(fixed.OUTPUT_ANCHORS, fixed.OUTPUT_PATTERNS, strict=True))


def _first_match(lowered: Column, rules: list[tuple[str, str]]) -> Column:
    return F.coalesce(*[
        F.when(lowered.contains(anchor) & lowered.rlike(_UNICODE + pattern), i)
        for i, (anchor, pattern) in enumerate(rules, start=1)
    ])


def with_first_match(df: DataFrame, text: str, rules: list[tuple[str, str]], out: str) -> DataFrame:
    """Adds ``out``: the 1-based number of the first pattern found anywhere in the text, else null.

    The text is lower-cased once per row. A pattern is only run on text that has its anchor, a
    plain substring it cannot match without; most text is cleared by these byte searches.
    """
    found = _first_match(F.col("__lowered"), rules)
    return df.withColumn("__lowered", F.lower(text)).withColumn(out, found).drop("__lowered")


def in_vote_window(vote_date: Column, as_of: Column) -> Column:
    """A live vote at most 60 days ahead; unknown dates pass."""
    days = F.datediff(vote_date, as_of)
    return F.coalesce((days >= 0) & (days <= fixed.REFUSAL_WINDOW_DAYS), F.lit(False))


def check_requests(requests: DataFrame, as_of: Column, text: str = "text", vote_date: str = "vote_date") -> DataFrame:
    """Adds ``refused`` and ``reason`` ('category', 'vote_window' or null); text goes first."""
    near_vote = in_vote_window(F.col(vote_date), as_of)
    return (
        with_first_match(requests, text, REQUEST, "__pattern")
        .withColumn("reason", F.when(F.col("__pattern").isNotNull(), "category").when(near_vote, "vote_window"))
        .withColumn("refused", F.col("reason").isNotNull())
        .drop("__pattern")
    )


def gate_output(rows: DataFrame, text: str) -> DataFrame:
    """Only rows whose text may be written out; put it before any sink that carries text.

    A filter moves below projections with a copy of the text's expression for every time it names
    it. The text is bound once here, so an expensive one, such as a parsed note, is not repeated.
    """
    found = F.transform(F.array(F.lower(text)), lambda lowered: _first_match(lowered, OUTPUT))[0]
    return rows.where(found.isNull())
