"""Prompt tables for batch inference, with shared text stored once.

A prompt is two lists of segment keys, ``system`` and ``user``; a segment is a piece of text under the
md5 of itself. Literal parts of a template, the context of a run, the framing of a measure and the
backstory of a persona are one row each in the segment table, however many prompts use them: a run of a
million personas has its transcript once, not a million times. ``expand`` gives the full texts.

Templates are parameters with ``{name}`` places, as in ``fill_template``; null fields are empty.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from censemble.operators.skew import lookup_join, split_join

SEGMENT = "key string, text string"


def segment_key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def _literal_key(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()


def _pieces(template: str) -> list[tuple[bool, str]]:
    """(is a field, name or text) in order; doubled braces are braces."""
    out: list[tuple[bool, str]] = []
    for part in re.split(r"(\{\{|\}\}|\{\w+\})", template):
        if re.fullmatch(r"\{\w+\}", part):
            out.append((True, part[1:-1]))
        elif part:
            text = part[0] if part in ("{{", "}}") else part
            if out and not out[-1][0]:
                text = out.pop()[1] + text
            out.append((False, text))
    return out


def keyed(template: str, **keys: Column) -> Column:
    """The template as a list of segment keys; fields are given by the keys of their text."""
    parts = [keys[text] if field else F.lit(_literal_key(text)) for field, text in _pieces(template)]
    return F.array(*parts) if parts else F.array().cast("array<string>")


def literals(spark: SparkSession, *templates: str) -> DataFrame:
    """Segments of the templates' own text."""
    texts = sorted({text for t in templates for field, text in _pieces(t) if not field})
    return spark.createDataFrame([(_literal_key(t), t) for t in texts], SEGMENT)


def segments(*texts: DataFrame) -> DataFrame:
    """Distinct segments of frames with one column of text each, or of key and text."""
    def both(df: DataFrame) -> DataFrame:
        if df.columns == ["key", "text"]:
            return df
        text = F.coalesce(F.col(df.columns[0]).cast("string"), F.lit(""))
        return df.select(segment_key(text).alias("key"), text.alias("text"))

    return reduce(DataFrame.unionByName, map(both, texts)).groupBy("key").agg(F.first("text").alias("text"))


def vote_prompts(
    personas: DataFrame, measures: DataFrame, run: Sequence[str], system: str, user: str, contexts: DataFrame | None = None,
    heading: str = "",
) -> tuple[DataFrame, DataFrame]:
    """One prompt per run and persona draw, and the segments.

    ``personas``: run, persona_id, draw_no, backstory. ``measures``: run, framing. ``contexts``: run,
    context (the transcript that a final vote sees); runs without one, or all without ``contexts``, get
    no heading. ``system`` has the place {backstory}, ``user`` {framing}.
    """
    run = list(run)
    asked = measures.select(*run, segment_key(F.col("framing")).alias("__framing"))
    texts = [personas.select("backstory"), measures.select("framing")]
    if contexts is not None:
        asked = asked.join(contexts.select(*run, segment_key(F.col("context")).alias("__context")), run, "left")
        texts.append(contexts.select("context"))
    else:
        asked = asked.withColumn("__context", F.lit(None).cast("string"))
    seats = personas.select(*run, "persona_id", "draw_no", segment_key(F.col("backstory")).alias("__backstory"))
    rows = split_join(seats, asked, run, "inner", spread_by=["persona_id", "draw_no"])
    head = F.when(F.col("__context").isNotNull(), F.array(F.lit(_literal_key(heading)), F.col("__context")))
    told = rows.select(
        *run, "persona_id", "draw_no",
        F.concat(keyed(system, backstory=F.col("__backstory")), F.coalesce(head, F.array().cast("array<string>"))).alias("system"),
        keyed(user, framing=F.col("__framing")).alias("user"),
    )
    own = literals(personas.sparkSession, system, user, heading.replace("{", "{{").replace("}", "}}"))
    return told, segments(own, *texts)


def deliberation_prompts(
    turns: DataFrame, personas: DataFrame, measures: DataFrame, run: Sequence[str], system: str, user: str
) -> tuple[DataFrame, DataFrame]:
    """One prompt per turn, and the segments.

    ``turns``: run, seq, speaker_id, round, context (see ``recent_context``). ``personas``: run,
    persona_id, backstory. ``measures``: run, n_rounds. ``system`` has the place {backstory}, ``user``
    {round}, {total} and {context}. Turns of a speaker who is no persona (the moderator) are left out.
    """
    run = list(run)
    known = personas.groupBy(*run, F.col("persona_id").alias("speaker_id")).agg(F.min("backstory").alias("backstory"))
    keys = known.select(*run, "speaker_id", segment_key(F.col("backstory")).alias("__backstory"))
    rows = split_join(turns, keys, [*run, "speaker_id"], "inner", spread_by=["seq"])
    rows = split_join(rows, measures.select(*run, "n_rounds"), run, "inner", spread_by=["seq"])
    fields = {"round": F.col("round").cast("string"), "total": F.col("n_rounds").cast("string"), "context": F.col("context")}
    told = rows.select(
        *run, "seq", keyed(system, backstory=F.col("__backstory")).alias("system"),
        keyed(user, **{name: segment_key(text) for name, text in fields.items()}).alias("user"),
    )
    numbers = [turns.select(F.col("round").cast("string")).distinct(), measures.select(F.col("n_rounds").cast("string")).distinct()]
    return told, segments(literals(turns.sparkSession, system, user), known.select("backstory"), turns.select("context"), *numbers)


def critic_prompts(
    statements: DataFrame, measures: DataFrame, run: Sequence[str], system: str, user: str, empty: str = "[empty]"
) -> tuple[DataFrame, DataFrame]:
    """One prompt per statement, and the segments.

    ``statements``: run, seq, text. ``measures``: run, briefing_sources (a list, one to a line).
    ``user`` has the places {statement} and {sources}. An empty statement reads ``empty``.
    """
    run = list(run)
    text = F.when(F.length("text") > 0, F.col("text")).otherwise(empty)
    listed = measures.select(*run, F.coalesce(F.array_join("briefing_sources", "\n"), F.lit("")).alias("sources"))
    keys = listed.select(*run, segment_key(F.col("sources")).alias("__sources"))
    said = statements.select(*run, "seq", text.alias("text"))
    rows = split_join(said, keys, run, "inner", spread_by=["seq"])
    told = rows.select(
        *run, "seq", keyed(system).alias("system"),
        keyed(user, statement=segment_key(F.col("text")), sources=F.col("__sources")).alias("user"),
    )
    return told, segments(literals(statements.sparkSession, system, user), said.select("text"), listed.select("sources"))


def probe_prompts(measures: DataFrame, on: Sequence[str], system: str, user: str) -> tuple[DataFrame, DataFrame]:
    """One prompt per measure, and the segments.

    ``user`` has the places {title}, {state}, {year} and {framing}.
    """
    fields = ("title", "state", "year", "framing")
    told = measures.select(
        *on, keyed(system).alias("system"), keyed(user, **{f: segment_key(F.col(f).cast("string")) for f in fields}).alias("user")
    )
    return told, segments(literals(measures.sparkSession, system, user), *[measures.select(F.col(f).cast("string")) for f in fields])


def expand(prompts: DataFrame, stored: DataFrame, on: Sequence[str]) -> DataFrame:
    """``on`` (a key of the prompts), and ``system`` and ``user`` as texts."""
    on = list(on)
    sides = F.array(*[F.struct(F.lit(name).alias("side"), F.col(name).alias("keys")) for name in ("system", "user")])
    each = prompts.select(*on, F.explode(sides).alias("s")).select(*on, "s.side", F.posexplode("s.keys").alias("at", "key"))
    # A key is one segment, so hot ones (literals, a run's context) are split by Spark at run time.
    found = lookup_join(each, stored, ["key"], "left")
    told = F.coalesce("text", F.raise_error(F.concat(F.lit("no segment "), F.col("key"))).cast("string"))

    def text(side: str) -> Column:
        # As many entries as a template has parts.
        entries = F.sort_array(F.collect_list(F.when(F.col("side") == side, F.struct("at", told.alias("text")))))
        return F.array_join(F.transform(entries, lambda e: e["text"]), "").alias(side)

    return found.groupBy(*on).agg(text("system"), text("user"))
