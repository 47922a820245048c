"""Deliberation transcripts: context windows, ablated contexts, turn quotas and influence.

Statements carry a run key, seq (their place in the run), speaker_id, round, text and flagged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from censemble.functions import fixed
from censemble.functions.text import transcript_line
from censemble.operators.skew import BLOCK_ROWS, first_k, lowest_share, positions, split_join

# Statements per window block, as a power of two; smaller than elsewhere since they carry text.
CONTEXT_BLOCK_BITS = 16


def _line() -> Column:
    return transcript_line(F.col("speaker_id"), F.col("round"), F.col("flagged"), F.col("text"))


def _joined(lines: Column) -> Column:
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(fixed.EMPTY_TRANSCRIPT)


def recent_context(
    statements: DataFrame,
    run: Sequence[str],
    limit: int = fixed.SPEAKING_CONTEXT,
    block_bits: int = CONTEXT_BLOCK_BITS,
) -> DataFrame:
    """Per statement, the text of the ``limit`` statements before it in the run.

    The run is windowed in blocks of consecutive places. The last ``limit`` rows of a block are
    copied into the next one as context only, so every window is bounded and none is cut short.
    """
    if limit > 1 << block_bits:
        raise ValueError("a block must hold the whole context")
    run = list(run)
    lines = statements.select(*run, "seq", "speaker_id", "round", _line().alias("line"))
    placed = positions(lines, run, "seq", "__at", block_bits)
    block = F.shiftright(F.col("__at"), block_bits)
    in_block = F.col("__at").bitwiseAND(F.lit((1 << block_bits) - 1))
    own = F.struct(block.alias("block"), F.lit(True).alias("own"))
    ahead = F.struct((block + 1).alias("block"), F.lit(False).alias("own"))
    copies = F.when(in_block >= (1 << block_bits) - limit, F.array(own, ahead)).otherwise(F.array(own))
    spread = placed.withColumn("__copy", F.explode(copies)).select(
        *run, "seq", "speaker_id", "round", "line", "__at",
        F.col("__copy.block").alias("__block"), F.col("__copy.own").alias("__own"),
    )
    before = W.partitionBy(*run, "__block").orderBy("__at").rowsBetween(-limit, -1)
    return (
        spread.withColumn("__lines", F.collect_list("line").over(before))
        .where("__own")
        .select(*run, "seq", "speaker_id", "round", _joined(F.col("__lines")).alias("context"))
    )


def final_context(statements: DataFrame, run: Sequence[str], limit: int = fixed.FINAL_CONTEXT) -> DataFrame:
    """Per run, the text of its last ``limit`` statements."""
    run = list(run)
    lines = statements.select(*run, "seq", _line().alias("line"))
    last = first_k(lines, run, [F.col("seq").desc()], limit)
    # `limit` rows per run.
    return last.groupBy(*run).agg(
        _joined(F.transform(F.sort_array(F.collect_list(F.struct("seq", "line"))), lambda s: s["line"]))
        .alias("context")
    )


def speakers(statements: DataFrame, run: Sequence[str]) -> DataFrame:
    """Distinct speakers per run without the moderator."""
    return statements.where(F.col("speaker_id") != fixed.MODERATOR).select(*run, "speaker_id").distinct()


def ablated_context(
    statements: DataFrame, run: Sequence[str], limit: int = fixed.FINAL_CONTEXT
) -> DataFrame:
    """Per run and speaker, the final context as if that speaker had said nothing.

    No speaker x statement grid is built. The last ``limit`` statements without speaker s are
    among every speaker's own last ``limit``, and among the last 2 * limit of those, because at
    most ``limit`` of them are by s. So a run needs at most 2 * limit lines for all speakers.
    """
    run = list(run)
    lines = statements.select(*run, "seq", "speaker_id", _line().alias("line"))
    newest = [F.col("seq").desc()]
    own_last = first_k(lines, [*run, "speaker_id"], newest, limit)
    tail = first_k(own_last, run, newest, 2 * limit)
    tails = tail.groupBy(*run).agg(
        F.sort_array(F.collect_list(F.struct("seq", "speaker_id", "line"))).alias("__tail")
    )
    each = split_join(speakers(statements, run), tails, run, "inner", spread_by=["speaker_id"])
    kept = F.filter("__tail", lambda s: s["speaker_id"] != F.col("speaker_id"))
    last = F.slice(
        F.col("__kept"), F.greatest(F.lit(1), F.size("__kept") - limit + 1), F.lit(limit)
    )
    return each.withColumn("__kept", kept).select(
        *run, "speaker_id", _joined(F.transform(last, lambda s: s["line"])).alias("context")
    )


def statement_counts(statements: DataFrame, run: Sequence[str]) -> DataFrame:
    """Statements and flagged statements per run and speaker."""
    return statements.groupBy(*run, "speaker_id").agg(
        F.count(F.lit(1)).alias("n_statements"), F.count_if("flagged").alias("n_flagged")
    )


def next_speakers(
    roster: DataFrame, statements: DataFrame, run: Sequence[str], block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Who speaks next: the third of the roster (at least one) that spoke least, ties by id.

    ``roster`` has the run key, persona_id and draw_no, one row per seat.
    """
    run = list(run)
    spoken = (
        statements.where(F.col("speaker_id") != fixed.MODERATOR)
        .groupBy(*run, F.col("speaker_id").alias("persona_id"))
        .agg(F.count(F.lit(1)).alias("n_spoken"))
    )
    seats = split_join(roster.select(*run, "persona_id", "draw_no"), spoken, [*run, "persona_id"], "left",
                       spread_by=["draw_no"])
    seats = seats.withColumn("n_spoken", F.coalesce("n_spoken", F.lit(0).cast("bigint")))
    chosen = lowest_share(seats, run, "n_spoken", "persona_id", "draw_no", 3, "turn", block_rows)
    return chosen.select(
        *run, "persona_id", "draw_no", "n_spoken", (F.col("turn") + 1).alias("turn")
    )


def speaker_influence(
    baseline: DataFrame, counterfactual: DataFrame, statements: DataFrame, run: Sequence[str], strict: bool = True
) -> DataFrame:
    """Leave-one-speaker-out influence on the final vote.

    ``baseline``: run, persona_id, seq, stance (the last by seq counts). ``counterfactual``: run,
    speaker_id, persona_id, stance. Positive signed shift means the speaker raised support. A
    counterfactual vote of a persona without a baseline is an error when the rows are worked out;
    with ``strict=False`` it is left out and counted in ``n_unmatched``. A speaker with votes but without a
    statement has a row too.
    """
    run = list(run)
    base = baseline.groupBy(*run, "persona_id").agg(F.max_by("stance", "seq").alias("base_stance"))
    shift = F.col("base_stance") - F.col("stance")
    paired = split_join(
        counterfactual.select(*run, "speaker_id", "persona_id", "stance"), base, [*run, "persona_id"],
        "left", spread_by=["speaker_id"],
    )
    if strict:
        told = F.concat(F.lit("no baseline vote of "), F.col("persona_id"))
        missing = F.col("base_stance").isNull() & F.col("stance").isNotNull()
        paired = paired.withColumn("base_stance", F.when(missing, F.raise_error(told).cast("double")).otherwise(F.col("base_stance")))
    moved = paired.groupBy(*run, "speaker_id").agg(
        F.count("base_stance").alias("n_personas"),
        (F.count(F.lit(1)) - F.count("base_stance")).alias("n_unmatched"),
        F.avg(shift).alias("mean_signed_shift"),
        F.avg(F.abs(shift)).alias("mean_abs_shift"),
    )
    said = statement_counts(statements, run).where(F.col("speaker_id") != fixed.MODERATOR)
    # One row per run and speaker on both sides.
    counts = [] if strict else [F.coalesce("n_unmatched", F.lit(0).cast("bigint")).alias("n_unmatched")]
    return said.join(moved, [*run, "speaker_id"], "full").select(
        *run, "speaker_id", F.coalesce("n_statements", F.lit(0).cast("bigint")).alias("n_statements"), *counts,
        F.coalesce("n_personas", F.lit(0).cast("bigint")).alias("n_personas"),
        F.coalesce("mean_signed_shift", F.lit(0.0)).alias("mean_signed_shift"),
        F.coalesce("mean_abs_shift", F.lit(0.0)).alias("mean_abs_shift"),
    )


def ranked_influence(influence: DataFrame, run: Sequence[str]) -> DataFrame:
    """Report order: strongest movers first within each run, ties by speaker."""
    return influence.orderBy(*run, F.col("mean_abs_shift").desc(), "speaker_id")
