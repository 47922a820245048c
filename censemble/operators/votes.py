"""Vote analytics: shares, opinion change, segments, groups and seed sensitivity.

Votes carry a run key (any columns), seq, persona_id, phase ('pre' or 'post') and stance. Every
result is keyed by the run, so any number of runs is one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from censemble.functions import fixed
from censemble.functions.exact import exact_mean, exact_sum
from censemble.operators.skew import HOT_ROWS, lookup_join, split_join

AXES = ["party_id", "age_band", "education", "race_eth"]


def says_yes(stance: Column) -> Column:
    """Strictly above one half."""
    return stance > 0.5


def _known(value: Column, on: Sequence[str]) -> Column:
    """``value``, or an error that names the measure if a join found none."""
    told = F.concat(F.lit("unknown measure: "), F.concat_ws(", ", *[F.col(c).cast("string") for c in on]))
    return F.when(value.isNull(), F.raise_error(told).cast("int")).otherwise(value)


def with_phase(votes: DataFrame, measures: DataFrame, on: Sequence[str] = ("measure_id",)) -> DataFrame:
    """Adds ``phase``: round 0 is 'pre', the round after the last is 'post', others 'middle'.

    Votes on a measure that is not listed are an error. Middle votes stay, so that a run which has
    no others still has a result; nothing counts them.
    """
    rounds = measures.select(*on, F.col("n_rounds").alias("__rounds"))
    tagged = lookup_join(votes, rounds, on, "left")
    last = _known(F.col("__rounds"), on)
    phase = F.when(F.col("round") == last + 1, "post").when(F.col("round") == 0, "pre").otherwise("middle")
    return tagged.withColumn("phase", phase).drop("__rounds")


def _is_post() -> Column:
    return F.col("phase") == "post"


def yes_shares(votes: DataFrame, run: Sequence[str]) -> DataFrame:
    """Per run: post votes, share above one half and mean stance, in percent; 50 if none voted."""
    post = _is_post()
    return votes.groupBy(*run).agg(
        F.count(F.when(post, 1)).alias("n_votes"),
        F.coalesce(
            100.0 * F.sum(F.when(post, says_yes(F.col("stance")).cast("int"))) / F.count(F.when(post, F.col("stance"))),
            F.lit(50.0),
        ).alias("yes_pct"),
        F.coalesce(100.0 * exact_mean(F.when(post, F.col("stance"))), F.lit(50.0)).alias("weighted_pct"),
    )


def _paired(votes: DataFrame, run: Sequence[str], hot_rows: int) -> DataFrame:
    """Every post vote beside its persona's last pre vote by seq: adds pre_stance, null if there is none.

    A persona with very many post votes is spread over tasks by ``split_join``. Votes are read three times.
    """
    key = [*run, "persona_id"]
    post = votes.where(_is_post()).select(*key, "seq", "stance")
    # By seq, without a struct: such aggregates are hashed, not sorted.
    pre = votes.where(F.col("phase") == "pre").groupBy(*key).agg(F.max_by("stance", "seq").alias("pre_stance"))
    return split_join(post, pre, key, "left", hot_rows, spread_by=["seq"])


def _changes() -> dict[str, Column]:
    """Sums over paired votes: matched votes, their absolute change, and flips."""
    delta = F.col("stance") - F.col("pre_stance")
    flip = says_yes(F.col("stance")) != says_yes(F.col("pre_stance"))
    return {
        "n_matched": F.count("pre_stance"),
        "abs_delta_sum": F.coalesce(exact_sum(F.abs(delta)), F.lit(0.0)),
        "n_flips": F.count(F.when(flip, 1)),
    }


def ballots(votes: DataFrame, run: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per run and persona with a post vote, ready to be summed along any axis.

    Columns: n_post, stance_sum, n_matched, abs_delta_sum, n_flips. The last pre vote by seq
    counts; post votes are all kept.
    """
    return _paired(votes, run, hot_rows).groupBy(*run, "persona_id").agg(
        F.count(F.lit(1)).alias("n_post"),
        exact_sum(F.col("stance")).alias("stance_sum"),
        *[value.alias(name) for name, value in _changes().items()],
    )


def opinion_change(votes: DataFrame, run: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Per run: mean absolute stance change, share that crossed one half, matched post votes.

    Runs without a matched pair read zeros. Votes are summed per run in the task that pairs them; no row per persona is made.
    """
    changed = _paired(votes, run, hot_rows).groupBy(*run).agg(*[value.alias(name) for name, value in _changes().items()])
    every = votes.select(*run).distinct()
    n = F.nullif(F.col("n_matched"), F.lit(0))
    # Both sides have one row per run.
    return every.join(changed, list(run), "left").select(
        *run,
        F.coalesce(F.col("abs_delta_sum") / n, F.lit(0.0)).alias("mean_abs_delta"),
        F.coalesce(F.col("n_flips") / n, F.lit(0.0)).alias("flip_rate"),
        F.coalesce("n_matched", F.lit(0).cast("bigint")).alias("n"),
    )


def _labelled(axis: str) -> Column:
    """A set of values as (axis, value) entries."""
    return F.transform(axis, lambda v: F.struct(F.lit(axis).alias("axis"), v.alias("value")))


def segment_breakdown(
    votes: DataFrame,
    personas: DataFrame,
    run: Sequence[str],
    k: int = fixed.SEGMENT_MIN_N,
    axes: Sequence[str] = AXES,
) -> DataFrame:
    """Per run, axis and value: post votes, mean stance share and mean change.

    Values with fewer than k votes keep only their count and ``suppressed``. A persona id with
    two values on an axis counts under both.
    """
    key = [*run, "persona_id"]
    # Rows with the same id and value are one membership. A set holds the few values of an axis,
    # so a persona is one row here however often it was drawn, and meets its one ballot row.
    members = personas.groupBy(*key).agg(*[F.collect_set(a).alias(a) for a in axes])
    joined = members.join(ballots(votes, run), key, "left").select(
        *run, "n_post", "stance_sum", "n_matched", "abs_delta_sum",
        F.explode(F.concat(*[_labelled(a) for a in axes])).alias("m"),
    ).select("*", "m.axis", "m.value")
    # Values without any voting persona stay, with n = 0.
    n = F.coalesce(F.sum("n_post"), F.lit(0).cast("bigint"))
    matched = F.sum("n_matched")
    return joined.groupBy(*run, "axis", "value").agg(
        n.alias("n"),
        (n < k).alias("suppressed"),
        F.when(n >= k, 100.0 * exact_sum(F.col("stance_sum")) / n).alias("pred_yes_pct"),
        F.when(
            n >= k, F.when(matched > 0, exact_sum(F.col("abs_delta_sum")) / matched).otherwise(0.0)
        ).alias("mean_abs_delta"),
    )


def protect_segments(segments: DataFrame, run: Sequence[str], k: int = fixed.SEGMENT_MIN_N) -> DataFrame:
    """Segments that cannot be worked out from the others: adds ``withheld``.

    If one value of an axis is suppressed, the pooled result less all other values gives it away; if
    several are, what they have in common may still be of fewer than k votes. So on every axis with a
    value of 1 to k - 1 votes (``withheld`` = 'small') the smallest shown values go too ('complement'), until
    at least two values are withheld and they have k votes together; ties go by value. Values without votes stay
    ``suppressed`` and protect nothing. If an axis has not enough values, all of them are withheld.
    ``segments``: as from ``segment_breakdown``; counts are kept.
    """
    small = (F.col("n") > 0) & (F.col("n") < k)
    # An axis has few values, so these windows are small.
    axis = W.partitionBy(*run, "axis")
    before = axis.orderBy(F.col("__small").desc(), "n", "value").rowsBetween(W.unboundedPreceding, -1)
    voted = segments.withColumn("__small", small).withColumns({
        "__any": F.max("__small").over(axis),
        "__taken": F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).over(before),
        "__votes": F.sum("n").over(before),
    })
    taken, votes = F.coalesce("__taken", F.lit(0)), F.coalesce("__votes", F.lit(0))
    more = F.col("__any") & (F.col("n") > 0) & ((taken < 2) | (votes < k))
    withheld = F.when(F.col("__small"), "small").when(more, "complement")
    told = voted.withColumn("withheld", withheld)
    shown = F.col("withheld").isNull()
    return told.withColumns({c: F.when(shown, F.col(c)) for c in ("pred_yes_pct", "mean_abs_delta")}).drop(
        "__small", "__any", "__taken", "__votes"
    )


def _spread(values: str) -> list[Column]:
    """Mean, sample deviation (0 for one value) and mean +- 1.96 deviations."""
    mean = F.avg(values)
    sd = F.coalesce(F.stddev_samp(values), F.lit(0.0))
    return [
        mean.alias("mean_predicted"),
        sd.alias("sd_predicted"),
        (mean - 1.96 * sd).alias("ci_low"),
        (mean + 1.96 * sd).alias("ci_high"),
    ]


def score_runs(predicted: DataFrame, truth: DataFrame, on: Sequence[str] = ("measure_id",)) -> DataFrame:
    """Adds actual share, absolute errors and Brier score to per-run predictions.

    A run of a measure that is not listed is an error.
    """
    known = truth.select(*on, F.col("yes_pct").alias("actual_yes_pct"), "passed", F.lit(1).alias("__listed"))
    scored = lookup_join(predicted, known, on, "left")
    actual = F.when(_known(F.col("__listed"), on) == 1, F.col("actual_yes_pct"))
    scored = scored.withColumn("actual_yes_pct", actual).drop("__listed")
    outcome = F.when(F.col("passed"), 1.0).otherwise(0.0)
    return scored.withColumns(
        {
            "mae_threshold": F.abs(F.col("yes_pct") - F.col("actual_yes_pct")),
            "mae_weighted": F.abs(F.col("weighted_pct") - F.col("actual_yes_pct")),
            "brier": F.pow(F.col("weighted_pct") / 100.0 - outcome, F.lit(2.0)),
        }
    )


def sensitivity(scored: DataFrame) -> DataFrame:
    """Per measure over seeds: mean, deviation, interval, extremes, spread and mean errors."""
    return scored.groupBy("measure_id").agg(
        F.count(F.lit(1)).alias("n_seeds"),
        F.max("actual_yes_pct").alias("actual_yes_pct"),
        *_spread("weighted_pct"),
        F.min("weighted_pct").alias("min_predicted"),
        F.max("weighted_pct").alias("max_predicted"),
        (F.max("weighted_pct") - F.min("weighted_pct")).alias("spread"),
        F.avg("mae_weighted").alias("mean_mae"),
        F.avg("brier").alias("mean_brier"),
    )


def multigroup(votes: DataFrame, truth: DataFrame, intervals: DataFrame | None = None) -> DataFrame:
    """Independent groups per measure: spread between groups beside the pooled result.

    ``votes`` carries measure_id and group_id. Pooled numbers are those of the same functions
    keyed by the measure alone; ``intervals`` may bring the pooled bootstrap interval.
    """
    groups = yes_shares(votes, ["measure_id", "group_id"])
    between = groups.groupBy("measure_id").agg(
        F.count(F.lit(1)).alias("n_groups"), F.sum("n_votes").alias("n_votes"), *_spread("weighted_pct")
    )
    pooled = score_runs(yes_shares(votes, ["measure_id"]), truth).select(
        "measure_id", F.col("weighted_pct").alias("pooled_predicted"), "actual_yes_pct", "mae_weighted"
    )
    change = opinion_change(votes, ["measure_id"]).withColumnRenamed("n", "n_matched")
    # One row per measure on every side.
    out = between.join(pooled, "measure_id").join(change, "measure_id")
    return out if intervals is None else out.join(intervals, "measure_id", "left")


def backtest_summary(scored: DataFrame, costs: DataFrame, run: Sequence[str]) -> DataFrame:
    """Per measure and over all (``level`` 1, null measure_id): mean errors and total cost.

    ``scored`` and ``costs`` have one row per run; ``run`` are its key columns, measure_id among
    them, so a measure's cost is the sum over its runs.
    """
    if "measure_id" not in run:
        raise ValueError("a run's key must hold its measure_id")
    rows = scored.join(costs, list(run), "left").withColumn("cost", F.coalesce("cost_usd", F.lit(0.0)))
    return rows.rollup("measure_id").agg(
        F.grouping_id().cast("int").alias("level"),
        F.count(F.lit(1)).alias("n_runs"),
        F.sum("n_personas").alias("n_personas"),
        F.avg("weighted_pct").alias("predicted"),
        F.avg("actual_yes_pct").alias("actual"),
        F.avg("mae_weighted").alias("mae"),
        F.avg("brier").alias("brier"),
        F.sum("cost").alias("cost_usd"),
    )


def segment_error(segments: DataFrame, certified: DataFrame, run: Sequence[str]) -> DataFrame:
    """Predicted against certified share per segment; suppressed segments are left out.

    Segments without a certified value are left out as well; ``uncertified_segments`` lists them.
    """
    shown = segments.where(~F.col("suppressed"))
    keys = [*run, "axis", "value"]
    return shown.join(certified, keys).withColumn(
        "abs_error", F.abs(F.col("pred_yes_pct") - F.col("certified_yes_pct"))
    )


def uncertified_segments(segments: DataFrame, certified: DataFrame, run: Sequence[str]) -> DataFrame:
    """Shown segments that have no certified value to be held against, with their votes."""
    keys = [*run, "axis", "value"]
    known = certified.where(F.col("certified_yes_pct").isNotNull())
    return segments.where(~F.col("suppressed")).join(known, keys, "leftanti").select(*keys, "n")


def model_divergence(scored: DataFrame) -> DataFrame:
    """Per measure across model stamps: how many models, and the range of their predictions.

    A model's prediction is the mean over its runs. The range says how far any two models differ
    at most, without pairing them.
    """
    by_model = scored.groupBy("measure_id", "model").agg(F.avg("weighted_pct").alias("weighted_pct"))
    return by_model.groupBy("measure_id").agg(
        F.count(F.lit(1)).alias("n_models"),
        F.min("weighted_pct").alias("min_predicted"),
        F.max("weighted_pct").alias("max_predicted"),
        (F.max("weighted_pct") - F.min("weighted_pct")).alias("divergence"),
        F.min_by("model", "weighted_pct").alias("lowest_model"),
        F.max_by("model", "weighted_pct").alias("highest_model"),
    )
