"""Backtests over tables of votes and statements: reports, sweeps, groups, influence.

A run is (measure_id, seed); all runs are worked out together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from censemble.functions.policy import check_requests
from censemble.operators import spend, transcripts
from censemble.operators import votes as vot
from censemble.operators.bootstrap import bootstrap_interval
from censemble.operators.calibration import contamination
from censemble.sources import readers, writers

RUN = ["measure_id", "seed"]


def allowed_measures(measures: DataFrame, as_of: Column, vote_date: Column | None = None) -> DataFrame:
    """Measures whose framing, and vote date if known, may be run. Apply before anything else."""
    dated = measures.withColumn("__vote_date", F.lit(None).cast("date") if vote_date is None else vote_date)
    checked = check_requests(dated, as_of, "framing", "__vote_date")
    return checked.where(~F.col("refused")).drop("refused", "reason", "__vote_date")


def run_reports(
    votes: DataFrame, personas: DataFrame, statements: DataFrame, measures: DataFrame, calls: DataFrame,
    prices: DataFrame, provider: str = "gemini", strict: bool = True,
) -> DataFrame:
    """One row per run: prediction, errors, interval, opinion change, critic flags and cost.

    ``votes``: measure_id, seed, seq, persona_id, round, stance. ``calls`` carry measure_id and
    seed. Runs of measures that are not listed are an error, and calls of models without a price
    too, unless ``strict`` is off: then they are counted.
    """
    phased = vot.with_phase(votes, measures)
    scored = vot.score_runs(vot.yes_shares(phased, RUN), measures)
    change = vot.opinion_change(phased, RUN).withColumnRenamed("n", "n_matched")
    interval = bootstrap_interval(phased, RUN, F.col("seed"))
    flagged = statements.groupBy(*RUN).agg(F.count_if("flagged").alias("n_flagged"))
    people = personas.groupBy(*RUN).agg(F.count(F.lit(1)).alias("n_personas"))
    cost = spend.priced_calls(calls, prices, strict).groupBy(*RUN).agg(
        F.sum("usd").cast("double").alias("cost_usd"), F.count_if(F.col("usd").isNull()).alias("unpriced_calls")
    )
    stamp = spend.model_stamp(calls, RUN, provider).withColumnRenamed("stamp", "model_version")
    rounds = measures.select("measure_id", "n_rounds")
    # Every table here has one row per run, or per measure.
    out = scored.join(change, RUN).join(interval, RUN).join(rounds, "measure_id")
    for part in (flagged, people, cost, stamp):
        out = out.join(part, RUN, "left")
    return out.fillna({"n_flagged": 0, "n_personas": 0, "cost_usd": 0.0, "unpriced_calls": 0})


def run_segments(votes: DataFrame, personas: DataFrame, measures: DataFrame) -> DataFrame:
    """Segments of every run, small ones suppressed."""
    return vot.segment_breakdown(vot.with_phase(votes, measures), personas, RUN)


def sensitivity_report(reports: DataFrame) -> DataFrame:
    return vot.sensitivity(reports)


def multigroup_report(votes: DataFrame, measures: DataFrame, base_seed: int) -> DataFrame:
    """Groups are the seeds of a measure; the pooled interval resamples over all groups."""
    phased = vot.with_phase(votes, measures).withColumnRenamed("seed", "group_id")
    pooled = phased.withColumn("seq", F.col("seq") + F.col("group_id").cast("bigint") * (1 << 40))
    interval = bootstrap_interval(pooled, ["measure_id"], F.lit(base_seed)).select(
        "measure_id", F.col("ci_low").alias("pooled_ci_low"), F.col("ci_high").alias("pooled_ci_high")
    )
    return vot.multigroup(pooled, measures, interval)


def summary_report(reports: DataFrame) -> DataFrame:
    """Per measure over its runs, and over all."""
    return vot.backtest_summary(reports.drop("cost_usd"), reports.select(*RUN, "cost_usd"), RUN)


def influence_report(
    baseline: DataFrame, counterfactual: DataFrame, statements: DataFrame
) -> DataFrame:
    return transcripts.ranked_influence(
        transcripts.speaker_influence(baseline, counterfactual, statements, RUN), RUN
    )


def contamination_report(probes: DataFrame, out: str) -> None:
    """Probe results with error and flag as JSON, one row per measure and seed; a result whose
    note is refused is not written."""
    writers.write_report(contamination(probes).drop("response"), out)


def report_artifacts(spark: SparkSession, artifacts_path: str, measures: DataFrame, calls: DataFrame, out: str, base_seed: int = 42) -> None:
    """Read run artifacts, work out all reports, and write them through the output gate."""
    artifacts = readers.read_artifacts(spark, artifacts_path)
    votes = readers.artifact_votes(artifacts)
    personas = readers.artifact_personas(artifacts)
    statements = readers.artifact_statements(artifacts)
    reports = run_reports(votes, personas, statements, measures, calls, spend.price_table(spark))
    writers.write_report(reports, f"{out}/reports")
    writers.write_report(run_segments(votes, personas, measures), f"{out}/segments")
    writers.write_report(sensitivity_report(reports), f"{out}/sensitivity")
    writers.write_report(summary_report(reports), f"{out}/summary")
    writers.write_report(multigroup_report(votes, measures, base_seed), f"{out}/multigroup")


def influence_artifacts(baseline: DataFrame, counterfactual: DataFrame, statements: DataFrame, out: str) -> None:
    """Speaker influence of every run, written like the other reports."""
    writers.write_report(influence_report(baseline, counterfactual, statements), out)
