"""Prior-knowledge flags and run grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from censemble.functions.parsing import parse_probes


def recall_error(knows: Column, recalled: Column, actual: Column) -> Column:
    """Distance of the recalled share from the certified one, null if none was recalled."""
    return F.when(knows, F.abs(recalled - actual))


def contamination_flag(error: Column) -> Column:
    return (
        F.when(error.isNull(), "NONE")
        .when(error <= 5, "HIGH")
        .when(error <= 15, "MODERATE")
        .otherwise("LOW")
    )


def contamination(probes: DataFrame) -> DataFrame:
    """Parsed probe responses with error and flag; input has response and actual_yes_pct."""
    parsed = parse_probes(probes, "response")
    error = recall_error(F.col("knows"), F.col("yes_pct"), F.col("actual_yes_pct"))
    return parsed.withColumn("recall_error", error).withColumn("flag", contamination_flag(F.col("recall_error")))


def run_grid(measures: DataFrame, seeds: Sequence[int], n_groups: int = 1) -> DataFrame:
    """One row per measure, base seed and group; a group runs on its seed plus its number."""
    return (
        measures.select("measure_id")
        .withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
        .withColumn("group_id", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
        .withColumn("run_seed", F.col("seed") + F.col("group_id"))
    )
