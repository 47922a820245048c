"""Record checks: domains and ranges, as reasons per row, without dropping anything."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from censemble.functions import fixed

PERSONA_DOMAINS = {
    "age_band": fixed.AGE_BANDS,
    "sex": fixed.SEXES,
    "race_eth": fixed.RACES,
    "education": fixed.EDUCATIONS,
    "income_band": fixed.INCOME_BANDS,
    "party_id": fixed.PARTIES,
}
PERSONA_RANGES = {
    "p_climate_action_support": (0.0, 1.0),
    "p_gun_restriction_support": (0.0, 1.0),
    "p_tax_on_rich_support": (0.0, 1.0),
    "ideology_score": (-1.0, 1.0),
}
PERSONA_REQUIRED = ["puma", "state"]
# Places in a run are from 0 to below this.
MAX_SEQ = 1 << 40
VOTE_RANGES = {"stance": (0.0, 1.0), "confidence": (0.0, 1.0)}
VOTE_REQUIRED = ["persona_id", "round", "rationale"]


def _broken(valid: Column, name: str) -> Column:
    return F.when(~F.coalesce(valid, F.lit(False)), name)


def check_rows(
    df: DataFrame,
    domains: dict[str, list[str]] | None = None,
    ranges: dict[str, tuple[float, float]] | None = None,
    required: list[str] | None = None,
) -> DataFrame:
    """Adds ``reasons``, the names of the columns that are missing, unknown or out of range."""
    checks = [_broken(F.col(c).isin(values), c) for c, values in (domains or {}).items()]
    checks += [
        _broken((F.col(c) >= low) & (F.col(c) <= high), c) for c, (low, high) in (ranges or {}).items()
    ]
    checks += [_broken(F.col(c).isNotNull(), c) for c in (required or [])]
    return df.withColumn("reasons", F.filter(F.array(*checks), lambda r: r.isNotNull()))


def check_personas(flat: DataFrame) -> DataFrame:
    return check_rows(flat, PERSONA_DOMAINS, PERSONA_RANGES, PERSONA_REQUIRED)


def check_votes(votes: DataFrame) -> DataFrame:
    return check_rows(votes, ranges=VOTE_RANGES, required=VOTE_REQUIRED)


def check_places(rows: DataFrame, run: Sequence[str], seq: str = "seq") -> DataFrame:
    """Rows whose place in their run breaks the contract of running totals, places and artifacts:
    missing, out of range, or taken more than once. One row per run and place, with its count."""
    counted = rows.groupBy(*run, seq).agg(F.count(F.lit(1)).alias("n"))
    good = F.coalesce((F.col(seq) >= 0) & (F.col(seq) < MAX_SEQ), F.lit(False))
    reasons = F.array(F.when(~good, "range"), F.when(F.col("n") > 1, "repeated"))
    checked = counted.withColumn("reasons", F.filter(reasons, lambda r: r.isNotNull()))
    return checked.where(F.size("reasons") > 0)


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with their reasons)."""
    clean = F.size("reasons") == 0
    return checked.where(clean).drop("reasons"), checked.where(~clean)
