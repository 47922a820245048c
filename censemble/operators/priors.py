"""Issue priors per survey cell, party distributions with backoff, and blending of surveys."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from censemble.functions import fixed

PRIOR_KEY = ["party_id", "education", "age_band"]
PARTY_KEY = ["age_band", "education", "race_eth"]
ISSUES = {
    "p_climate_action_support": "climate",
    "p_gun_restriction_support": "guns",
    "p_tax_on_rich_support": "taxes",
}
PRIOR_VALUES = [*ISSUES, "ideology_score"]
PARTY_VALUES = ["p_dem", "p_ind", "p_rep"]


def _ratio(top: Column, bottom: Column, empty: float) -> Column:
    """Quotient of integer totals, so the value does not depend on the order of addition."""
    return F.when(bottom > 0, top.cast("double") / bottom.cast("double")).otherwise(empty)


def issue_priors(recoded: DataFrame, k: int = fixed.K_ANONYMITY_MIN) -> DataFrame:
    """Support shares and mean ideology per (party, education, age); cells below k are dropped.

    Shares are over valid answers only, ``cell_n`` counts everyone in the cell.
    """
    shares = [
        _ratio(F.sum(answer), F.count(answer), 0.5).alias(name) for name, answer in ISSUES.items()
    ]
    scale = F.max("ideology_scale")
    ideology = _ratio(F.sum("ideology_units"), F.count("ideology_units") * scale, 0.0)
    return (
        recoded.groupBy(*PRIOR_KEY)
        .agg(*shares, ideology.alias("ideology_score"), F.count(F.lit(1)).alias("cell_n"))
        .where(F.col("cell_n") >= k)
    )


def _party_shares() -> list[Column]:
    return [
        (F.sum((F.col("party_id") == party).cast("int")).cast("double") / F.count(F.lit(1))).alias(name)
        for party, name in zip(fixed.PARTIES, PARTY_VALUES)
    ]


def party_distribution(recoded: DataFrame, min_n: int = fixed.PARTY_CELL_MIN) -> DataFrame:
    """P(party | age, education, race) for every race under each large enough (age, education).

    Race cells below ``min_n`` take the (age, education) shares but keep their own count. The
    survey is reduced once, to at most 4 x 5 x 6 x 3 counts; all else works on those.
    """
    counts = recoded.groupBy(*PARTY_KEY, "party_id").agg(F.count(F.lit(1)).alias("n"))

    def shares(keys: list[str], total: str, suffix: str) -> DataFrame:
        by_party = [
            F.sum(F.when(F.col("party_id") == party, F.col("n")).otherwise(0)) for party in fixed.PARTIES
        ]
        return counts.groupBy(*keys).agg(
            F.sum("n").alias(total),
            *[(top.cast("double") / F.sum("n")).alias(name + suffix)
              for top, name in zip(by_party, PARTY_VALUES)],
        )

    marginal = shares(["age_band", "education"], "marginal_n", "_m").where(F.col("marginal_n") >= min_n)
    # `counts` has at most 360 rows by its key domains, so both sides below are that small.
    by_race = shares(PARTY_KEY, "cell_n", "").where(F.col("race_eth").isNotNull())
    grid = marginal.withColumn("race_eth", F.explode(F.array(*[F.lit(r) for r in fixed.RACES])))
    joined = grid.join(F.broadcast(by_race), PARTY_KEY, "left")
    own = F.coalesce(F.col("cell_n"), F.lit(0)) >= min_n
    return joined.select(
        *PARTY_KEY,
        *[F.when(own, F.col(v)).otherwise(F.col(v + "_m")).alias(v) for v in PARTY_VALUES],
        F.coalesce(F.col("cell_n"), F.lit(0).cast("bigint")).alias("cell_n"),
    )


def stack_sources(sources: Mapping[str, DataFrame]) -> DataFrame:
    """Prior tables of several surveys as one table with a ``source`` column."""
    stacked = None
    for name, table in sources.items():
        tagged = table.select(F.lit(name).alias("source"), *PRIOR_KEY, *PRIOR_VALUES, "cell_n")
        stacked = tagged if stacked is None else stacked.unionByName(tagged)
    if stacked is None:
        raise ValueError("at least one prior source is needed")
    return stacked


def blend_priors(stacked: DataFrame, k: int = fixed.K_ANONYMITY_MIN) -> DataFrame:
    """Mean of the sources per cell, weighted by cell size; sources below k are skipped."""
    n = F.col("cell_n")
    return (
        stacked.where(n >= k)
        .groupBy(*PRIOR_KEY)
        .agg(
            *[(F.sum(F.col(v) * n) / F.sum(n)).alias(v) for v in PRIOR_VALUES],
            F.sum(n).alias("blend_n"),
        )
    )


def _domain_table(table: DataFrame, domains: dict[str, list[str]]) -> DataFrame:
    """Only rows with known key values, one per key: at most the product of the domains, so the
    result may be broadcast whatever the input was."""
    known = table
    for column, values in domains.items():
        known = known.where(F.col(column).isin(values))
    rest = [c for c in known.columns if c not in domains]
    one = known.groupBy(*domains).agg(F.max(F.struct(*rest)).alias("__row"))
    return F.broadcast(one.select(*domains, "__row.*"))


def with_priors(personas: DataFrame, blended: DataFrame) -> DataFrame:
    """Priors by (party, education, age): at most 60 lookup rows. Unknown cells read 0.5 / 0.0."""
    table = _domain_table(
        blended.select(*PRIOR_KEY, *PRIOR_VALUES),
        {"party_id": fixed.PARTIES, "education": fixed.EDUCATIONS, "age_band": fixed.AGE_BANDS},
    )
    filled = {
        v: F.coalesce(F.col(v), F.lit(0.0 if v == "ideology_score" else 0.5)) for v in PRIOR_VALUES
    }
    return personas.join(table, PRIOR_KEY, "left").withColumns(filled)


def usable_party_shares(party_dist: DataFrame, k: int = fixed.K_ANONYMITY_MIN) -> DataFrame:
    """Party shares of cells with at least k respondents: at most 100 rows, for broadcast."""
    return _domain_table(
        party_dist.where(F.col("cell_n") >= k).select(*PARTY_KEY, *PARTY_VALUES),
        {"age_band": fixed.AGE_BANDS, "education": fixed.EDUCATIONS, "race_eth": fixed.RACES},
    )


def with_party(
    people: DataFrame, party_dist: DataFrame, uniform: Column, k: int = fixed.K_ANONYMITY_MIN
) -> DataFrame:
    """Draw ``party_id`` from the cell's shares (at most 100 lookup rows).

    Missing cells and cells below k draw evenly, also where the cell carries backed-off shares.
    """
    table = usable_party_shares(party_dist, k)
    dem = F.coalesce(F.col("p_dem"), F.lit(1.0 / 3.0))
    dem_or_ind = F.coalesce(F.col("p_dem") + F.col("p_ind"), F.lit(2.0 / 3.0))
    return (
        people.join(table, PARTY_KEY, "left")
        .withColumn("__u", uniform)
        .withColumn(
            "party_id", F.when(F.col("__u") < dem, "dem").when(F.col("__u") < dem_or_ind, "ind").otherwise("rep")
        )
        .drop("__u", *PARTY_VALUES)
    )
