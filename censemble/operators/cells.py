"""Weighted demographic cells and the k-anonymous sampling pool."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from censemble.functions import fixed
from censemble.functions.recode import SKELETON


def weighted_cells(recoded: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per skeleton, and per value of the columns ``by``: summed person weight and the number of records that carry one.

    One hash aggregate; partial sums are merged on the map side, so a hot cell costs one row per
    task in the shuffle.
    """
    return recoded.groupBy(*by, *SKELETON).agg(
        F.coalesce(F.sum(F.col("PWGTP").cast("bigint")), F.lit(0).cast("bigint")).alias("person_weight"),
        F.count("PWGTP").alias("record_count"),
    )


def merged_cells(parts: DataFrame) -> DataFrame:
    """The cells of all records, from cells of parts of them: both numbers are sums."""
    return parts.groupBy(*SKELETON).agg(
        F.sum("person_weight").alias("person_weight"), F.sum("record_count").alias("record_count")
    )


def is_national(scope: str) -> bool:
    return scope.upper() in fixed.NATIONAL_SCOPES


def k_anonymous(cells: DataFrame, scope: str = "US", k: int = fixed.K_ANONYMITY_MIN) -> DataFrame:
    """Cells that may be sampled, in one state or nationally. Thin cells are left out, so their
    weight falls to the others in proportion. On a table partitioned by state, a state scope
    reads one partition."""
    pool = cells.where(F.col("record_count") >= k)
    return pool if is_national(scope) else pool.where(F.col("state") == scope)


def require_pool(pool: DataFrame, scope: str) -> DataFrame:
    """The pool itself; an empty one is an error."""
    if pool.isEmpty():
        raise RuntimeError(f"no cells with enough records in scope {scope!r}; load microdata first")
    return pool
