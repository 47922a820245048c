"""Call-log spend: prices, totals, caps, retries and model stamps.

Money is decimal throughout: sums do not depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from censemble.functions import fixed
from censemble.functions.text import retryable, suggested_delay
from censemble.operators.skew import BLOCK_BITS, lookup_join, running_total

USD = "decimal(38,12)"


def price_table(spark: SparkSession, prices: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """model, input, output: USD per million tokens."""
    rows = ", ".join(
        f"('{m}', CAST('{i}' AS DECIMAL(12,6)), CAST('{o}' AS DECIMAL(12,6)))"
        for m, (i, o) in (prices or fixed.PRICES).items()
    )
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(model, input, output)")


def priced_calls(calls: DataFrame, prices: DataFrame, strict: bool = True) -> DataFrame:
    """Adds ``usd`` to every call. A model without a price is an error when the rows are worked
    out; with ``strict`` off its calls stay, with a null ``usd`` (see ``unknown_models``)."""
    per_token = F.lit(Decimal("0.000001"))
    tokens = [F.col(c).cast("decimal(18,0)") for c in ("in_tok", "out_tok")]
    usd = ((tokens[0] * F.col("__input") + tokens[1] * F.col("__output")) * per_token).cast(USD)
    if strict:
        told = F.concat(F.lit("model without a price: "), F.coalesce("model", F.lit("(none)")))
        usd = F.when(F.col("__input").isNull(), F.raise_error(told).cast(USD)).otherwise(usd)
    listed = prices.select("model", F.col("input").alias("__input"), F.col("output").alias("__output"))
    return lookup_join(calls, listed, ["model"], "left").withColumn("usd", usd).drop("__input", "__output")


def unknown_models(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Models that were called but have no price, with their number of calls."""
    used = calls.groupBy("model").agg(F.count(F.lit(1)).alias("calls"))
    return used.join(prices.select("model"), "model", "left_anti")


def require_priced(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """The calls themselves; a model without a price is an error. One name comes to the driver."""
    missing = unknown_models(calls, prices).agg(F.count(F.lit(1)).alias("n"), F.min("model").alias("first")).first()
    if missing["n"]:
        raise ValueError(f"{missing['n']} models without a price, the first is {missing['first']!r}")
    return calls


def spend_by_model(priced: DataFrame, run: str = "run_id") -> DataFrame:
    """Calls, tokens and USD per run and model, with a total row per run and one overall.

    ``unpriced_calls`` counts the calls that ``usd`` lacks; null ``usd``: no call has a price.
    """
    return priced.rollup(run, "model").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum(F.col("in_tok").cast("bigint")).alias("in_tok"),
        F.sum(F.col("out_tok").cast("bigint")).alias("out_tok"),
        F.sum("usd").cast(USD).alias("usd"),
        F.count_if(F.col("usd").isNull()).alias("unpriced_calls"),
        F.grouping_id().cast("int").alias("level"),
    )


def budget_use(
    priced: DataFrame, run: Sequence[str], cap_usd: str = fixed.RUN_CAP_USD, block_bits: int = BLOCK_BITS
) -> DataFrame:
    """Running spend per run in call order. A call is charged, then the run stops if the total is
    above the cap: ``breach`` marks that call, ``allowed`` the calls up to and including it.
    Calls without a price add nothing and are marked ``unpriced``."""
    cap = F.lit(Decimal(cap_usd))
    charge = F.coalesce("usd", F.lit(0).cast(USD))
    running = running_total(priced, run, "seq", charge, "running_usd", block_bits)
    before = F.col("running_usd") - charge
    return running.withColumn("running_usd", F.col("running_usd").cast(USD)).withColumns(
        {
            "allowed": before <= cap,
            "breach": (F.col("running_usd") > cap) & (before <= cap),
            "unpriced": F.col("usd").isNull(),
        }
    )


def classify_failures(calls: DataFrame) -> DataFrame:
    """Adds ``retryable`` and the server-suggested ``delay_s``."""
    return calls.withColumns(
        {"retryable": retryable(F.col("status")), "delay_s": suggested_delay(F.col("error"))}
    )


def model_stamp(calls: DataFrame, run: Sequence[str], provider: str) -> DataFrame:
    """Per run 'provider:a+b' from the sorted distinct models."""
    used = calls.select(*run, "model").distinct()
    # Distinct models only: a run has a handful.
    return used.groupBy(*run).agg(
        F.concat(F.lit(f"{provider}:"), F.array_join(F.array_sort(F.collect_set("model")), "+")).alias("stamp")
    )
