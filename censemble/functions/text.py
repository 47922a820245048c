"""Prompt text, transcript lines, call-log fields and measure ids."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from censemble.functions import fixed


def two_digits(x: Column, signed: bool = False) -> Column:
    """A double in [-4, 4] with two digits, rounded half to even on its exact binary value.

    printf in Java rounds the printed digits instead, which differs at values such as 0.125.
    The value is scaled by 2**60 to an exact integer and rounded with integer arithmetic.
    """
    one = F.lit(1 << 60).cast("decimal(20,0)")
    hundredths = F.abs(x * float(1 << 60)).cast("bigint").cast("decimal(20,0)") * F.lit(100)
    whole = ((hundredths - hundredths % one) / one).cast("bigint")
    rest = (hundredths % one) * 2
    up = (rest > one) | ((rest == one) & (whole % 2 == 1))
    n = F.when(up, whole + 1).otherwise(whole)
    sign = F.when(x < 0, "-").otherwise("+" if signed else "")
    return F.concat(
        sign, F.floor(n / 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0")
    )


def backstory(demographics: Column, priors: Column) -> Column:
    """The persona backstory paragraph."""
    d, p = demographics, priors
    return F.format_string(
        fixed.BACKSTORY_FORMAT,
        d["age_band"], d["sex"], d["race_eth"], d["education"], d["income_band"], d["state"], d["puma"],
        p["party_id"], two_digits(p["ideology_score"], signed=True),
        two_digits(p["p_climate_action_support"]), two_digits(p["p_gun_restriction_support"]),
        two_digits(p["p_tax_on_rich_support"]),
    )


def bullets(items: Column) -> Column:
    """'- a\\n- b' from an array of text."""
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")


def fill_template(template: str, **fields: Column) -> Column:
    """Fill ``{name}`` places of a prompt template with columns; ``{{`` and ``}}`` are braces."""
    parts: list[Column] = []
    for literal in re.split(r"(\{\{|\}\}|\{\w+\})", template):
        if literal in ("{{", "}}"):
            parts.append(F.lit(literal[0]))
        elif re.fullmatch(r"\{\w+\}", literal):
            parts.append(F.coalesce(fields[literal[1:-1]].cast("string"), F.lit("")))
        elif literal:
            parts.append(F.lit(literal))
    return F.concat(*parts)


def transcript_line(speaker: Column, round_: Column, flagged: Column, text: Column) -> Column:
    return F.concat(
        F.lit("- "), speaker, F.lit(" (round "), round_.cast("string"), F.lit(")"),
        F.when(flagged, " [flagged]").otherwise(""), F.lit(": "), text,
    )


def token_estimate(text: Column) -> Column:
    """About four characters per token, at least one."""
    return F.greatest(F.lit(1).cast("bigint"), F.floor(F.char_length(text) / 4).cast("bigint"))


def retryable(status: Column) -> Column:
    """Rate limits, timeouts, server errors and calls without a status may be repeated."""
    return status.isNull() | status.isin(408, 429) | (status >= 500)


def suggested_delay(error: Column) -> Column:
    """Seconds the server asked to wait, null if it did not say."""
    digits = F.regexp_extract(error, r"seconds:\s*(\d+)", 1)
    return F.when(digits != "", digits.cast("double"))


def bare_measure_id(measure_id: Column) -> Column:
    """File-name form: every 'wa_' removed."""
    return F.replace(measure_id, F.lit("wa_"), F.lit(""))


def full_measure_id(measure_id: Column) -> Column:
    """Command form: 'wa_' in front unless already there."""
    return F.when(measure_id.startswith("wa_"), measure_id).otherwise(F.concat(F.lit("wa_"), measure_id))
