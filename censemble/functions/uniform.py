"""Hash-derived randomness.

A draw depends only on its seed and labels, never on partitioning, task order or retries, so a
lost executor recomputes the same numbers. md5 is used because every engine has it, which keeps
draws checkable elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digest(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"))


def _hex_to_long(text: Column) -> Column:
    return F.conv(text, 16, 10).cast("bigint")


def hash_draw(*parts: Column) -> Column:
    """Uniform integer in [0, 2**60) from the labels."""
    return _hex_to_long(F.substring(_digest(*parts), 1, 15))


def unit_draw(*parts: Column) -> Column:
    """Uniform double in [0, 1) with 52 random bits."""
    return _hex_to_long(F.substring(_digest(*parts), 1, 13)).cast("double") / float(1 << 52)
