"""Joins, running totals and top-k that stay balanced when one key holds much of the data.

Nothing here drops or caps rows: hot keys are split over more tasks, and results equal those of
the plain join, window or sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Rows of one key that a single task may take in a join. There are at most rows / HOT_ROWS keys
# above it, so the list of hot keys is broadcast: Spark cannot know its size, and would shuffle all rows to join it.
HOT_ROWS = 1_000_000
# Positions per window partition in running totals, as a power of two.
BLOCK_BITS = 20
# Rows of a bin that are ordered in one task.
BLOCK_ROWS = 100_000


def split_join(
    facts: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
    spread_by: Sequence[str] | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Equi-join ``facts`` (many rows per key) to ``lookup`` (few rows per key).

    Keys with more than about ``hot_rows`` fact rows are cut into that many pieces by a hash of
    ``spread_by``; their lookup rows are repeated once per piece. Hot keys are found on a hash
    sample of the keys, or in ``counts`` (keys and ``__rows``) if the caller has them from an
    aggregate it needs anyway. They only decide how rows are dealt out: every row is joined. Keys
    must not be null for rows that should match.
    """
    if how not in ("inner", "left"):
        raise ValueError("split_join keeps fact rows apart, so only inner and left joins are safe")
    keys = list(keys)
    spread = [F.col(c) for c in (spread_by or facts.columns)]
    if counts is None:
        # A hot key still has a thousand rows in the sample.
        rate = max(1, min(256, hot_rows // 1000))
        sampled = facts.where(F.pmod(F.xxhash64(*spread, F.lit(rate)), F.lit(rate)) == 0) if rate > 1 else facts
        counts = sampled.groupBy(*keys).agg((F.count(F.lit(1)) * rate).alias("__rows"))
    hot = F.broadcast(counts.where(F.col("__rows") > hot_rows).select(
        *keys, F.ceil(F.col("__rows") / hot_rows).cast("int").alias("__pieces")
    ))
    pieces = F.coalesce(F.col("__pieces"), F.lit(1))
    left = (
        facts.join(hot, keys, "left")
        .withColumn("__piece", F.pmod(F.xxhash64(*spread), pieces).cast("int"))
        .drop("__pieces")
    )
    right = (
        lookup.join(hot, keys, "left")
        .withColumn("__piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
        .drop("__pieces")
    )
    return left.join(right, [*keys, "__piece"], how).drop("__piece")


def lookup_join(facts: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join to a table with one row per key.

    A plain equi-join: Spark broadcasts the table while its size allows, and beyond that splits
    the partitions of hot keys at run time, which is safe as a key meets one row only.
    """
    if how not in ("inner", "left"):
        raise ValueError("only inner and left joins to a lookup table")
    return facts.join(lookup, list(keys), how)


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    seq: str,
    value: Column,
    out: str,
    block_bits: int = BLOCK_BITS,
) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over rows of the same keys with ``seq`` up to this row.

    ``seq`` is a non-negative integer, unique within the keys. Rows are windowed in blocks of
    2**block_bits positions; earlier blocks come in as one offset per block. A key may hold any
    share of the rows: no window sees more than a block, and the block offsets of one key number
    at most max(seq) / 2**block_bits (about a million for 10**12 positions).
    """
    keys = list(keys)
    rows = df.withColumn("__value", value).withColumn("__block", F.shiftright(F.col(seq), block_bits))
    blocks = rows.groupBy(*keys, "__block").agg(F.sum("__value").alias("__sum"))
    earlier = W.partitionBy(*keys).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    offsets = blocks.select(*keys, "__block", F.sum("__sum").over(earlier).alias("__offset"))
    within = W.partitionBy(*keys, "__block").orderBy(seq).rowsBetween(W.unboundedPreceding, 0)
    total = F.sum("__value").over(within)
    return (
        rows.join(offsets, [*keys, "__block"])
        .withColumn(out, F.when(F.col("__offset").isNull(), total).otherwise(total + F.col("__offset")))
        .drop("__value", "__block", "__offset")
    )


def positions(
    df: DataFrame, keys: Sequence[str], seq: str, out: str, block_bits: int = BLOCK_BITS
) -> DataFrame:
    """Adds ``out``: the 0-based place of the row by ``seq`` within its keys."""
    ranked = running_total(df, keys, seq, F.lit(1).cast("bigint"), out, block_bits)
    return ranked.withColumn(out, F.col(out) - 1)


def lowest_share(
    df: DataFrame, keys: Sequence[str], value: str, label: str, tie: str, share: int, out: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The first rows per key by (``value``, ``label``, ``tie``): one in ``share``, one at least.

    Adds ``out``: the 0-based place. Nothing is sorted as a whole and nothing stored: a histogram of
    ``value`` (few different whole numbers per key) tells which values are in, in part or not at
    all. Rows of one value are cut into bins by the first characters of ``label``, as many as leave
    about ``block_rows`` in a bin if labels are spread over sixteen digits (ids made of digests; others
    give uneven bins and the same result). A histogram of the bins gives each its first place and
    leaves out those beyond the share; rows are ordered inside their bin alone.
    """
    keys = list(keys)
    group = [*keys, value]
    counts = df.groupBy(*group).agg(F.count(F.lit(1)).alias("__rows"))
    over = W.partitionBy(*keys)
    before = over.orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    quota = F.greatest(F.lit(1).cast("bigint"), F.floor(F.sum("__rows").over(over) / share))
    digits = F.when(F.col("__rows") <= block_rows, 0).otherwise(F.ceil(F.log(16.0, F.col("__rows") / block_rows)))
    values = counts.select(
        *group, "__rows", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"), quota.alias("__quota"),
        digits.cast("int").alias("__digits"),
    ).where(F.col("__before") < F.col("__quota"))
    rows = split_join(df, values.drop("__rows"), group, "inner", spread_by=[label, tie], counts=counts)
    rows = rows.withColumn("__bin", F.substring(F.col(label), F.lit(1), F.col("__digits")))
    bins = rows.groupBy(*group, "__bin").agg(F.count(F.lit(1)).alias("__n"), F.first("__before").alias("__b"), F.first("__quota").alias("__q"))
    ahead = W.partitionBy(*group).orderBy("__bin").rowsBetween(W.unboundedPreceding, -1)
    bins = bins.withColumn("__first", F.col("__b") + F.coalesce(F.sum("__n").over(ahead), F.lit(0))).where(F.col("__first") < F.col("__q"))
    placed = rows.join(bins.select(*group, "__bin", "__first"), [*group, "__bin"])
    inside = W.partitionBy(*group, "__bin").orderBy(label, tie)
    placed = placed.withColumn(out, F.col("__first") + F.row_number().over(inside) - 1)
    return placed.where(F.col(out) < F.col("__quota")).select(*df.columns, out)


def first_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows per key in ``order`` (``k`` a small constant, at most 1000).

    Spark limits each group before the shuffle as well, so a hot key brings at most k rows per
    map task to the one task that ranks it.
    """
    if k > 1000:
        raise ValueError("above 1000 Spark no longer limits groups before the shuffle")
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rn", rank).where(F.col("__rn") <= k).drop("__rn")


def dealt_out(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows hashed by ``keys`` over all shuffle partitions.

    For rows that are few and small now but grow in the next step: the number is explicit, so
    adaptive execution does not merge them into one task by their present size.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *[F.col(c) for c in keys])


def numbered_rows(df: DataFrame, n: str, out: str, keys: Sequence[str], chunk: int = 100_000) -> DataFrame:
    """Repeat each row ``n`` times, numbered 0..n-1 in ``out``.

    Numbers are made chunk by chunk after a shuffle on (keys, chunk), so one very large row does
    not become one task.
    """
    chunks = df.where(F.col(n) > 0).withColumn(
        "__chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col(n) / chunk) - 1))
    )
    low = F.col("__chunk") * chunk
    high = F.least(low + chunk, F.col(n).cast("bigint")) - 1
    return (
        dealt_out(chunks, [*keys, "__chunk"])
        .withColumn(out, F.explode(F.sequence(low, high)))
        .drop("__chunk")
    )
