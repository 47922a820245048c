"""Block, split and slice tools against plain Python on skewed rows."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from censemble.operators.skew import (
    first_k,
    lookup_join,
    lowest_share,
    numbered_rows,
    positions,
    running_total,
    split_join,
)


@pytest.fixture(scope="module")
def skewed():
    """One key holds a third of the rows; seq has gaps."""
    rng = random.Random(3)
    rows = []
    for key, n in [("hot", 200), *[(f"k{i}", 20) for i in range(20)]]:
        for seq in sorted(rng.sample(range(n * 3), n)):
            rows.append((key, seq, rng.randrange(50)))
    rng.shuffle(rows)
    return rows


def _grouped(rows):
    by_key = defaultdict(list)
    for key, seq, value in sorted(rows):
        by_key[key].append((seq, value))
    return by_key


@pytest.mark.parametrize("bits", [1, 4, 20])
def test_running_total_matches_prefix_sums(spark, skewed, bits):
    df = spark.createDataFrame(skewed, "key string, seq long, value long")
    got = {(r.key, r.seq): r.total for r in running_total(df, ["key"], "seq", F.col("value"), "total", bits).collect()}
    for key, entries in _grouped(skewed).items():
        total = 0
        for seq, value in entries:
            total += value
            assert got[key, seq] == total
    assert len(got) == len(skewed)


@pytest.mark.parametrize("bits", [2, 20])
def test_positions_are_dense(spark, skewed, bits):
    df = spark.createDataFrame(skewed, "key string, seq long, value long")
    got = {(r.key, r.seq): r.at for r in positions(df, ["key"], "seq", "at", bits).collect()}
    for key, entries in _grouped(skewed).items():
        assert [got[key, seq] for seq, _ in entries] == list(range(len(entries)))


@pytest.mark.parametrize("block_rows", [1, 7, 100_000])
def test_lowest_share_by_text(spark, skewed, block_rows):
    """Repeated labels, labels of any length, ties of a whole key, and keys of a single row."""
    named = [(k, s % 3 if k == "hot" else 0, format(s * 7919 % 5000, "x") if s % 4 else "same", s) for k, s, _ in skewed]
    df = spark.createDataFrame(named, "key string, value long, id string, tie long")
    rows = lowest_share(df, ["key"], "value", "id", "tie", 3, "at", block_rows).collect()
    by_key = defaultdict(list)
    for r in rows:
        by_key[r.key].append((r["at"], r.value, r.id, r.tie))
    assert set(by_key) == {k for k, *_ in named}
    for key, entries in by_key.items():
        expected = sorted(r[1:] for r in named if r[0] == key)
        expected = expected[: max(1, len(expected) // 3)]
        assert sorted(entries) == [(i, *e) for i, e in enumerate(expected)]


def test_lowest_share_orders_bins_only(spark, skewed):
    """No range exchange, and no job while the plan is built."""
    df = spark.createDataFrame([(k, 0, str(s), s) for k, s, _ in skewed], "key string, value long, id string, tie long")
    spark.sparkContext.setJobGroup("lowest", "lowest")
    plan = lowest_share(df, ["key"], "value", "id", "tie", 3, "at")._jdf.queryExecution().executedPlan().toString()
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("lowest")
    spark.sparkContext.setJobGroup("", "")
    assert "rangepartitioning" not in plan


@pytest.mark.parametrize("how", ["inner", "left"])
def test_split_join_equals_plain_join(spark, skewed, how):
    facts = spark.createDataFrame(skewed, "key string, seq long, value long")
    lookup = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("k2", 4), ("none", 5)], "key string, w int")
    plain = Counter(map(tuple, facts.join(lookup, "key", how).select("key", "seq", "w").collect()))
    split = split_join(facts, lookup, ["key"], how, hot_rows=7).select("key", "seq", "w")
    assert Counter(map(tuple, split.collect())) == plain


def test_split_join_refuses_other_kinds(spark, skewed):
    facts = spark.createDataFrame(skewed, "key string, seq long, value long")
    with pytest.raises(ValueError):
        split_join(facts, facts, ["key"], "full")


def test_lookup_join_keeps_every_row_and_runs_no_job(spark, skewed):
    facts = spark.createDataFrame(skewed, "key string, seq long, value long")
    lookup = spark.createDataFrame([("hot", 1), ("k1", 3)], "key string, w int")
    spark.sparkContext.setJobGroup("lookup", "lookup")
    joined = lookup_join(facts, lookup, ["key"], "left")
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("lookup")
    spark.sparkContext.setJobGroup("", "")
    weights = {"hot": 1, "k1": 3}
    assert Counter(map(tuple, joined.select("key", "seq", "w").collect())) == Counter((k, n, weights.get(k)) for k, n, _ in skewed)
    with pytest.raises(ValueError):
        lookup_join(facts, lookup, ["key"], "full")


def test_first_k_matches_sort(spark, skewed):
    df = spark.createDataFrame(skewed, "key string, seq long, value long")
    got = defaultdict(list)
    for r in first_k(df, ["key"], [F.col("seq").desc()], 5).collect():
        got[r.key].append(r.seq)
    for key, entries in _grouped(skewed).items():
        assert sorted(got[key]) == sorted(s for s, _ in entries)[-5:]


def test_first_k_limits_before_the_shuffle(spark, skewed):
    df = spark.createDataFrame(skewed, "key string, seq long, value long")
    plan = first_k(df, ["key"], [F.col("seq").desc()], 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_numbered_rows(spark):
    df = spark.createDataFrame([("a", 7), ("b", 1), ("c", 0)], "key string, n long")
    rows = numbered_rows(df, "n", "no", ["key"], chunk=3).collect()
    assert sorted((r.key, r.no) for r in rows) == [*[("a", i) for i in range(7)], ("b", 0)]


def test_hot_keys_found_on_a_sample(spark):
    """From 2000 rows per piece on, hot keys are found on a hash sample of the rows."""
    facts = spark.range(24_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("key"), "id"
    )
    lookup = spark.range(500).select(F.concat(F.lit("k"), F.col("id")).alias("key"), F.col("id").alias("w")).unionByName(
        spark.createDataFrame([("hot", -1)], "key string, w long")
    )
    got = split_join(facts, lookup, ["key"], "inner", hot_rows=2000, spread_by=["id"])
    assert "__piece" in got._jdf.queryExecution().executedPlan().toString()
    sums = got.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.sum((F.col("key") == "hot").cast("int")).alias("hot")).first()
    assert (sums.n, sums.ids, sums.hot) == (24_000, 24_000, 8_000)
