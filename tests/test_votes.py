import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from censemble.functions.digests import numbered_digests
from censemble.functions.exact import exact_mean, exact_sum
from censemble.operators import votes as vot
from censemble.operators.bootstrap import PLACE_BITS, _dealt, _replicate_sums, bootstrap_interval, rank_bounds

VOTES = "run string, persona_id string, seq long, phase string, stance double"
AXES = "run string, persona_id string, party_id string, age_band string, education string, race_eth string"


def make(spark, rows):
    """(persona, phase, stance) or (persona, phase, stance, run) rows; seq is their order."""
    full = [((r[3] if len(r) > 3 else "r"), r[0], i, r[1], float(r[2])) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, VOTES)


def test_yes_share_threshold_is_strict(spark):
    votes = make(spark, [(f"p{i}", "post", 0.8 if i < 7 else 0.2) for i in range(10)])
    assert vot.yes_shares(votes, ["run"]).first().yes_pct == 70.0
    half = vot.yes_shares(make(spark, [(f"p{i}", "post", 0.5) for i in range(4)]), ["run"]).first()
    assert half.yes_pct == 0.0 and half.weighted_pct == 50.0 and half.n_votes == 4


def test_run_without_post_votes_reads_fifty(spark):
    votes = make(spark, [("a", "pre", 0.9)])
    share = vot.yes_shares(votes, ["run"]).first()
    assert (share.n_votes, share.yes_pct, share.weighted_pct) == (0, 50.0, 50.0)
    change = vot.opinion_change(votes, ["run"]).first()
    assert (change.mean_abs_delta, change.flip_rate, change.n) == (0.0, 0.0, 0)
    ci = bootstrap_interval(votes, ["run"], F.lit(1)).first()
    assert (ci.ci_low, ci.ci_high) == (50.0, 50.0)


def test_phase_by_round(spark):
    votes = spark.createDataFrame([("m", r) for r in range(0, 8)], "measure_id string, round int")
    measures = spark.createDataFrame([("m", 5)], "measure_id string, n_rounds int")
    got = {r.round: r.phase for r in vot.with_phase(votes, measures).collect()}
    assert got == {0: "pre", 6: "post", **{r: "middle" for r in (1, 2, 3, 4, 5, 7)}}
    middle = vot.with_phase(votes.where("round = 3"), measures).selectExpr("*", "'r' run", "0.5 stance", "1 seq", "'p' persona_id")
    assert vot.yes_shares(middle, ["run"]).first().yes_pct == 50.0
    assert vot.opinion_change(middle, ["run"]).first().n == 0


def test_unknown_measures_are_errors(spark):
    votes = spark.createDataFrame([("m", 6, 0.5), ("who", 6, 0.5)], "measure_id string, round int, stance double")
    measures = spark.createDataFrame([("m", 5)], "measure_id string, n_rounds int")
    with pytest.raises(Exception, match="unknown measure: who"):
        vot.yes_shares(vot.with_phase(votes, measures), ["measure_id"]).collect()
    with pytest.raises(Exception, match="unknown measure: c"):
        scored(spark, [("a", 1.0, 1.0), ("c", 1.0, 1.0)]).collect()


def test_flips(spark):
    change = vot.opinion_change(make(spark, [("a", "pre", 0.8), ("b", "pre", 0.2), ("a", "post", 0.4), ("b", "post", 0.7)]), ["run"]).first()
    assert change.n == 2 and change.flip_rate == 1.0 and change.mean_abs_delta == pytest.approx(0.45)


@pytest.mark.parametrize("hot_rows", [1_000_000, 5])
def test_last_pre_counts_and_all_post_are_kept(spark, hot_rows):
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "a", "b", "c"]), rng.choice(["pre", "post"]), rng.random()) for _ in range(300)]
    rows += [("only_post", "post", 0.9)]
    pre = {p: s for p, phase, s in rows if phase == "pre"}
    deltas = [(s - pre[p], (s > 0.5) != (pre[p] > 0.5)) for p, phase, s in rows if phase == "post" and p in pre]
    got = vot.opinion_change(make(spark, rows), ["run"], hot_rows).first()
    assert got.n == len(deltas)
    assert got.mean_abs_delta == pytest.approx(sum(abs(d) for d, _ in deltas) / len(deltas))
    assert got.flip_rate == pytest.approx(sum(f for _, f in deltas) / len(deltas))


def axes(spark, people):
    return spark.createDataFrame([("r", p, party, "30-44", "hs", "white_nh") for p, party in people], AXES)


def test_small_segments_are_suppressed(spark):
    people = [(f"d{i}", "dem") for i in range(6)] + [(f"r{i}", "rep") for i in range(2)] + [("absent", "ind")]
    votes = make(spark, [(p, "pre", 0.4) for p, _ in people[:-1]] + [(p, "post", 0.6) for p, _ in people[:-1]])
    seg = {(r.axis, r.value): r for r in vot.segment_breakdown(votes, axes(spark, people), ["run"]).collect()}
    dem, rep, ind = (seg["party_id", p] for p in ("dem", "rep", "ind"))
    assert dem.n == 6 and not dem.suppressed and dem.pred_yes_pct == pytest.approx(60.0) and dem.mean_abs_delta == pytest.approx(0.2)
    assert rep.n == 2 and rep.suppressed and rep.pred_yes_pct is None and rep.mean_abs_delta is None
    assert ind.n == 0 and ind.suppressed
    assert seg["age_band", "30-44"].n == 8


def test_repeated_id_counts_in_both_segments_once(spark):
    people = [("twin", "dem"), ("twin", "dem"), ("twin", "rep")] + [(f"d{i}", "dem") for i in range(5)]
    votes = make(spark, [("twin", "post", 0.7), ("twin", "post", 0.9)] + [(f"d{i}", "post", 0.5) for i in range(5)])
    seg = {(r.axis, r.value): r.n for r in vot.segment_breakdown(votes, axes(spark, people), ["run"], axes=["party_id"]).collect()}
    assert seg == {("party_id", "dem"): 7, ("party_id", "rep"): 2}


def test_segment_without_pre_votes_reads_zero_change(spark):
    votes = make(spark, [(f"d{i}", "post", 0.5) for i in range(5)])
    seg = vot.segment_breakdown(votes, axes(spark, [(f"d{i}", "dem") for i in range(5)]), ["run"], axes=["party_id"]).first()
    assert seg.mean_abs_delta == 0.0


@pytest.mark.parametrize("seed", range(4))
def test_no_small_segment_follows_from_the_others(spark, seed):
    """Subtract what is shown from the pooled result, on every axis: what is left is never a segment below five votes."""
    rng = random.Random(seed)
    people = [f"p{i}" for i in range(60)]
    sizes = {"party_id": [3, 20, 37], "age_band": [2, 2, 6, 50], "education": [1, 1, 2, 56], "race_eth": [30, 30]}
    values = {a: [f"{a}{k}" for k, n in enumerate(ns) for _ in range(n)] for a, ns in sizes.items()}
    for v in values.values():
        rng.shuffle(v)
    member = [("r", p, *(values[a][i] for a in vot.AXES)) for i, p in enumerate(people)]
    votes = make(spark, [(p, "post", rng.random()) for p in people])
    plain = vot.segment_breakdown(votes, spark.createDataFrame(member, AXES), ["run"])
    told = vot.protect_segments(plain, ["run"]).collect()
    pooled = vot.yes_shares(votes, ["run"]).first()
    truth = {(r.axis, r.value): r for r in plain.collect()}
    for axis in vot.AXES:
        hidden = [r for r in told if r.axis == axis and r.withheld]
        shown = [r for r in told if r.axis == axis and not r.withheld]
        assert all(r.pred_yes_pct is None and r.mean_abs_delta is None for r in hidden)
        assert all(r.pred_yes_pct == truth[axis, r.value].pred_yes_pct for r in shown)
        assert sorted(r.n for r in hidden if r.withheld == "small") == sorted(n for n in sizes[axis] if n < 5)
        rest = pooled.n_votes - sum(r.n for r in shown)
        assert rest == sum(r.n for r in hidden)
        # The rest is a mixture of two values or more and of five votes or more, or there is none.
        assert not hidden or (len(hidden) >= 2 and rest >= 5)
    assert {r.axis for r in told if r.withheld == "complement"} == {"party_id", "age_band", "education"}


def test_sums_are_the_same_bits_on_any_partitioning(spark):
    """Without rounding, for stances that doubles cannot hold exactly, in any order of rows."""
    rng = random.Random(9)
    people = [f"p{i}" for i in range(40)]
    rows = [(rng.choice(people), rng.choice(["pre", "post"]), rng.random() ** 5, rng.choice("xy")) for _ in range(1500)]
    member = [(run, p, *(rng.choice("ab") for _ in vot.AXES)) for run in "xy" for p in people]
    votes, personas = make(spark, rows), spark.createDataFrame(member, AXES)
    found = []
    for partitions in (1, 4, 64):
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        dealt = votes.repartition(partitions, F.xxhash64("seq", F.lit(partitions)))
        results = [
            vot.yes_shares(dealt, ["run"]), vot.opinion_change(dealt, ["run"]), vot.segment_breakdown(dealt, personas, ["run"]),
            bootstrap_interval(dealt, ["run"], F.lit(3), 60, place_bits=8),
        ]
        found.append([sorted(map(repr, r.collect())) for r in results])
    assert found[0] == found[1] == found[2]
    exact = {run: 100 * math.fsum(r[2] for r in rows if r[1] == "post" and r[3] == run) / sum(r[1] == "post" and r[3] == run for r in rows) for run in "xy"}
    assert {r.run: r.weighted_pct for r in vot.yes_shares(votes, ["run"]).collect()} == pytest.approx(exact, abs=1e-12)


def test_exact_sums_of_odd_values(spark):
    df = spark.createDataFrame([("n", None), ("e", 0.1), ("e", 0.2), ("e", None), ("m", -0.75), ("m", 0.5), ("x", 1.0), ("x", float("nan")), ("i", float("inf"))], "k string, v double")
    got = {r.k: (r.s, r.m) for r in df.groupBy("k").agg(exact_sum(F.col("v")).alias("s"), exact_mean(F.col("v")).alias("m")).collect()}
    assert got["n"] == (None, None) and got["e"][0] == pytest.approx(0.3, abs=1e-15) and got["m"] == (-0.25, -0.125)
    assert all(math.isnan(x) for k in "xi" for x in got[k])


def test_uncertified_segments_are_listed(spark):
    schema = "run string, axis string, value string, n long, suppressed boolean, pred_yes_pct double"
    segments = spark.createDataFrame([("r", "a", "x", 9, False, 1.0), ("r", "a", "y", 8, False, 1.0), ("r", "a", "z", 2, True, None)], schema)
    certified = spark.createDataFrame([("r", "a", "x", 3.0), ("r", "a", "y", None)], "run string, axis string, value string, certified_yes_pct double")
    assert [(r.value, r.n) for r in vot.uncertified_segments(segments, certified, ["run"]).collect()] == [("y", 8)]


def scored(spark, rows):
    predicted = spark.createDataFrame(rows, "measure_id string, yes_pct double, weighted_pct double")
    truth = spark.createDataFrame([("a", 50.0, False), ("b", 60.0, True)], "measure_id string, yes_pct double, passed boolean")
    return vot.score_runs(predicted, truth)


def test_errors_and_brier(spark):
    got = {r.measure_id: r for r in scored(spark, [("a", 0.0, 0.0), ("b", 100.0, 100.0)]).collect()}
    assert got["a"].brier == 0.0 and got["b"].brier == 0.0 and got["a"].mae_weighted == 50.0 and got["b"].mae_threshold == 40.0
    assert scored(spark, [("b", 0.0, 0.0)]).first().brier == 1.0


def test_sensitivity_spread(spark):
    got = {r.measure_id: r for r in vot.sensitivity(scored(spark, [("a", 1.0, 40.0), ("a", 1.0, 44.0), ("b", 1.0, 70.0)])).collect()}
    sd = 8 ** 0.5
    assert got["a"].mean_predicted == 42.0 and got["a"].sd_predicted == pytest.approx(sd)
    assert got["a"].ci_low == pytest.approx(42 - 1.96 * sd) and got["a"].spread == 4.0
    assert got["b"].sd_predicted == 0.0 and got["b"].ci_low == got["b"].ci_high == 70.0


def test_multigroup_pools_all_votes(spark):
    votes = spark.createDataFrame(
        [("a", g, f"p{g}-{i}", g * 10 + i, phase, s + g / 10) for g in range(3) for i in range(6) for phase, s in (("pre", 0.2), ("post", 0.4))],
        "measure_id string, group_id int, persona_id string, seq long, phase string, stance double",
    )
    truth = spark.createDataFrame([("a", 55.0, True)], "measure_id string, yes_pct double, passed boolean")
    got = vot.multigroup(votes, truth).first()
    assert got.n_groups == 3 and got.n_votes == 18 and got.pooled_predicted == pytest.approx(50.0)
    assert got.mean_predicted == pytest.approx(50.0) and got.sd_predicted == pytest.approx(10.0)
    assert got.mae_weighted == pytest.approx(5.0) and got.n_matched == 18


def test_summary_has_a_total_row(spark):
    runs = scored(spark, [("a", 50.0, 40.0), ("b", 70.0, 80.0)]).withColumns({"n_personas": F.lit(12), "seed": F.lit(1)})
    runs = runs.unionByName(runs.where("measure_id = 'a'").withColumn("seed", F.lit(2)))
    costs = spark.createDataFrame([("a", 1, 1.5), ("a", 2, 3.0)], "measure_id string, seed int, cost_usd double")
    got = {r.measure_id: r for r in vot.backtest_summary(runs, costs, ["measure_id", "seed"]).collect()}
    assert got["a"].cost_usd == 4.5 and got["b"].cost_usd == 0.0 and got["a"].n_runs == 2 and got["a"].level == 0
    assert got[None].mae == pytest.approx(40 / 3) and got[None].cost_usd == 4.5 and got[None].level == 1


def test_divergence_counts_models_not_runs(spark):
    rows = [("a", "x", 10.0), ("a", "x", 30.0), ("a", "y", 25.0)]
    got = vot.model_divergence(spark.createDataFrame(rows, "measure_id string, model string, weighted_pct double")).first()
    assert (got.n_models, got.min_predicted, got.max_predicted, got.lowest_model) == (2, 20.0, 25.0, "x")


def brute_interval(stances, seed, replicates):
    n, shares = len(stances), []
    for rep in range(replicates):
        total = 0.0
        for i in range(n):
            total += stances[half_of(f"{seed}:{rep}:0:{i // 2}", i % 2) % n]
        shares.append(100.0 * total / n)
    shares.sort()
    low, high = rank_bounds(replicates, 0.05)
    return shares[low], shares[high]


def half_of(text, second):
    digest = hashlib.md5(text.encode()).hexdigest()
    return int(digest[16:31] if second else digest[:15], 16)


def brute_blocks(stances, seed, replicates, size):
    """Draws fall into blocks of places; each block draws that many from itself."""
    n, shares = len(stances), []
    for rep in range(replicates):
        if n <= size:
            counts = {0: n}
        else:
            counts = Counter(half_of(f"{seed}:{rep}:block:{i // 2}", i % 2) % n // size for i in range(n))
        assert sum(counts.values()) == n
        total = 0.0
        for block, draws in counts.items():
            own = stances[block * size : (block + 1) * size]
            total += sum(own[half_of(f"{seed}:{rep}:{block}:{j // 2}", j % 2) % len(own)] for j in range(draws))
        shares.append(100.0 * total / n)
    shares.sort()
    low, high = rank_bounds(replicates, 0.05)
    return shares[low], shares[high]


@pytest.mark.parametrize("place_bits", [16, 2, 0])
def test_bootstrap_matches_brute_force_for_any_block(spark, place_bits):
    rng = random.Random(2)
    runs = {"a": [rng.random() for _ in range(9)], "b": [rng.random() for _ in range(4)], "one": [0.3]}
    rows = [(f"p{i}", "post", s, run) for run, stances in runs.items() for i, s in enumerate(stances)]
    got = {r.run: r for r in bootstrap_interval(make(spark, rows), ["run"], F.lit(7), 200, place_bits=place_bits).collect()}
    for run, stances in runs.items():
        low, high = brute_blocks(stances, 7, 200, 1 << place_bits)
        if place_bits == 16:
            assert (low, high) == pytest.approx(brute_interval(stances, 7, 200))
        assert got[run].ci_low == pytest.approx(low) and got[run].ci_high == pytest.approx(high)
        assert 0 <= low <= 100 * sum(stances) / len(stances) <= high <= 100
    assert got["one"].ci_low == got["one"].ci_high == pytest.approx(30.0)


@pytest.mark.parametrize("place_bits", [16, 3])
def test_bootstrap_of_sparse_numbers_and_any_stances(spark, place_bits):
    """Slices of numbers that end inside blocks, stances above one and below zero, and missing ones, against the draws themselves."""
    rng = random.Random(8)
    runs = {"small": [rng.random() for _ in range(90)], "large": [rng.uniform(-900, 900) for _ in range(61)], "gaps": [rng.random() for _ in range(40)]}
    runs["gaps"][::4] = [None] * 10
    rows = [(run, 7, (i * 131) ** 2, s) for run, stances in runs.items() for i, s in enumerate(stances)]
    votes = spark.createDataFrame(rows, "run string, __seed int, seq long, stance double").repartition(5, "seq")
    sums = {(r.run, r.rep): (r.n, r.total) for r in _replicate_sums(votes, ["run"], 20, place_bits).collect()}
    assert len(sums) == 60
    for run, stances in runs.items():
        n, size = len(stances), 1 << place_bits
        for rep in range(20):
            wanted = {0: n} if n <= size else Counter(half_of(f"7:{rep}:block:{i // 2}", i % 2) % n // size for i in range(n))
            drawn = []
            for block, draws in wanted.items():
                own = stances[block * size : (block + 1) * size]
                drawn += [own[half_of(f"7:{rep}:{block}:{j // 2}", j % 2) % len(own)] for j in range(draws)]
            assert sums[run, rep] == (n, pytest.approx(math.fsum(s for s in drawn if s is not None), abs=1e-9))


def test_parts_are_dealt_evenly(spark):
    """A hash of 48 keys leaves some of 12 partitions with twice as many as others."""
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    parts = spark.range(48).selectExpr("'42' __seed", "0 block", "cast(id as int) __part", "id at")
    dealt = _dealt(parts, ["__seed", "block"], ["at"])
    assert [len(rows) for rows in dealt.rdd.glom().collect()] == [4] * 12


def test_bootstrap_draws_are_pairs_of_whole_digests(spark):
    """Every two draws have a digest of their own, in runs of more than 65,536 votes too and beside runs of the same seed."""
    rng = random.Random(5)
    runs = {"long": [rng.random() for _ in range(70_001)], "short": [rng.random() for _ in range(31)]}
    rows = [(run, 7, i, s) for run, stances in runs.items() for i, s in enumerate(stances)]
    votes = spark.createDataFrame(rows, "run string, __seed int, seq long, stance double")
    sums = {(r.run, r.rep): r.total for r in _replicate_sums(votes, ["run"], 5, PLACE_BITS).collect()}
    assert len(sums) == 10
    for (run, rep), total in sums.items():
        own = runs[run]
        digests = [f"7:{rep}:0:{half}" for half in range(len(own) // 2 + 1)]
        drawn = [half_of(d, second) % len(own) for d in digests for second in (False, True)][: len(own)]
        assert total == pytest.approx(math.fsum(own[p] for p in drawn), abs=1e-7)


@pytest.mark.parametrize("place_bits", [16, 3, 0])
def test_draws_of_a_place_are_binomial(spark, place_bits):
    """How often one vote of twenty is drawn in 3,000 replicates, against the exact shares (chi-squared)."""
    n, replicates = 20, 3000
    votes = spark.createDataFrame([("r", 11, i, float(i == 13)) for i in range(n)], "run string, __seed int, seq long, stance double")
    sums = _replicate_sums(votes, ["run"], replicates, place_bits).collect()
    assert len(sums) == replicates and {r.n for r in sums} == {n}
    seen = Counter(min(4, round(r.total)) for r in sums)
    share = [math.comb(n, k) * 0.05**k * 0.95 ** (n - k) for k in range(4)]
    share.append(1 - sum(share))
    # Four degrees of freedom: 18.5 is passed once in a thousand times.
    assert sum((seen[k] - replicates * p) ** 2 / (replicates * p) for k, p in enumerate(share)) < 18.5


def test_rank_bounds():
    assert rank_bounds(1000, 0.05) == (25, 975) and rank_bounds(10, 0.0) == (0, 9)


def test_numbered_digests_are_those_of_hashlib():
    for prefix in (b"", b"42:999:", b"x" * 53):
        for low, high in ((0, 9000), (99_990, 100_020), (5, 5)):
            expected = b"".join(hashlib.md5(prefix + b"%d" % n).digest() for n in range(low, high))
            assert numbered_digests(prefix, low, high) == expected
