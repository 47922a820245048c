import hashlib
import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from censemble import session
from censemble.functions import fixed
from censemble.functions.recode import recode_microdata
from censemble.operators import sampling as smp
from censemble.operators import validate
from censemble.operators.cells import weighted_cells
from censemble.sources.schemas import CELLS, MICRODATA, PARTY_DISTRIBUTION

VERSIONS = {"acs": "test", "anes": "2020"}
SPECS = "spec_id int, state string, n long, seed int"


@pytest.fixture()
def cells(spark):
    rows = []
    for s, state in enumerate(["CA", "WA", "NY"]):
        for puma in range(3):
            for i, race in enumerate(fixed.RACES):
                rows.append((state, f"{puma:05d}", "30-44", "female", race, "bachelors", "50_75k", (s + 1) * 10 * (i + 1), 5 + i - (race == "hispanic") * 5))
    return spark.createDataFrame(rows, CELLS)


def brute(rows, spec):
    """The draw by definition: walk the weight line in key order."""
    pool = sorted(r for r in rows if r.record_count >= 5 and r.person_weight > 0 and spec[1] in ("US", "*", r.state))
    total, out = sum(r.person_weight for r in pool), []
    for no in range(spec[2]):
        digest = hashlib.md5(f"{spec[3]}:cell:{no}".encode()).hexdigest()
        target = int(digest[:15], 16) % total
        for r in pool:
            if target < r.person_weight:
                out.append((spec[0], no, *r[:7]))
                break
            target -= r.person_weight
    return out


@pytest.mark.parametrize("hot_rows", [1_000_000, 3])
def test_draws_match_the_definition(spark, cells, hot_rows):
    specs = [(1, "US", 200, 7), (2, "WA", 50, 7), (3, "*", 20, 9), (4, "NY", 1, 1)]
    drawn = smp.draw_cells(cells, spark.createDataFrame(specs, SPECS), hot_rows=hot_rows)
    got = sorted((r.spec_id, r.draw_no, r.state, r.puma, r.age_band, r.sex, r.race_eth, r.education, r.income_band) for r in drawn.collect())
    expected = sorted(row for s in specs for row in brute(cells.collect(), s))
    assert got == expected


def test_national_share_follows_weight(spark):
    rows = [(s, p, "30-44", "female", "white_nh", "bachelors", "50_75k", w, 50) for s, p, w in [("WA", "53001", 100), ("CA", "06001", 300)]]
    drawn = smp.draw_cells(spark.createDataFrame(rows, CELLS), spark.createDataFrame([(1, "US", 400, 7)], SPECS))
    counts = Counter(r.state for r in drawn.collect())
    assert set(counts) == {"WA", "CA"} and 0.6 < counts["CA"] / 400 < 0.9


def sampled(spark, cells):
    dist = spark.createDataFrame([("30-44", "bachelors", "white_nh", 0.5, 0.25, 0.25, 20)], PARTY_DISTRIBUTION)
    blended = spark.createDataFrame(
        [("dem", "bachelors", "30-44", 0.7, 0.6, 0.125, -0.375)],
        "party_id string, education string, age_band string, p_climate_action_support double, p_gun_restriction_support double, p_tax_on_rich_support double, ideology_score double",
    )
    specs = spark.createDataFrame([(1, "US", 60, 42)], SPECS)
    return smp.sample_personas(cells, dist, blended, specs, VERSIONS)


def test_personas_do_not_depend_on_partitioning(spark, cells):
    results = []
    for n in ("1", "4", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        flat = sampled(spark, cells.repartition(int(n)))
        results.append(sorted(map(tuple, flat.select(sorted(flat.columns)).collect())))
    assert results[0] == results[1] == results[2] and len(results[0]) == 60


def test_persona_id_is_the_hash_of_the_payload(spark, cells):
    row = sampled(spark, cells).first()
    skeleton = {k: row[k] for k in ("state", "puma", "age_band", "sex", "race_eth", "education", "income_band")}
    payload = json.dumps({"skeleton": skeleton, "seed": 42, "sources": VERSIONS}, sort_keys=True)
    assert row.persona_id == hashlib.sha256(payload.encode()).hexdigest()[:16]


def test_personas_are_valid_and_nest(spark, cells):
    flat = sampled(spark, cells)
    valid, bad = validate.split_valid(validate.check_personas(flat))
    assert valid.count() == 60 and bad.isEmpty()
    nested = smp.nest_personas(flat, VERSIONS).first()
    assert nested.source_versions == VERSIONS and nested.demographics.state and nested.priors.party_id in fixed.PARTIES


def test_no_thin_cell_is_drawn(spark, cells):
    assert "hispanic" not in {r.race_eth for r in sampled(spark, cells).collect()}


def test_versions_are_required():
    with pytest.raises(RuntimeError):
        smp.versions_json({})


def test_baseline_is_the_weighted_mean(spark, cells):
    dist = spark.createDataFrame([("30-44", "bachelors", r, 1.0, 0.0, 0.0, 20) for r in fixed.RACES], PARTY_DISTRIBUTION)
    blended = spark.createDataFrame(
        [("dem", "bachelors", "30-44", 0.7, 0.6, 0.2, -0.4)],
        "party_id string, education string, age_band string, p_climate_action_support double, p_gun_restriction_support double, p_tax_on_rich_support double, ideology_score double",
    )
    for row in smp.poststratified_baseline(cells, dist, blended).collect():
        assert row.p_climate_action_support == pytest.approx(0.7) and row.ideology_score == pytest.approx(-0.4)


def test_draw_join_is_a_hash_or_merge_join(spark, cells):
    plan = smp.draw_cells(cells, spark.createDataFrame([(1, "US", 5, 1)], SPECS))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_only_asked_states_are_read_and_one_table_is_stored(spark, tmp_path):
    rows = [(s, "00001", "30-44", sex, "white_nh", "hs", "lt_25k", 10, 9) for s in ("CA", "WA", "ZZ") for sex in ("male", "female")]
    spark.createDataFrame(rows, CELLS).write.partitionBy("state").parquet(str(tmp_path / "cells"))
    cells = spark.read.parquet(str(tmp_path / "cells"))
    plans = []
    kept = smp.weight_intervals

    def spied(pool):
        plans.append(pool._jdf.queryExecution().executedPlan().toString())
        return kept(pool)

    before = len(session._stored_paths)
    smp.weight_intervals = spied
    try:
        drawn = smp.draw_cells(cells, spark.createDataFrame([(1, "WA", 20, 7)], SPECS)).collect()
    finally:
        smp.weight_intervals = kept
    assert {r.state for r in drawn} == {"WA"} and len(drawn) == 20
    assert "PartitionFilters: [state" in plans[0].replace("PartitionFilters: [isnotnull(state", "PartitionFilters: [state")
    assert len(session._stored_paths) == before + 1
    every = smp.draw_cells(cells, spark.createDataFrame([(1, "US", 300, 7)], SPECS)).collect()
    assert {r.state for r in every} == {"CA", "WA", "ZZ"} and len(every) == 300


def test_scope_without_cells_is_an_error(spark):
    rows = [("CA", "00001", "30-44", "male", "white_nh", "hs", "lt_25k", 10, 9)]
    specs = spark.createDataFrame([(1, "CA", 3, 7), (2, "TX", 3, 7)], SPECS)
    with pytest.raises(Exception, match="no cells with enough records in scope TX"):
        smp.draw_cells(spark.createDataFrame(rows, CELLS), specs).collect()
    cells = spark.createDataFrame(rows, CELLS)
    assert smp.draw_cells(cells, specs, strict=False).count() == 3
    assert [r.spec_id for r in smp.empty_scopes(cells, specs).collect()] == [2]


def test_versions_are_escaped_like_json(spark):
    versions = {"a": 'x"y\\z\n\t', "b": "é 日 😀 \x01"}
    frame = spark.createDataFrame([(versions,)], "v map<string,string>")
    got = frame.select(smp.versions_json(F.col("v")).alias("m"), smp.versions_json(versions).alias("d")).first()
    assert got.m == got.d == json.dumps(versions, sort_keys=True)


def test_microdata_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = [(53, -9, area, 40, 1, 1, 1, 21, 1.0, 10) for area in (1, 2) for _ in range(10)]
    people = spark.createDataFrame(rows, MICRODATA).mapInArrow(counted, MICRODATA)
    drawn = smp.draw_cells(weighted_cells(recode_microdata(people)), spark.createDataFrame([(1, "US", 30, 7)], SPECS))
    assert drawn.count() == 30 and read.value == len(rows)
