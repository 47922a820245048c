import pytest

from censemble.functions.uniform import unit_draw
from censemble.operators import priors as pri
from pyspark.sql import functions as F

PRIOR = "party_id string, education string, age_band string, p_climate_action_support double, p_gun_restriction_support double, p_tax_on_rich_support double, ideology_score double, cell_n long"
RECODED = "party_id string, education string, age_band string, race_eth string, climate int, guns int, taxes int, ideology_units int, ideology_scale int"


def prior(spark, climate, n, key=("dem", "bachelors", "30-44")):
    return spark.createDataFrame([(*key, climate, 0.5, 0.5, 0.0, n)], PRIOR)


def test_blend_is_weighted_by_cell_size(spark):
    blended = pri.blend_priors(pri.stack_sources({"a": prior(spark, 0.4, 10), "b": prior(spark, 0.9, 30)}))
    row = blended.first()
    assert row.p_climate_action_support == pytest.approx(0.775) and row.blend_n == 40


def test_thin_source_is_skipped(spark):
    blended = pri.blend_priors(pri.stack_sources({"a": prior(spark, 0.3, 20), "b": prior(spark, 0.99, 2)}))
    assert blended.first().p_climate_action_support == pytest.approx(0.3)


def test_unknown_cell_reads_defaults(spark):
    people = spark.createDataFrame([("ind", "graduate", "65+")], "party_id string, education string, age_band string")
    row = pri.with_priors(people, pri.blend_priors(pri.stack_sources({"a": prior(spark, 0.3, 20)}))).first()
    assert [row[v] for v in pri.PRIOR_VALUES] == [0.5, 0.5, 0.5, 0.0]


def test_no_source_is_an_error():
    with pytest.raises(ValueError):
        pri.stack_sources({})


def test_issue_priors_use_valid_answers_only(spark):
    key = ("dem", "hs", "18-29", None)
    rows = [(*key, c, None, 1, i, 2) for c, i in [(1, -2), (1, 2), (0, 1), (None, None), (None, None)]]
    row = pri.issue_priors(spark.createDataFrame(rows, RECODED)).first()
    assert row.p_climate_action_support == pytest.approx(2 / 3)
    assert row.p_gun_restriction_support == 0.5 and row.p_tax_on_rich_support == 1.0
    assert row.ideology_score == pytest.approx(1 / 6) and row.cell_n == 5
    assert pri.issue_priors(spark.createDataFrame(rows[:4], RECODED)).isEmpty()


def test_party_backoff(spark):
    def people(race, party, n):
        return [(party, "hs", "30-44", race, 1, 1, 1, 1, 3)] * n

    rows = people("white_nh", "dem", 15) + people("black_nh", "rep", 14) + people("hispanic", "ind", 3) + people(None, "ind", 4)
    # Another (age, education) with too few people is not listed at all.
    rows += [("dem", "lt_hs", "65+", "white_nh", 1, 1, 1, 1, 3)] * 14
    got = {r.race_eth: (r.p_dem, r.p_ind, r.p_rep, r.cell_n) for r in pri.party_distribution(spark.createDataFrame(rows, RECODED)).collect()}
    marginal = tuple(pytest.approx(x / 36) for x in (15, 7, 14))
    assert got == {
        "white_nh": (1.0, 0.0, 0.0, 15), "black_nh": (*marginal, 14), "hispanic": (*marginal, 3),
        "asian_nh": (*marginal, 0), "other_nh": (*marginal, 0),
    }


def test_party_draw_uses_uniform_below_k(spark):
    dist = spark.createDataFrame(
        [("30-44", "hs", "white_nh", 1.0, 0.0, 0.0, 15), ("30-44", "hs", "hispanic", 1.0, 0.0, 0.0, 3)],
        "age_band string, education string, race_eth string, p_dem double, p_ind double, p_rep double, cell_n long",
    )
    people = spark.range(3000).select(
        F.lit("30-44").alias("age_band"), F.lit("hs").alias("education"),
        F.when(F.col("id") % 3 == 0, "white_nh").when(F.col("id") % 3 == 1, "hispanic").otherwise("asian_nh").alias("race_eth"), "id",
    )
    drawn = pri.with_party(people, dist, unit_draw(F.lit(1), F.col("id")))
    counts = {(r.race_eth, r.party_id): r["count"] for r in drawn.groupBy("race_eth", "party_id").count().collect()}
    assert counts["white_nh", "dem"] == 1000 and ("white_nh", "rep") not in counts
    for race in ("hispanic", "asian_nh"):
        assert all(270 < counts[race, p] < 400 for p in ("dem", "ind", "rep"))
