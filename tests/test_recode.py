import pytest

from censemble.functions import fixed
from censemble.functions import recode as rc
from censemble.operators.cells import k_anonymous, require_pool, weighted_cells

MICRO = "ST int, PUMA10 int, PUMA20 int, AGEP int, SEX int, RAC1P int, HISP int, SCHL int, PINCP double, PWGTP int"


def person(**changes):
    base = dict(ST=53, PUMA10=11, PUMA20=23303, AGEP=40, SEX=2, RAC1P=1, HISP=1, SCHL=21, PINCP=60000.0, PWGTP=10)
    return tuple({**base, **changes}.values())


@pytest.mark.parametrize("changes, column, expected", [
    ({"AGEP": 18}, "age_band", "18-29"), ({"AGEP": 29}, "age_band", "18-29"), ({"AGEP": 30}, "age_band", "30-44"),
    ({"AGEP": 44}, "age_band", "30-44"), ({"AGEP": 45}, "age_band", "45-64"), ({"AGEP": 64}, "age_band", "45-64"),
    ({"AGEP": 65}, "age_band", "65+"),
    ({"SEX": 1}, "sex", "male"), ({"SEX": 2}, "sex", "female"),
    ({"HISP": 2, "RAC1P": 1}, "race_eth", "hispanic"), ({"RAC1P": 1}, "race_eth", "white_nh"),
    ({"RAC1P": 2}, "race_eth", "black_nh"), ({"RAC1P": 6}, "race_eth", "asian_nh"), ({"RAC1P": 3}, "race_eth", "other_nh"),
    ({"SCHL": 15}, "education", "lt_hs"), ({"SCHL": 17}, "education", "hs"), ({"SCHL": 20}, "education", "some_college"),
    ({"SCHL": 21}, "education", "bachelors"), ({"SCHL": 22}, "education", "graduate"),
    ({"PINCP": None}, "income_band", "lt_25k"), ({"PINCP": 24999.0}, "income_band", "lt_25k"),
    ({"PINCP": 25000.0}, "income_band", "25_50k"), ({"PINCP": 50000.0}, "income_band", "50_75k"),
    ({"PINCP": 75000.0}, "income_band", "75_125k"), ({"PINCP": 125000.0}, "income_band", "125k_plus"),
    ({}, "puma", "23303"), ({"PUMA20": -9}, "puma", "00011"), ({"PUMA20": None}, "puma", "00011"),
    ({"PUMA20": 0}, "puma", "00011"), ({"PUMA20": 123456}, "puma", "123456"), ({}, "state", "WA"),
])
def test_census_recodes(spark, changes, column, expected):
    df = spark.createDataFrame([person(**changes)], MICRO)
    assert rc.recode_microdata(df).first()[column] == expected


@pytest.mark.parametrize("changes", [
    {"AGEP": 17}, {"AGEP": None}, {"SEX": None}, {"RAC1P": None}, {"HISP": None}, {"SCHL": None}, {"ST": 72},
    {"PUMA20": -9, "PUMA10": 0}, {"PUMA20": None, "PUMA10": None},
])
def test_census_rows_left_out(spark, changes):
    assert rc.recode_microdata(spark.createDataFrame([person(**changes)], MICRO)).isEmpty()


def test_state_table(spark):
    rows = {r.fips: r for r in rc.state_table(spark).collect()}
    assert len(rows) == 51 and rows[6].state == "CA" and rows[6].fips_text == "06"


def test_cells_count_records_with_a_weight(spark):
    df = spark.createDataFrame([person(), person(PWGTP=5), person(PWGTP=None), person(SEX=1, PWGTP=None)], MICRO)
    cells = {r.sex: (r.person_weight, r.record_count) for r in weighted_cells(rc.recode_microdata(df)).collect()}
    assert cells == {"female": (15, 2), "male": (0, 0)}


def test_k_anonymous_scope(spark):
    cells = weighted_cells(rc.recode_microdata(spark.createDataFrame([person()] * 5 + [person(ST=6)] * 4, MICRO)))
    assert [r.state for r in k_anonymous(cells).collect()] == ["WA"]
    assert k_anonymous(cells, "CA").isEmpty()
    assert k_anonymous(cells, "us").count() == 1
    with pytest.raises(RuntimeError):
        require_pool(k_anonymous(cells, "CA"), "CA")


def coded(spark, **changes):
    base = {"party": 1.0, "education": 3.0, "age": 40.0, "ideology": 4.0, "climate": 1.0, "guns": 2.0, "taxes": 3.0, "race": 1.0}
    row = {**base, **changes}
    ddl = ", ".join(f"{fixed.CODED_SURVEY[k]} double" for k in row)
    return rc.recode_coded_survey(spark.createDataFrame([tuple(row.values())], ddl))


@pytest.mark.parametrize("changes, column, expected", [
    ({"party": 3.0}, "party_id", "dem"), ({"party": 4.0}, "party_id", "ind"), ({"party": 7.0}, "party_id", "rep"),
    ({"education": 1.0}, "education", "lt_hs"), ({"education": 5.0}, "education", "graduate"),
    ({"race": 5.0}, "race_eth", "other_nh"), ({"race": 6.0}, "race_eth", "other_nh"), ({"race": -9.0}, "race_eth", None),
    ({"age": 80.0}, "age_band", "65+"), ({"climate": 1.0}, "climate", 1), ({"climate": 3.0}, "climate", 0),
    ({"climate": -2.0}, "climate", None), ({"ideology": 99.0}, "ideology_units", None), ({"ideology": 7.0}, "ideology_units", 3),
])
def test_coded_survey(spark, changes, column, expected):
    assert coded(spark, **changes).first()[column] == expected


@pytest.mark.parametrize("changes", [{"party": 0.0}, {"party": 8.0}, {"education": -8.0}, {"age": 17.0}, {"age": None}, {"age": float("nan")}])
def test_coded_survey_drops(spark, changes):
    assert coded(spark, **changes).isEmpty()


def labels(spark, **changes):
    base = {"party": "Lean Democrat", "education": "2-year", "birthyear": "1980", "ideology": "Liberal",
            "climate": "Support", "guns": "Against", "taxes": "Not sure"}
    row = {**base, **changes}
    ddl = ", ".join(f"{fixed.LABEL_SURVEY[k]} string" for k in row)
    return rc.recode_label_survey(spark.createDataFrame([tuple(row.values())], ddl))


@pytest.mark.parametrize("changes, column, expected", [
    ({}, "party_id", "dem"), ({"party": "Independent"}, "party_id", "ind"), ({"party": "Strong Republican"}, "party_id", "rep"),
    ({}, "education", "some_college"), ({"education": "Post-grad"}, "education", "graduate"),
    ({"birthyear": "2000"}, "age_band", "18-29"), ({"birthyear": "1950.0"}, "age_band", "65+"),
    ({}, "climate", 1), ({}, "guns", 0), ({}, "taxes", None), ({}, "ideology_units", -1), ({"ideology": "Not sure"}, "ideology_units", None),
])
def test_label_survey(spark, changes, column, expected):
    assert labels(spark, **changes).first()[column] == expected


@pytest.mark.parametrize("changes", [{"party": "Not sure"}, {"party": None}, {"education": "?"}, {"birthyear": "n/a"}, {"birthyear": "2001"}])
def test_label_survey_drops(spark, changes):
    assert labels(spark, **changes).isEmpty()


def test_filters_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([person()], MICRO).write.parquet(str(tmp_path / "m"))
    plan = weighted_cells(rc.recode_microdata(spark.read.parquet(str(tmp_path / "m"))))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(AGEP,18)" in plan
    assert "BatchEvalPython" not in plan and "CartesianProduct" not in plan
