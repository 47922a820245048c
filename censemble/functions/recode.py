"""Census and survey recodes into the shared demographic domains."""

from __future__ import annotations

from collections.abc import Sequence

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from censemble.functions import fixed

SKELETON = ["state", "puma", "age_band", "sex", "race_eth", "education", "income_band"]
_REQUIRED = ["AGEP", "SEX", "RAC1P", "HISP", "SCHL"]


def label_map(labels: dict) -> Column:
    """A literal map for value-label lookups; unknown labels give null."""
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(labels.items())])


def age_band(age: Column) -> Column:
    """Four adult bands; minors and unknown ages are null."""
    return (
        F.when(age < 18, F.lit(None))
        .when(age <= 29, "18-29")
        .when(age <= 44, "30-44")
        .when(age <= 64, "45-64")
        .when(age.isNotNull(), "65+")
    )


def sex(code: Column) -> Column:
    return F.when(code == 1, "male").otherwise("female")


def race_ethnicity(rac1p: Column, hisp: Column) -> Column:
    """Hispanic origin takes precedence over race."""
    return (
        F.when(hisp != 1, "hispanic")
        .when(rac1p == 1, "white_nh")
        .when(rac1p == 2, "black_nh")
        .when(rac1p == 6, "asian_nh")
        .otherwise("other_nh")
    )


def schooling(schl: Column) -> Column:
    return (
        F.when(schl <= 15, "lt_hs")
        .when(schl <= 17, "hs")
        .when(schl <= 20, "some_college")
        .when(schl == 21, "bachelors")
        .otherwise("graduate")
    )


def income_band(income: Column) -> Column:
    dollars = F.coalesce(income, F.lit(0.0))
    return (
        F.when(dollars < 25_000, "lt_25k")
        .when(dollars < 50_000, "25_50k")
        .when(dollars < 75_000, "50_75k")
        .when(dollars < 125_000, "75_125k")
        .otherwise("125k_plus")
    )


def filled_area(code: Column) -> Column:
    """The area code unless it is one of the fillers -9 and 0."""
    return F.when(~code.isin(-9, 0), code)


def zero_padded(code: Column) -> Column:
    """At least five digits; longer codes stay as they are."""
    digits = code.cast("bigint").cast("string")
    return F.when(F.abs(code) < 10_000, F.lpad(digits, 5, "0")).otherwise(digits)


def state_table(spark: SparkSession) -> DataFrame:
    """51 rows: census code, two-letter state, and the zero-padded code used in file names."""
    rows = ", ".join(f"({code}, '{usps}', '{code:02d}')" for code, usps in fixed.FIPS_STATES.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(fips, state, fips_text)")


def with_state(microdata: DataFrame) -> DataFrame:
    """Two-letter state from ``ST``; other codes are dropped. The lookup has 51 fixed rows."""
    states = F.broadcast(state_table(microdata.sparkSession).select("fips", "state"))
    return microdata.join(states, microdata["ST"] == states["fips"], "inner").drop("fips")


def recode_microdata(microdata: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Person records to the seven skeleton keys plus ``PWGTP`` and the columns ``keep``.

    Adults with known age, sex, race, origin and schooling, in a known state and area.
    """
    # Filters name plain input columns, so they reach the scan.
    adults = microdata.dropna(subset=_REQUIRED).where(F.col("AGEP") >= 18)
    # The newer area code if filled, else the older.
    placed = adults.withColumn("__area", F.coalesce(filled_area(F.col("PUMA20")), filled_area(F.col("PUMA10"))))
    return with_state(placed.where(F.col("__area").isNotNull())).select(
        "state",
        zero_padded(F.col("__area")).alias("puma"),
        age_band(F.col("AGEP")).alias("age_band"),
        sex(F.col("SEX")).alias("sex"),
        race_ethnicity(F.col("RAC1P"), F.col("HISP")).alias("race_eth"),
        schooling(F.col("SCHL")).alias("education"),
        income_band(F.col("PINCP")).alias("income_band"),
        "PWGTP",
        *keep,
    )


def _in_range(code: Column, low: int, high: int) -> Column:
    return F.when((code >= low) & (code <= high), code.cast("int"))


def _pick(code: Column, values: list[str]) -> Column:
    """1-based pick from a short list; null stays null."""
    picked = None
    for i, value in enumerate(values, start=1):
        picked = F.when(code == i, value) if picked is None else picked.when(code == i, value)
    return picked


def recode_coded_survey(survey: DataFrame) -> DataFrame:
    """Numeric-coded survey: keys, race, three issue answers as 1/0/null and ideology 1-7.

    Rows without party, education or age band are dropped.
    """
    names = fixed.CODED_SURVEY
    usable = survey.where(
        F.col(names["party"]).between(1, 7)
        & F.col(names["education"]).between(1, 5)
        & (F.col(names["age"]) >= 18)
        & ~F.isnan(names["age"])
    )
    party = F.col(names["party"])

    def favors(item: str) -> Column:
        answer = _in_range(F.col(names[item]), 1, 3)
        return F.when(answer.isNotNull(), (answer == 1).cast("int"))

    return usable.select(
        F.when(party <= 3, "dem").when(party == 4, "ind").otherwise("rep").alias("party_id"),
        _pick(F.col(names["education"]).cast("int"), fixed.EDUCATIONS).alias("education"),
        age_band(F.col(names["age"]).cast("int")).alias("age_band"),
        _pick(_in_range(F.col(names["race"]), 1, 6), [
            "white_nh", "black_nh", "hispanic", "asian_nh", "other_nh", "other_nh",
        ]).alias("race_eth"),
        favors("climate").alias("climate"),
        favors("guns").alias("guns"),
        favors("taxes").alias("taxes"),
        # Centred at 0; dividing by 3 maps 1..7 onto [-1, 1].
        (_in_range(F.col(names["ideology"]), 1, 7) - 4).alias("ideology_units"),
        F.lit(3).alias("ideology_scale"),
    )


def recode_label_survey(survey: DataFrame) -> DataFrame:
    """Text-label survey, to the same columns as the coded one (race is not asked)."""
    names = fixed.LABEL_SURVEY
    usable = (
        survey.where(
            F.col(names["party"]).isin(list(fixed.PARTY_LABELS))
            & F.col(names["education"]).isin(list(fixed.EDUCATION_LABELS))
        )
        .withColumn("__year", F.col(names["birthyear"]).try_cast("double"))
        .withColumn("__age", fixed.LABEL_SURVEY_YEAR - F.when(~F.isnan("__year"), F.col("__year")).try_cast("int"))
        .where(F.col("__age") >= 18)
    )

    def favors(item: str) -> Column:
        answer = F.col(names[item])
        return F.when(answer.isin(fixed.SUPPORT_LABELS), 1).when(answer.isin(fixed.OPPOSE_LABELS), 0)

    return usable.select(
        F.element_at(label_map(fixed.PARTY_LABELS), F.col(names["party"])).alias("party_id"),
        F.element_at(label_map(fixed.EDUCATION_LABELS), F.col(names["education"])).alias("education"),
        age_band(F.col("__age")).alias("age_band"),
        F.lit(None).cast("string").alias("race_eth"),
        favors("climate").alias("climate"),
        favors("guns").alias("guns"),
        favors("taxes").alias("taxes"),
        F.element_at(label_map(fixed.IDEOLOGY_HALF_POINTS), F.col(names["ideology"])).alias("ideology_units"),
        F.lit(2).alias("ideology_scale"),
    )
