"""Build the persona library and sample from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from censemble.functions.recode import recode_coded_survey, recode_label_survey, recode_microdata
from censemble.operators.cells import k_anonymous, require_pool, weighted_cells
from censemble.operators.priors import blend_priors, issue_priors, party_distribution
from censemble.operators.sampling import sample_personas, scope_of
from censemble.sources import readers, writers

# --- fixed values: version labels of the public sources --------------------------------------
VERSIONS = {"acs": "5yr_2018_2022", "anes": "2020_ts", "cces": "2018_cc"}


def build_cells(spark: SparkSession, library: str, microdata: DataFrame, national: bool) -> None:
    """Cells from person records; a national load replaces all states."""
    cells = weighted_cells(recode_microdata(microdata))
    (writers.replace_cells if national else writers.replace_states)(cells, library)
    writers.record_version(spark, library, "acs", VERSIONS["acs"])


def _replace_source(spark: SparkSession, library: str, source: str, priors: DataFrame) -> None:
    others = readers.read_table(spark, library, "priors").where(F.col("source") != source)
    writers.replace_table(others.unionByName(priors.withColumn("source", F.lit(source))), library, "priors")
    writers.record_version(spark, library, source, VERSIONS[source])


def build_coded_survey(spark: SparkSession, library: str, survey: DataFrame) -> None:
    """Issue priors and the party distribution from the coded survey."""
    recoded = recode_coded_survey(survey)
    _replace_source(spark, library, "anes", issue_priors(recoded))
    writers.replace_table(party_distribution(recoded), library, "party_distribution")


def build_label_survey(spark: SparkSession, library: str, survey: DataFrame) -> None:
    """Issue priors from the label survey, blended with the others at sampling."""
    _replace_source(spark, library, "cces", issue_priors(recode_label_survey(survey)))


def require_scopes(cells: DataFrame, specs: DataFrame) -> None:
    """Every scope that is asked for must have cells that may be sampled."""
    pool = require_pool(k_anonymous(cells), "US")
    asked = specs.select(scope_of(F.col("state")).alias("state")).where(F.col("state") != "US").distinct()
    missing = asked.join(pool.select("state").distinct(), "state", "left_anti").first()
    if missing:
        raise RuntimeError(f"no cells with enough records in scope {missing['state']!r}; load microdata first")


def sample_from_library(spark: SparkSession, library: str, specs: DataFrame) -> DataFrame:
    """Personas for population specs; a library without sources, or a scope without usable
    cells, is an error."""
    versions = readers.source_versions(spark, library)
    if not versions:
        raise RuntimeError("no source versions recorded; build the persona library first")
    cells = readers.read_table(spark, library, "cells")
    require_scopes(cells, specs)
    return sample_personas(
        cells,
        readers.read_table(spark, library, "party_distribution"),
        blend_priors(readers.read_table(spark, library, "priors")),
        specs,
        versions,
    )
