"""Every operator as a named query over the driver's tables: (spark, sf_dir) -> DataFrame.

Doubles are rounded here, at the edge, so that results can be compared with another engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from censemble.functions import fixed, parsing, policy, text
from censemble.functions.recode import (
    SKELETON,
    recode_coded_survey,
    recode_label_survey,
    recode_microdata,
    with_state,
)
from censemble.operators import calibration as cal
from censemble.operators import priors as pri
from censemble.operators import prompts as prm
from censemble.operators import sampling as smp
from censemble.operators import spend, transcripts, validate
from censemble.operators import votes as vot
from censemble.operators.bootstrap import bootstrap_interval
from censemble.operators.cells import k_anonymous, weighted_cells
from censemble.plans import fixtures as fx
from censemble.plans import national
from censemble.session import scratch_path
from censemble.sources import readers, writers

Query = Callable[[SparkSession, str], DataFrame]
VERSIONS = {"acs": "5yr_2018_2022", "anes": "2020_ts", "cces": "2018_cc"}
CAP_USD = "0.01"
# Means over round numbers of votes often end in a five at the seventh digit; nine keep clear of it.
DIGITS = 9
# Missing whole numbers are shown as this, so that result columns stay integers everywhere.
MISSING = -9
ANSWERS = ["climate", "guns", "taxes", "ideology_units"]


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Double columns rounded, all else as it is."""
    return df.select(*[
        (F.round(F.col(n), digits).alias(n) if t == "double" else F.col(n)) for n, t in df.dtypes
    ])


# --- shared steps ----------------------------------------------------------------------------

def _cells(spark: SparkSession, d: str) -> DataFrame:
    return weighted_cells(recode_microdata(fx.microdata(spark, d)))


def _coded_priors(spark: SparkSession, d: str) -> DataFrame:
    return pri.issue_priors(recode_coded_survey(fx.survey_coded(spark, d)))


def _label_priors(spark: SparkSession, d: str) -> DataFrame:
    return pri.issue_priors(recode_label_survey(fx.survey_labels(spark, d)))


def _party(spark: SparkSession, d: str) -> DataFrame:
    return pri.party_distribution(recode_coded_survey(fx.survey_coded(spark, d)))


def _blended(spark: SparkSession, d: str) -> DataFrame:
    return pri.blend_priors(
        pri.stack_sources({"anes": _coded_priors(spark, d), "cces": _label_priors(spark, d)})
    )


def _personas(spark: SparkSession, d: str) -> DataFrame:
    return smp.sample_personas(
        _cells(spark, d), _party(spark, d), _blended(spark, d), fx.specs(spark, d), VERSIONS, strict=False
    )


def _votes(spark: SparkSession, d: str) -> DataFrame:
    return vot.with_phase(fx.votes(spark, d), fx.truth(spark, d))


def _priced(spark: SparkSession, d: str) -> DataFrame:
    """All calls; one of the models has no price, and its calls are marked, not refused."""
    return spend.priced_calls(fx.calls(spark, d), spend.price_table(spark), strict=False)


def _costs(spark: SparkSession, d: str) -> DataFrame:
    """Cost of every (measure, group); calls without a price add nothing."""
    return _priced(spark, d).groupBy(
        F.col("run_id").alias("measure_id"), (F.floor(F.col("seq") / 7) % 5).cast("int").alias("group_id")
    ).agg(F.sum("usd").cast("double").alias("cost_usd"))


def _scored_by_seed(spark: SparkSession, d: str) -> DataFrame:
    shares = vot.yes_shares(_votes(spark, d), ["measure_id", "group_id"])
    return vot.score_runs(shares, fx.truth(spark, d))


# --- sources and recodes ---------------------------------------------------------------------

def scan_microdata(spark: SparkSession, d: str) -> DataFrame:
    """Write the person records as CSV files and scan them back by column name."""
    path = scratch_path(spark, "microdata")
    fx.microdata(spark, d).write.option("header", True).csv(path)
    people = readers.read_microdata(spark, [path])
    return people.groupBy("ST").agg(
        F.count(F.lit(1)).alias("records"),
        F.sum("PWGTP").alias("weight"),
        F.count("SCHL").alias("with_schooling"),
        F.count("PINCP").alias("with_income"),
    )


def scan_national(spark: SparkSession, d: str) -> DataFrame:
    """Person records in two national files with their columns in different places, by name."""
    folder = scratch_path(spark, "national")
    people = fx.microdata(spark, d)
    columns = people.columns
    even = F.col("PWGTP") % 2 == 0
    people.where(even).write.option("header", True).csv(f"{folder}/csv_pus/psam_pusa.csv")
    people.where(~even).select(*columns[::-1], F.lit("x").alias("EXTRA")).write.option("header", True).csv(
        f"{folder}/csv_pus/psam_pusb.csv"
    )
    return readers.read_national_microdata(spark, folder).groupBy("ST").agg(
        F.count(F.lit(1)).alias("records"),
        F.sum("PWGTP").alias("weight"),
        F.sum("AGEP").alias("ages"),
        F.count("SCHL").alias("with_schooling"),
        F.count("PINCP").alias("with_income"),
    )


def _partly_unreadable(spark: SparkSession, d: str) -> str:
    """Person records as CSV: an age of 40 is a word, and the newer area of those aged 41 has a letter."""
    path = scratch_path(spark, "unreadable")
    age = F.when(F.col("AGEP") == 40, "forty").otherwise(F.col("AGEP").cast("string"))
    area = F.when(F.col("AGEP") == 41, F.concat(F.lit("x"), "PUMA20")).otherwise(F.col("PUMA20").cast("string"))
    fx.microdata(spark, d).withColumns({"AGEP": age, "PUMA20": area}).write.option("header", True).csv(path)
    return path


def readable_microdata(spark: SparkSession, d: str) -> DataFrame:
    """The records whose numbers can be read; an area that cannot is none."""
    people = readers.read_microdata(spark, [_partly_unreadable(spark, d)], strict=False)
    return people.groupBy("ST").agg(
        F.count(F.lit(1)).alias("records"), F.sum("AGEP").alias("ages"), F.count("PUMA20").alias("with_area")
    )


def unreadable_microdata(spark: SparkSession, d: str) -> DataFrame:
    """Cells that cannot be read, counted by column and text."""
    bad = readers.unreadable_microdata(spark, [_partly_unreadable(spark, d)])
    return bad.groupBy(F.col("column").alias("cell_column"), "text", "kept").agg(F.count(F.lit(1)).alias("n"))


def national_load(spark: SparkSession, d: str) -> DataFrame:
    """Two national files loaded; the second one changes, and only its part is read and replaced."""
    library, folder = scratch_path(spark, "library"), scratch_path(spark, "national")
    people = fx.microdata(spark, d)
    even = F.col("PWGTP") % 2 == 0
    first, second = f"{folder}/psam_pusa.csv", f"{folder}/psam_pusb.csv"
    people.where(even).write.option("header", True).csv(first)
    people.where(~even).write.option("header", True).csv(second)
    national.load_national(spark, library, folder)
    doubled = people.where(~even).withColumn("PWGTP", F.col("PWGTP") * 2)
    doubled.write.mode("overwrite").option("header", True).csv(second)
    national.load_national(spark, library, folder)
    return readers.read_table(spark, library, "cells").select(*SKELETON, "person_weight", "record_count")


def scan_survey_labels(spark: SparkSession, d: str) -> DataFrame:
    """The label survey written as CSV and scanned by name."""
    path = scratch_path(spark, "labels")
    fx.survey_labels(spark, d).write.option("header", True).csv(path)
    names = fixed.LABEL_SURVEY
    return readers.read_label_survey(spark, path).groupBy(
        F.col(names["party"]).alias("party"), F.col(names["climate"]).alias("climate")
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(names["ideology"]).alias("with_ideology"),
        F.count_if(F.col(names["birthyear"]) == "n/a").alias("no_birthyear"),
    )


def scan_survey_coded(spark: SparkSession, d: str) -> DataFrame:
    """The coded survey written as CSV and scanned as numbers."""
    path = f"{scratch_path(spark, 'coded')}.csv"
    fx.survey_coded(spark, d).write.option("header", True).csv(path)
    names = fixed.CODED_SURVEY
    return readers.read_coded_survey(spark, path).groupBy(F.col(names["education"]).cast("int").alias("education")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(names["age"]).cast("bigint").alias("ages"),
        F.sum(names["ideology"]).cast("bigint").alias("ideology"),
    )


def recode_census(spark: SparkSession, d: str) -> DataFrame:
    return recode_microdata(fx.microdata(spark, d)).withColumn("PWGTP", F.col("PWGTP").cast("bigint"))


def state_lookup(spark: SparkSession, d: str) -> DataFrame:
    return with_state(fx.microdata(spark, d)).groupBy("ST", "state").agg(F.count(F.lit(1)).alias("records"))


def cells_query(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d)


def k_anon_pool(spark: SparkSession, d: str) -> DataFrame:
    return k_anonymous(_cells(spark, d), "US")


def k_anon_pool_state(spark: SparkSession, d: str) -> DataFrame:
    return k_anonymous(_cells(spark, d), "CA")


def replace_state(spark: SparkSession, d: str) -> DataFrame:
    """Load all states, then replace California by its cells at double weight, and read back."""
    library = scratch_path(spark, "library")
    cells = _cells(spark, d)
    writers.replace_cells(cells, library)
    stored = readers.read_table(spark, library, "cells")
    doubled = stored.where(F.col("state") == "CA").withColumn("person_weight", F.col("person_weight") * 2)
    # A second library, so that the rows read are not those being replaced.
    second = scratch_path(spark, "library")
    writers.replace_cells(stored, second)
    writers.replace_states(doubled, second)
    return readers.read_table(spark, second, "cells").select(*SKELETON, "person_weight", "record_count")


def source_versions_latest(spark: SparkSession, d: str) -> DataFrame:
    return readers.latest_versions(fx.version_log(spark, d)).select(
        "source_name", "version", F.date_format("loaded_at", "yyyy-MM-dd HH:mm:ss").alias("loaded_at")
    )


def source_versions_map(spark: SparkSession, d: str) -> DataFrame:
    latest = readers.versions_map(fx.version_log(spark, d))
    return latest.select(smp.versions_json(F.col("source_versions")).alias("source_versions"))


def measures(spark: SparkSession, d: str) -> DataFrame:
    """Definitions written as JSON lines and read back with defaults."""
    path = scratch_path(spark, "measures")
    fx.measure_definitions(spark, d).write.json(path)
    loaded = readers.read_measures(spark, path)
    return loaded.select(
        "measure_id", "file_id", "title", "year", "state", "topic",
        F.md5(F.col("framing").cast("binary")).alias("framing_md5"), "briefing",
        *[F.size(c).alias(f"n_{c}") for c in ("briefing_sources", "pro_arguments", "con_arguments")],
        "n_rounds", "yes_pct", "no_pct", "passed",
    )


def list_measures(spark: SparkSession, d: str) -> DataFrame:
    return readers.list_measures(readers.with_measure_defaults(fx.measure_definitions(spark, d)))


def _artifact_parts(spark: SparkSession, d: str) -> DataFrame:
    """Artifacts of one run per measure: votes and personas from events, statements from the
    conversations dealt out over the measures, the report from the scored result."""
    seed = F.lit(42).alias("seed")
    cast_votes = fx.votes(spark, d).select(
        "measure_id", seed, "seq", "persona_id", "round", "stance", "confidence",
        F.concat(F.lit("because "), F.col("seq").cast("string")).alias("rationale"),
    )
    said = fx.statements(spark, d).select(
        F.concat(F.lit("wa_"), fx.pick(fx.RUNS, F.col("run_id") % 5)).alias("measure_id"), seed,
        (F.col("run_id") * 100 + F.col("seq")).alias("seq"), "speaker_id", "round", "text", "flagged",
        F.lit(None).cast("string").alias("critic_note"),
    )
    people = fx.personas(spark, d).select(
        "measure_id", seed, "draw_no", "persona_id", "age_band", "race_eth", "education", "party_id",
        F.lit("female").alias("sex"), F.lit("lt_25k").alias("income_band"), F.lit("00101").alias("puma"),
        F.lit("WA").alias("state"), *[F.lit(0.5).alias(v) for v in pri.ISSUES], F.lit(0.0).alias("ideology_score"),
    )
    scored = vot.score_runs(vot.yes_shares(_votes(spark, d), ["measure_id"]), fx.truth(spark, d))
    reports = scored.select("measure_id", seed, F.to_json(F.struct("yes_pct", "weighted_pct", "brier")).alias("report"))
    return writers.run_artifacts(reports, said, cast_votes, people)


def run_artifact(spark: SparkSession, d: str) -> DataFrame:
    return _artifact_parts(spark, d).select(
        "measure_id", F.col("seed").cast("bigint").alias("seed"), "part", "slice",
        F.col("report").isNotNull().alias("has_report"),
        F.size("statements").cast("bigint").alias("n_statements"),
        F.size("votes").cast("bigint").alias("n_votes"),
        F.size("personas").cast("bigint").alias("n_personas"),
        F.array_join(F.transform(F.filter("personas", lambda p: p["priors"]["party_id"] == "dem"),
                                 lambda p: p["persona_id"]), ",").alias("democrats"),
    )


def explode_artifact(spark: SparkSession, d: str) -> DataFrame:
    """Artifacts written as JSON and read back into a votes table."""
    path = scratch_path(spark, "artifacts")
    writers.write_artifacts(_artifact_parts(spark, d), path)
    back = readers.artifact_votes(readers.read_artifacts(spark, path))
    return rounded(back.select("measure_id", "seq", "persona_id", "round", "stance", "confidence", "rationale"))


def explode_artifact_statements(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "artifacts")
    writers.write_artifacts(_artifact_parts(spark, d), path)
    back = readers.artifact_statements(readers.read_artifacts(spark, path))
    return back.select("measure_id", "seq", "speaker_id", "round", F.md5(F.col("text").cast("binary")).alias("text_md5"), "flagged")


def explode_artifact_personas(spark: SparkSession, d: str) -> DataFrame:
    """Artifacts written twice, which must read as once, and their personas."""
    path = scratch_path(spark, "artifacts")
    parts = _artifact_parts(spark, d)
    writers.write_artifacts(parts, path)
    writers.write_artifacts(parts, path)
    back = readers.artifact_personas(readers.read_artifacts(spark, path))
    return back.select("measure_id", "draw_no", "persona_id", "party_id", "age_band", "education", "race_eth")


def survey_coded_recode(spark: SparkSession, d: str) -> DataFrame:
    return recode_coded_survey(fx.survey_coded(spark, d)).drop("ideology_scale").fillna(MISSING, ANSWERS)


def survey_labels_recode(spark: SparkSession, d: str) -> DataFrame:
    recoded = recode_label_survey(fx.survey_labels(spark, d))
    return recoded.drop("ideology_scale", "race_eth").fillna(MISSING, ANSWERS)


# --- priors and sampling ---------------------------------------------------------------------

def priors_coded(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_coded_priors(spark, d))


def priors_labels(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_label_priors(spark, d))


def replace_table(spark: SparkSession, d: str) -> DataFrame:
    """The party distribution as the third snapshot of its table, each made from the one before."""
    library = scratch_path(spark, "library")
    writers.create_library(spark, library)
    writers.replace_table(_party(spark, d), library, "party_distribution")
    first = readers.read_table(spark, library, "party_distribution")
    writers.replace_table(first.withColumn("cell_n", F.col("cell_n") * 2), library, "party_distribution")
    return rounded(readers.read_table(spark, library, "party_distribution"))


def party_backoff(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_party(spark, d))


def priors_blended(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_blended(spark, d))


def sample_cells(spark: SparkSession, d: str) -> DataFrame:
    drawn = smp.draw_cells(_cells(spark, d), fx.specs(spark, d), strict=False)
    return drawn.select("spec_id", "draw_no", *SKELETON)


def empty_scopes(spark: SparkSession, d: str) -> DataFrame:
    return smp.empty_scopes(_cells(spark, d), fx.specs(spark, d)).select("spec_id", "n")


def party_draw(spark: SparkSession, d: str) -> DataFrame:
    return _personas(spark, d).select("spec_id", "draw_no", "age_band", "education", "race_eth", "party_id")


def persona_priors(spark: SparkSession, d: str) -> DataFrame:
    return rounded(
        _personas(spark, d).select("spec_id", "draw_no", "party_id", "education", "age_band", *pri.PRIOR_VALUES)
    )


def persona_id(spark: SparkSession, d: str) -> DataFrame:
    drawn = smp.draw_cells(_cells(spark, d), fx.specs(spark, d), strict=False)
    return drawn.select(
        "spec_id", "draw_no", smp.persona_id(F.col("seed"), smp.versions_json(VERSIONS)).alias("persona_id")
    )


def personas(spark: SparkSession, d: str) -> DataFrame:
    nested = smp.nest_personas(_personas(spark, d), VERSIONS)
    return rounded(
        nested.select(
            "spec_id", "draw_no", "persona_id", "demographics.*", "priors.*", "sampling_seed",
            F.col("source_versions")["acs"].alias("acs_version"),
        )
    )


def sample_composition(spark: SparkSession, d: str) -> DataFrame:
    return smp.sample_composition(_personas(spark, d))


def prompt_rows(spark: SparkSession, d: str) -> DataFrame:
    nested = smp.nest_personas(_personas(spark, d), VERSIONS)
    return nested.select("spec_id", "draw_no", text.backstory(F.col("demographics"), F.col("priors")).alias("backstory"))


BRIEFING_TEMPLATE = "{title}\n{framing}\nSources:\n{sources}\nFor:\n{pro}\nAgainst:\n{con}"


def briefing_prompts(spark: SparkSession, d: str) -> DataFrame:
    loaded = readers.with_measure_defaults(fx.measure_definitions(spark, d))
    prompt = text.fill_template(
        BRIEFING_TEMPLATE, title=F.col("title"), framing=F.col("framing"),
        sources=text.bullets(F.col("briefing_sources")), pro=text.bullets(F.col("pro_arguments")),
        con=text.bullets(F.col("con_arguments")),
    )
    return loaded.select("measure_id", F.md5(prompt.cast("binary")).alias("prompt_md5"),
                         F.char_length(prompt).cast("bigint").alias("prompt_chars"))


# Templates of the queries; users bring their own.
CITIZEN = "Speak as this person.\n\n{backstory}"
CONTEXT_HEADING = "\n\nRecent deliberation:\n"
VOTE_REQUEST = 'Question: {framing}\nAnswer as {{"stance": 0-1, "confidence": 0-1, "rationale": "..."}}.'
TURN_REQUEST = "Round {round} of {total}. Said so far:\n{context}\nYour statement:"
CRITIC, CRITIC_REQUEST = "Check facts only.", 'Statement: {statement}\nSources:\n{sources}\nAnswer as {{"flagged": true/false, "note": "..."}}.'
PROBE, PROBE_REQUEST = "Recall facts only.", "Measure: {title} ({state}, {year})\n{framing}\nDo you know the result?"


def _run_measures(spark: SparkSession, d: str) -> DataFrame:
    """A measure per conversation: its first statement is the question, two speakers are its sources."""
    said = fx.statements(spark, d)
    return said.groupBy("run_id").agg(
        F.min_by("text", "seq").alias("framing"), (3 + F.col("run_id") % 4).cast("int").alias("n_rounds"),
        F.when(F.col("run_id") % 3 != 0, F.array(F.min("speaker_id"), F.max("speaker_id"))).alias("briefing_sources"),
    )


def _seats(spark: SparkSession, d: str) -> DataFrame:
    story = F.concat(F.lit("I am "), F.col("persona_id"), F.lit(" in run "), (F.col("run_id") % 7).cast("string"))
    return fx.roster(spark, d).withColumn("backstory", story)


def _told(prompts: tuple[DataFrame, DataFrame], on: list[str]) -> DataFrame:
    rows, stored = prompts
    keys = [F.size("system").alias("n_system"), F.size("user").alias("n_user")]
    texts = prm.expand(rows, stored, on).select(*on, *[F.md5(F.col(c).cast("binary")).alias(f"{c}_md5") for c in ("system", "user")])
    return rows.select(*on, *keys).join(texts, on)


def vote_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Final votes; runs with an even number have no transcript yet."""
    contexts = transcripts.final_context(fx.statements(spark, d), ["run_id"]).where(F.col("run_id") % 2 == 1)
    made = prm.vote_prompts(_seats(spark, d), _run_measures(spark, d), ["run_id"], CITIZEN, VOTE_REQUEST, contexts, CONTEXT_HEADING)
    return _told(made, ["run_id", "persona_id", "draw_no"])


def deliberation_prompts(spark: SparkSession, d: str) -> DataFrame:
    turns = transcripts.recent_context(fx.statements(spark, d), ["run_id"])
    return _told(prm.deliberation_prompts(turns, _seats(spark, d), _run_measures(spark, d), ["run_id"], CITIZEN, TURN_REQUEST), ["run_id", "seq"])


def critic_prompts(spark: SparkSession, d: str) -> DataFrame:
    said = fx.statements(spark, d).withColumn("text", F.when(F.col("seq") % 5 != 4, F.col("text")))
    return _told(prm.critic_prompts(said, _run_measures(spark, d), ["run_id"], CRITIC, CRITIC_REQUEST), ["run_id", "seq"])


def probe_prompts(spark: SparkSession, d: str) -> DataFrame:
    measures = fx.measure_definitions(spark, d)
    return _told(prm.probe_prompts(measures, ["measure_id"], PROBE, PROBE_REQUEST), ["measure_id"])


def prompt_segments(spark: SparkSession, d: str) -> DataFrame:
    """The stored segments of all vote prompts: every text once."""
    contexts = transcripts.final_context(fx.statements(spark, d), ["run_id"])
    _, stored = prm.vote_prompts(_seats(spark, d), _run_measures(spark, d), ["run_id"], CITIZEN, VOTE_REQUEST, contexts, CONTEXT_HEADING)
    return stored.select("key", F.char_length("text").cast("bigint").alias("chars"))


def validate_personas(spark: SparkSession, d: str) -> DataFrame:
    """Sampled personas with some values spoiled by draw number, and the reasons found."""
    no = F.col("draw_no")
    spoiled = _personas(spark, d).withColumns({
        "age_band": F.when(no % 7 == 3, "17-29").otherwise(F.col("age_band")),
        "p_tax_on_rich_support": F.when(no % 5 == 1, F.col("p_tax_on_rich_support") + 1.5).otherwise(F.col("p_tax_on_rich_support")),
        "puma": F.when(no % 11 != 4, F.col("puma")),
        "ideology_score": F.when(no % 13 == 2, float("nan")).otherwise(F.col("ideology_score")),
    })
    return validate.check_personas(spoiled).select(
        "spec_id", "draw_no", F.array_join("reasons", ",").alias("reasons")
    )


def validate_votes(spark: SparkSession, d: str) -> DataFrame:
    """Raw event values as stances: those above one are reported."""
    raw = fx.table(spark, d, "events").select(
        "event_id", F.col("user_id").cast("string").alias("persona_id"), F.lit(0).alias("round"),
        (F.col("value") / 100.0).alias("stance"), F.lit(0.5).alias("confidence"), F.col("props").alias("rationale"),
    )
    return validate.check_votes(raw).select("event_id", F.array_join("reasons", ",").alias("reasons"))


def poststratified_baseline(spark: SparkSession, d: str) -> DataFrame:
    return rounded(smp.poststratified_baseline(_cells(spark, d), _party(spark, d), _blended(spark, d)))


# --- votes -----------------------------------------------------------------------------------

def yes_share(spark: SparkSession, d: str) -> DataFrame:
    return rounded(vot.yes_shares(_votes(spark, d), ["measure_id"]))


def opinion_change(spark: SparkSession, d: str) -> DataFrame:
    return rounded(vot.opinion_change(_votes(spark, d), ["measure_id"]))


def segment_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return rounded(vot.segment_breakdown(_votes(spark, d), fx.personas(spark, d), ["measure_id"]))


def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    return rounded(bootstrap_interval(_votes(spark, d), ["measure_id"], F.lit(42)))


def calibration(spark: SparkSession, d: str) -> DataFrame:
    shares = vot.yes_shares(_votes(spark, d), ["measure_id"])
    return rounded(vot.score_runs(shares, fx.truth(spark, d)))


def sensitivity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(vot.sensitivity(_scored_by_seed(spark, d)))


def multigroup(spark: SparkSession, d: str) -> DataFrame:
    """Groups beside the pooled result with its interval; some persona ids occur in two groups."""
    number = F.substring("persona_id", 2, 20).cast("bigint")
    shared = F.when(number % 10 == 1, F.concat(F.lit("p"), (number - 1).cast("string"))).otherwise(F.col("persona_id"))
    votes = _votes(spark, d).withColumn("persona_id", shared)
    interval = bootstrap_interval(votes, ["measure_id"], F.lit(42)).select(
        "measure_id", F.col("ci_low").alias("pooled_ci_low"), F.col("ci_high").alias("pooled_ci_high")
    )
    return rounded(vot.multigroup(votes, fx.truth(spark, d), interval))


def multigroup_segments(spark: SparkSession, d: str) -> DataFrame:
    """Pooled segments over all groups, keyed by the group's own persona ids."""
    votes = _votes(spark, d).withColumn("persona_id", F.concat_ws("/", "group_id", "persona_id"))
    people = fx.personas(spark, d).withColumn(
        "persona_id", F.concat_ws("/", F.col("draw_no") % 5, F.col("persona_id"))
    )
    return rounded(vot.segment_breakdown(votes, people, ["measure_id"], axes=["party_id", "education"]))


def backtest_summary(spark: SparkSession, d: str) -> DataFrame:
    """Every group of a measure is a run of its own."""
    run = ["measure_id", "group_id"]
    people = fx.personas(spark, d).groupBy("measure_id", (F.col("draw_no") % 5).cast("int").alias("group_id")).agg(
        F.count(F.lit(1)).alias("n_personas")
    )
    scored = _scored_by_seed(spark, d).join(people, run)
    return rounded(vot.backtest_summary(scored, _costs(spark, d), run))


def segment_error(spark: SparkSession, d: str) -> DataFrame:
    segments = vot.segment_breakdown(_votes(spark, d), fx.personas(spark, d), ["measure_id"])
    out = vot.segment_error(segments, fx.certified_segments(spark, d), ["measure_id"])
    return rounded(out.select("measure_id", "axis", "value", "n", "pred_yes_pct", "certified_yes_pct", "abs_error"))


def protected_segments(spark: SparkSession, d: str) -> DataFrame:
    segments = vot.segment_breakdown(_votes(spark, d), fx.personas(spark, d), ["measure_id"])
    return rounded(vot.protect_segments(segments, ["measure_id"]))


def uncertified_segments(spark: SparkSession, d: str) -> DataFrame:
    segments = vot.segment_breakdown(_votes(spark, d), fx.personas(spark, d), ["measure_id"])
    return vot.uncertified_segments(segments, fx.certified_segments(spark, d), ["measure_id"])


def model_divergence(spark: SparkSession, d: str) -> DataFrame:
    """Two models with several runs each: the groups with even and with odd numbers."""
    scored = _scored_by_seed(spark, d).withColumn("model", F.concat(F.lit("model-"), (F.col("group_id") % 2).cast("string")))
    return rounded(vot.model_divergence(scored))


def run_grid(spark: SparkSession, d: str) -> DataFrame:
    return cal.run_grid(fx.measure_definitions(spark, d), (1, 2, 3, 4, 5), n_groups=3)


# --- responses, policy, probes ---------------------------------------------------------------

def parse_votes(spark: SparkSession, d: str) -> DataFrame:
    parsed = parsing.parse_votes(fx.vote_responses(spark, d), "response")
    return rounded(parsed.drop("response"))


def parse_critic(spark: SparkSession, d: str) -> DataFrame:
    return parsing.parse_critics(fx.critic_responses(spark, d), "response").drop("response")


def parse_probe(spark: SparkSession, d: str) -> DataFrame:
    parsed = parsing.parse_probes(fx.probes(spark, d), "response")
    return rounded(parsed.drop("response", "actual_yes_pct"))


def strip_fences(spark: SparkSession, d: str) -> DataFrame:
    """Documents as they are, fenced in full, half fenced, and fenced on one line."""
    doc, body = F.col("doc_id"), F.col("text")
    fenced = (
        F.when(doc % 4 == 0, F.concat(F.lit(" ```json\n"), body, F.lit("\n``` ")))
        .when(doc % 4 == 1, F.concat(F.lit("```\n"), body))
        .when(doc % 4 == 2, F.concat(F.lit("```"), F.replace(body, F.lit("\n"), F.lit(" ")), F.lit("```")))
        .otherwise(body)
    )
    return fx.table(spark, d, "documents").select(
        "doc_id", F.md5(parsing.strip_fences(fenced).cast("binary")).alias("stripped_md5")
    )


def contamination_flags(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cal.contamination(fx.probes(spark, d)).select(
        "measure_id", "seed", "knows", "yes_pct", "actual_yes_pct", "recall_error", "flag"))


def policy_input(spark: SparkSession, d: str) -> DataFrame:
    found = policy.with_first_match(fx.requests(spark, d), "text", policy.REQUEST, "pattern_no")
    return found.select("request_id", F.coalesce("pattern_no", F.lit(0)).alias("pattern_no"))


def policy_window(spark: SparkSession, d: str) -> DataFrame:
    as_of = F.lit("2024-02-01").cast("date")
    return policy.check_requests(fx.requests(spark, d), as_of).select("request_id", "refused", "reason")


def policy_output(spark: SparkSession, d: str) -> DataFrame:
    return policy.gate_output(fx.report_texts(spark, d), "text").select(
        "doc_id", F.char_length("text").cast("bigint").alias("n_chars")
    )


# --- transcripts -----------------------------------------------------------------------------

def recent_context(spark: SparkSession, d: str) -> DataFrame:
    out = transcripts.recent_context(fx.statements(spark, d), ["run_id"])
    return out.withColumn("context_md5", F.md5(F.col("context").cast("binary"))).drop("context")


def final_context(spark: SparkSession, d: str) -> DataFrame:
    out = transcripts.final_context(fx.statements(spark, d), ["run_id"])
    return out.withColumn("context_md5", F.md5(F.col("context").cast("binary"))).drop("context")


def ablated_context(spark: SparkSession, d: str) -> DataFrame:
    out = transcripts.ablated_context(fx.statements(spark, d), ["run_id"])
    return out.withColumn("context_md5", F.md5(F.col("context").cast("binary"))).drop("context")


def statement_counts(spark: SparkSession, d: str) -> DataFrame:
    return transcripts.statement_counts(fx.statements(spark, d), ["run_id"])


def next_speakers(spark: SparkSession, d: str) -> DataFrame:
    return transcripts.next_speakers(fx.roster(spark, d), fx.statements(spark, d), ["run_id"])


def speaker_influence(spark: SparkSession, d: str) -> DataFrame:
    out = transcripts.speaker_influence(
        fx.baseline(spark, d), fx.counterfactual(spark, d), fx.run_statements(spark, d), ["run_id"], strict=False
    )
    return transcripts.ranked_influence(rounded(out), ["run_id"])


# --- spend -----------------------------------------------------------------------------------

def unknown_models(spark: SparkSession, d: str) -> DataFrame:
    return spend.unknown_models(fx.calls(spark, d), spend.price_table(spark))


def spend_by_model(spark: SparkSession, d: str) -> DataFrame:
    return rounded(spend.spend_by_model(_priced(spark, d)).withColumn("usd", F.col("usd").cast("double")), 9)


def budget_cap(spark: SparkSession, d: str) -> DataFrame:
    used = spend.budget_use(_priced(spark, d), ["run_id"], CAP_USD)
    return rounded(
        used.select("run_id", "seq", F.col("usd").cast("double").alias("usd"),
                    F.col("running_usd").cast("double").alias("running_usd"), "allowed", "breach", "unpriced"), 9
    )


def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


def model_stamp(spark: SparkSession, d: str) -> DataFrame:
    return spend.model_stamp(fx.calls(spark, d), ["run_id"], "gemini")


def retry_classes(spark: SparkSession, d: str) -> DataFrame:
    classified = spend.classify_failures(fx.calls(spark, d)).fillna(MISSING, ["status"])
    return classified.select("run_id", "seq", "status", "retryable", "delay_s")


QUERIES: dict[str, Query] = {
    "scan_microdata": scan_microdata,
    "scan_national": scan_national,
    "readable_microdata": readable_microdata,
    "unreadable_microdata": unreadable_microdata,
    "national_load": national_load,
    "scan_survey_labels": scan_survey_labels,
    "scan_survey_coded": scan_survey_coded,
    "recode_census": recode_census,
    "state_lookup": state_lookup,
    "weighted_cells": cells_query,
    "k_anon_pool": k_anon_pool,
    "k_anon_pool_state": k_anon_pool_state,
    "replace_state": replace_state,
    "replace_table": replace_table,
    "source_versions_latest": source_versions_latest,
    "source_versions_map": source_versions_map,
    "measures": measures,
    "list_measures": list_measures,
    "run_artifact": run_artifact,
    "explode_artifact": explode_artifact,
    "explode_artifact_statements": explode_artifact_statements,
    "explode_artifact_personas": explode_artifact_personas,
    "recode_survey_coded": survey_coded_recode,
    "recode_survey_labels": survey_labels_recode,
    "priors_coded": priors_coded,
    "priors_labels": priors_labels,
    "party_backoff": party_backoff,
    "priors_blended": priors_blended,
    "sample_cells": sample_cells,
    "empty_scopes": empty_scopes,
    "party_draw": party_draw,
    "persona_priors": persona_priors,
    "persona_id": persona_id,
    "personas": personas,
    "sample_composition": sample_composition,
    "prompt_rows": prompt_rows,
    "briefing_prompts": briefing_prompts,
    "vote_prompts": vote_prompts,
    "deliberation_prompts": deliberation_prompts,
    "critic_prompts": critic_prompts,
    "probe_prompts": probe_prompts,
    "prompt_segments": prompt_segments,
    "validate_personas": validate_personas,
    "validate_votes": validate_votes,
    "poststratified_baseline": poststratified_baseline,
    "yes_share": yes_share,
    "opinion_change": opinion_change,
    "segment_breakdown": segment_breakdown,
    "bootstrap_ci": bootstrap_ci,
    "calibration": calibration,
    "sensitivity": sensitivity,
    "multigroup": multigroup,
    "multigroup_segments": multigroup_segments,
    "backtest_summary": backtest_summary,
    "segment_error": segment_error,
    "protected_segments": protected_segments,
    "uncertified_segments": uncertified_segments,
    "model_divergence": model_divergence,
    "run_grid": run_grid,
    "parse_votes": parse_votes,
    "parse_critic": parse_critic,
    "parse_probe": parse_probe,
    "strip_fences": strip_fences,
    "contamination_flags": contamination_flags,
    "policy_input": policy_input,
    "policy_window": policy_window,
    "policy_output": policy_output,
    "recent_context": recent_context,
    "final_context": final_context,
    "ablated_context": ablated_context,
    "statement_counts": statement_counts,
    "next_speakers": next_speakers,
    "speaker_influence": speaker_influence,
    "unknown_models": unknown_models,
    "spend_by_model": spend_by_model,
    "budget_cap": budget_cap,
    "token_estimates": token_estimates,
    "model_stamp": model_stamp,
    "retry_classes": retry_classes,
}
