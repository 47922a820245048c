"""The library's input tables, derived from the driver's tables by plain arithmetic.

Every view is deterministic and grows with the tables it reads; none depends on row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from censemble.functions import fixed

# Nation numbers 0..24 as census codes; 72 is a territory outside the state map.
NATION_FIPS = [1, 2, 4, 5, 6, 8, 9, 10, 11, 12, 13, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25, 26, 53, 72]
RUNS = ["click", "error", "purchase", "signup", "view"]
MODELS = [
    "gemini-2.5-flash-lite", "gemini-2.5-flash", "gemini-2.5-pro", "gemini-2.0-flash", "gemma-3-1b-it",
    "unlisted-model",
]
PARTY_ANSWERS = [*fixed.PARTY_LABELS, "Not sure", "Other party"]
EDUCATION_ANSWERS = [*fixed.EDUCATION_LABELS, "Trade school"]
IDEOLOGY_ANSWERS = [*fixed.IDEOLOGY_HALF_POINTS, "Not sure", None]
REQUEST_PLANTS = [
    "please predict the next ballot", "a forecast for that vote", "write persuasive messaging",
    "generate some messaging", "how do we win over people", "targeting every audience",
    "voter suppression", "campaign tactics", "optimize the message",
]
OUTPUT_PLANTS = [
    "a messaging recommendation", "suggested talking points", "the campaign should act",
    "to persuade those voters", "the probability of passage is high",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(items: list, index: Column) -> Column:
    """0-based pick from a literal list."""
    return F.element_at(F.array(*[F.lit(x) for x in items]), (index + 1).cast("int"))


def _div(column: str, by: int) -> Column:
    return F.floor(F.col(column) / by).cast("bigint")


def microdata(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    joined = lines.join(suppliers, lines["l_suppkey"] == suppliers["s_suppkey"])
    supp = F.col("l_suppkey")
    return joined.select(
        pick(NATION_FIPS, F.col("s_nationkey")).alias("ST"),
        F.when(supp % 50 != 0, 200 + supp).cast("int").alias("PUMA10"),
        F.when(supp % 10 == 0, -9).otherwise(100 + supp).cast("int").alias("PUMA20"),
        (F.col("l_partkey") % 95).cast("int").alias("AGEP"),
        (1 + F.col("l_linenumber") % 2).cast("int").alias("SEX"),
        (1 + F.col("l_partkey") % 9).cast("int").alias("RAC1P"),
        (1 + (F.col("l_orderkey") % 6 == 0).cast("int")).alias("HISP"),
        F.when(F.col("l_orderkey") % 97 != 0, 1 + F.col("l_orderkey") % 24).cast("int").alias("SCHL"),
        F.when(F.col("l_partkey") % 89 != 0, F.col("l_extendedprice") * 2).alias("PINCP"),
        F.col("l_quantity").cast("int").alias("PWGTP"),
    )


def survey_coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = fixed.CODED_SURVEY
    school = F.col("o_orderkey") % 100
    race = F.col("o_custkey") % 100
    columns = {
        "party": F.col("o_custkey") % 9,
        "education": F.when(school == 0, 1).when(school < 40, 2).when(school < 70, 3)
        .when(school < 90, 4).when(school < 98, 5).otherwise(-9),
        "age": 15 + (F.col("o_custkey") * 7) % 75,
        "ideology": _div("o_custkey", 3) % 9,
        "climate": _div("o_orderkey", 3) % 4,
        "guns": _div("o_custkey", 5) % 4,
        "taxes": _div("o_orderkey", 11) % 4,
        "race": F.when(race < 60, 1).when(race < 75, 2).when(race < 90, 3).when(race < 97, 4)
        .when(race == 97, 5).when(race == 98, 6).otherwise(-8),
    }
    return table(spark, sf_dir, "orders").select(
        *[c.cast("double").alias(names[k]) for k, c in columns.items()]
    )


def survey_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = fixed.LABEL_SURVEY
    columns = {
        "party": pick(PARTY_ANSWERS, F.col("o_custkey") % 9),
        "education": pick(EDUCATION_ANSWERS, F.col("o_orderkey") % 7),
        "birthyear": F.when(F.col("o_orderkey") % 61 == 0, "n/a").otherwise(
            (1930 + F.col("o_custkey") % 80).cast("string")
        ),
        "ideology": pick(IDEOLOGY_ANSWERS, _div("o_custkey", 3) % 7),
        "climate": pick(["Support", "Oppose", "Not sure", None], _div("o_orderkey", 3) % 4),
        "guns": pick(["For", "Against", "Skipped"], _div("o_custkey", 5) % 3),
        "taxes": pick(["For", "Against", "Not sure"], _div("o_orderkey", 11) % 3),
    }
    return table(spark, sf_dir, "orders").select(*[c.alias(names[k]) for k, c in columns.items()])


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events before mid-January as round 0 and all others as final votes, however many a user has."""
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("wa_"), F.col("event_type")).alias("measure_id"),
        (F.col("user_id") % 5).cast("int").alias("group_id"),
        F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("persona_id"),
        F.col("event_id").alias("seq"),
        F.when(early, 0).otherwise(6).alias("round"),
        F.least(F.lit(1.0), F.col("value") / 100.0).alias("stance"),
        ((F.col("event_id") % 100) / 100.0).alias("confidence"),
    )


def personas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axes of everyone who took part in a run. Users 0, 50, 100, ... form a small segment."""
    user = F.col("user_id")
    taking_part = table(spark, sf_dir, "events").select("event_type", "user_id").distinct()
    other_races = [r for r in fixed.RACES if r != "asian_nh"]
    return taking_part.select(
        F.concat(F.lit("wa_"), F.col("event_type")).alias("measure_id"),
        F.concat(F.lit("p"), user.cast("string")).alias("persona_id"),
        user.alias("draw_no"),
        pick(fixed.PARTIES, user % 3).alias("party_id"),
        pick(fixed.AGE_BANDS, user % 4).alias("age_band"),
        pick(fixed.EDUCATIONS, user % 5).alias("education"),
        F.when(user % 50 == 0, "asian_nh").otherwise(pick(other_races, user % 4)).alias("race_eth"),
    )


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A made-up certified result per run, from the number of its events.

    One row per event type, so it is broadcast: by its input Spark takes it for large, and would shuffle all votes to join it.
    """
    yes = 30.0 + (F.col("n") % 400) / 10.0
    known = (
        table(spark, sf_dir, "events")
        .groupBy("event_type")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            F.concat(F.lit("wa_"), F.col("event_type")).alias("measure_id"),
            F.lit(fixed.DEFAULT_ROUNDS).alias("n_rounds"),
            yes.alias("yes_pct"),
            (yes > 50.0).alias("passed"),
        )
    )
    return F.broadcast(known)


def certified_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A made-up certified result per run and party, from the number of its events."""
    yes = 20.0 + (F.col("n") % 600) / 10.0
    return (
        table(spark, sf_dir, "events")
        .groupBy("event_type", (F.col("user_id") % 3).alias("party"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            F.concat(F.lit("wa_"), F.col("event_type")).alias("measure_id"),
            F.lit("party_id").alias("axis"),
            pick(fixed.PARTIES, F.col("party")).alias("value"),
            yes.alias("certified_yes_pct"),
        )
    )


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("run_id"),
        F.col("turn").alias("seq"),
        F.when(F.col("role") == "system", fixed.MODERATOR)
        .otherwise(F.concat(F.col("role"), (F.col("turn") % 3).cast("string"))).alias("speaker_id"),
        (1 + _div("turn", 2)).cast("int").alias("round"),
        "text",
        (F.char_length("text") % 5 == 0).alias("flagged"),
    )


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six seats per conversation."""
    seats = [f"{role}{i}" for role in ("assistant", "user") for i in range(3)]
    runs = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run_id")).distinct()
    return runs.select("run_id", F.posexplode(F.array(*[F.lit(s) for s in seats])).alias("draw_no", "persona_id"))


def run_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations dealt out over the five runs, nine voices in each."""
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("wa_"), pick(RUNS, F.col("conv_id") % 5)).alias("run_id"),
        (F.col("conv_id") * 100 + F.col("turn")).alias("seq"),
        F.when(F.col("role") == "system", fixed.MODERATOR)
        .otherwise(F.concat(F.lit("s"), ((F.col("conv_id") + F.col("turn")) % 9).cast("string"))).alias("speaker_id"),
        (F.char_length("text") % 5 == 0).alias("flagged"),
    )


def _event_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("wa_"), F.col("event_type")).alias("run_id"),
        F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("persona_id"),
        F.col("event_id").alias("seq"),
        F.least(F.lit(1.0), F.col("value") / 100.0).alias("stance"),
        (F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")).alias("early"),
    )


def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes with the full context: the events before mid-January."""
    return _event_votes(spark, sf_dir).where("early").select("run_id", "persona_id", "seq", "stance")


def counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes with one of seven speakers left out: the events from mid-January on."""
    return _event_votes(spark, sf_dir).where("not early").select(
        "run_id", F.concat(F.lit("s"), (F.col("seq") % 7).cast("string")).alias("speaker_id"), "persona_id", "stance"
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    status = pick([200, 400, 404, 408, 429, 503, None], doc % 7).cast("int")
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("wa_"), pick(RUNS, doc % 5)).alias("run_id"),
        doc.alias("seq"),
        pick(MODELS, F.floor(doc / 5) % 6).alias("model"),
        F.greatest(F.lit(1).cast("bigint"), _div("n_chars", 4)).alias("in_tok"),
        F.greatest(F.lit(1).cast("bigint"), _div("n_chars", 16)).alias("out_tok"),
        status.alias("status"),
        F.when(doc % 7 == 4, F.concat(F.lit("quota reached, retry_delay { seconds: "), (doc % 30).cast("string"), F.lit(" }")))
        .when(doc % 7 == 0, None).otherwise("call failed").alias("error"),
    )


def vote_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vote responses around the number in ``props``, with the usual malformed kinds mixed in."""
    k = F.lpad(F.regexp_extract("props", r"(\d+)", 1), 2, "0")

    def around(before: str, after: str) -> Column:
        return F.concat(F.lit(before), k, F.lit(after))

    kinds = [
        around('{"stance": 0.', ', "confidence": 0.7, "rationale": "because"}'),
        around('```json\n{"stance": 0.', ', "confidence": 0.25, "rationale": "fenced"}\n```'),
        around('{"stance": "0.', '", "confidence": 1, "rationale": "text number"}'),
        F.lit("{}"),
        around("not json 0.", ""),
        F.lit('{"stance": null, "confidence": 0.5}'),
        around('{"stance": true, "confidence": 0.', "}"),
        F.lit('{"stance": 1.5, "confidence": 0.5, "rationale": "too high"}'),
        around('{"stance": 0.', "} and more"),
        around('{"stance": 0.', ', "rationale": ""}'),
        around('{"stance": -0.', ', "confidence": 0.5, "rationale": "too low"}'),
        F.concat(F.lit('{"stance": 0.5, "confidence": 0.'), k, F.lit(', "rationale": "'),
                 F.repeat(F.concat(k, F.lit(" words ")), 100), F.lit('"}')),
    ]
    kind = F.col("event_id") % len(kinds)
    chosen = F.lit(None).cast("string")
    for i, text in reversed(list(enumerate(kinds))):
        chosen = F.when(kind == i, text).otherwise(chosen)
    return table(spark, sf_dir, "events").select("event_id", chosen.alias("response"))


def critic_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact-check response per document, its text in every kind that can hold it."""
    doc = F.col("doc_id")
    quoted = F.regexp_replace("text", r'[\\"\x00-\x1f]', " ")
    response = (
        F.when(doc % 6 == 0, F.concat(F.lit('{"flagged": true, "note": "'), quoted, F.lit('"}')))
        .when(doc % 6 == 1, F.concat(F.lit('{"flagged": false, "source": "'), quoted, F.lit('", "note": ""}')))
        .when(doc % 6 == 2, F.concat(F.lit("no JSON at all: "), quoted))
        .when(doc % 6 == 3, F.concat(F.lit('```\n{"flagged": true, "note": "doc '), doc.cast("string"), F.lit(" "), quoted, F.lit('"}\n```')))
        .when(doc % 6 == 4, F.concat(F.lit('{"note": "'), quoted, F.lit('"}')))
        .otherwise(F.concat(F.lit('{"flagged": true} '), quoted))
    )
    return table(spark, sf_dir, "documents").select("doc_id", response.alias("response"))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    actual = 30 + doc % 40
    recalled = (actual + _div("doc_id", 6) % 25).cast("string")
    response = (
        F.when(doc % 6 == 0, F.concat(F.lit('{"knows": true, "yes_pct": '), recalled, F.lit(', "confidence": 0.9, "note": "recalled"}')))
        .when(doc % 6 == 1, '{"knows": false, "yes_pct": null, "confidence": 0.1, "note": "unsure"}')
        .when(doc % 6 == 2, "I would rather not say")
        .when(doc % 6 == 3, '{"knows": true, "yes_pct": null}')
        .when(doc % 6 == 4, F.concat(F.lit('{"knows": true, "yes_pct": "'), recalled, F.lit('", "confidence": 0.5}')))
        .otherwise(F.concat(F.lit('```json\n{"knows": true, "yes_pct": '), recalled, F.lit(', "confidence": 0.2, "note": "fenced"}\n```')))
    )
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("wa_m"), doc.cast("string")).alias("measure_id"),
        (doc % 5).cast("int").alias("seed"),
        response.alias("response"),
        actual.cast("double").alias("actual_yes_pct"),
    )


def _planted(plants: list[str]) -> Column:
    """The whole document text, followed by one of the plants in some rows."""
    at = F.col("doc_id") % (2 * len(plants) + 1)
    return F.when(at < len(plants), F.concat(F.col("text"), F.lit(" "), pick(plants, F.least(at, F.lit(len(plants) - 1))))).otherwise(F.col("text"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("request_id"),
        _planted(REQUEST_PLANTS).alias("text"),
        F.when(F.col("doc_id") % 11 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 200).cast("int"))).alias("vote_date"),
    )


def report_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", _planted(OUTPUT_PLANTS).alias("text"))


def measure_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One definition per document, with the document as framing and parts left out by turns."""
    doc = F.col("doc_id")
    yes = (30 + doc % 40).cast("double")
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("wa_m"), doc.cast("string")).alias("measure_id"),
        F.concat(F.lit("Measure "), doc.cast("string")).alias("title"),
        (2000 + doc % 24).cast("int").alias("year"),
        F.lit("WA").alias("state"),
        F.col("lang").alias("topic"),
        F.when(doc % 5 != 0, F.struct(
            yes.alias("yes_pct"),
            F.when(doc % 3 != 0, 100.0 - yes).alias("no_pct"),
            F.when(doc % 7 != 0, yes > 50.0).alias("passed"),
        )).alias("ground_truth"),
        F.lit(None).cast("map<string,map<string,double>>").alias("segment_results"),
        F.concat(F.lit("  "), F.col("text"), F.lit(" \n")).alias("framing"),
        F.concat(F.lit("\n"), F.col("source"), F.lit(" ")).alias("briefing"),
        F.when(doc % 3 != 0, F.array("source", "lang")).alias("briefing_sources"),
        F.when(doc % 4 != 0, F.array(F.concat(F.lit("for "), F.col("lang")))).alias("pro_arguments"),
        F.when(doc % 2 != 0, F.array(F.concat(F.lit("against "), F.col("source")), F.lit("cost"))).alias("con_arguments"),
        F.when(doc % 4 != 0, 3 + doc % 4).cast("int").alias("n_rounds"),
    )


def specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One population per customer nation, as large as its number of customers; some national."""
    nation = F.col("c_nationkey")
    return (
        table(spark, sf_dir, "customer")
        .groupBy("c_nationkey")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            nation.alias("spec_id"),
            F.when(nation % 5 == 0, "US").when(nation % 5 == 1, "*")
            .otherwise(pick([fixed.FIPS_STATES.get(f, "US") for f in NATION_FIPS], nation)).alias("state"),
            "n",
            (nation + 42).cast("int").alias("seed"),
        )
    )


def version_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loader versions over time: a version row per event."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("source_name"),
        F.concat(F.lit("v"), (F.col("event_id") % 50).cast("string")).alias("version"),
        F.col("ts").alias("loaded_at"),
    )
