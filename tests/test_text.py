"""Parsing, policy, formatting, call log and validation."""

import json
import math
import random
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from censemble.functions import fixed, parsing, policy, text
from censemble.operators import validate
from censemble.operators import calibration as cal
from censemble.operators import spend, validate


def one(spark, fn, value):
    return fn(spark.createDataFrame([(value,)], "t string"), "t").first()


@pytest.mark.parametrize("response, stance, confidence, rationale", [
    ("{}", 0.5, 0.5, ""),
    ("not json", 0.5, 0.3, fixed.UNPARSEABLE_VOTE),
    ('```json\n{"stance": 0.7, "confidence": 0.2, "rationale": "x"}\n```', 0.7, 0.2, "x"),
    ('{"stance": "0.7"}', 0.7, 0.5, ""), ('{"stance": null}', 0.5, 0.3, fixed.UNPARSEABLE_VOTE),
    ('{"stance": true}', 1.0, 0.5, ""), ('{"stance": 1.5}', 1.0, 0.5, ""), ('{"stance": NaN}', 1.0, 0.5, ""),
    ('{"stance": NaN, "rationale": "score: NaN, so"}', 1.0, 0.5, "score: NaN, so"),
    ('{"rationale": "x, \\"stance\\": NaN, y", "confidence": Infinity}', 0.5, 1.0, 'x, "stance": NaN, y'),
    ('{"stance": -Infinity}', 0.0, 0.5, ""), ('{"stance": 0.4, "rationale": "a: NaN, b"}', 0.4, 0.5, "a: NaN, b"),
    ('{"stance": 0.4} trailing', 0.5, 0.3, fixed.UNPARSEABLE_VOTE), ('{"stance": 0.4} x}', 0.5, 0.3, fixed.UNPARSEABLE_VOTE),
    ('{"a": 1},{"b": 2}', 0.5, 0.3, fixed.UNPARSEABLE_VOTE), ('{"a": 1}]', 0.5, 0.3, fixed.UNPARSEABLE_VOTE),
    ('{"a": 1}}', 0.5, 0.3, fixed.UNPARSEABLE_VOTE), ("[1]", 0.5, 0.3, fixed.UNPARSEABLE_VOTE),
    ('{"stance": "1f"}', 0.5, 0.3, fixed.UNPARSEABLE_VOTE), ('{"stance": " 1_0e-1 "}', 1.0, 0.5, ""),
    ("{'stance': 0.2}", 0.5, 0.3, fixed.UNPARSEABLE_VOTE), ('{"rationale": null}', 0.5, 0.5, "None"),
    ('{"rationale": false, "confidence": "nan"}', 0.5, 1.0, "False"), (None, 0.5, 0.3, fixed.UNPARSEABLE_VOTE),
    ('{"rationale": "' + "w" * 700 + '"}', 0.5, 0.5, "w" * 600), ("\u00a0{}\u2003", 0.5, 0.5, ""),
])
def test_parse_votes(spark, response, stance, confidence, rationale):
    row = one(spark, parsing.parse_votes, response)
    assert (row.stance, row.confidence, row.rationale) == (stance, confidence, rationale)


@pytest.mark.parametrize("response, flagged, note", [
    ('{"flagged": true, "note": "n"}', True, "n"), ('{"flagged": "false", "note": ""}', True, None), ('{"flagged": 0}', False, None),
    ('{"flagged": []}', False, None), ('{"flagged": [0], "note": null}', True, "None"), ("x", False, None), ('{"flagged": {}}', False, None),
    ('{"flagged": null, "note": "' + "n" * 400 + '"}', False, "n" * 300),
])
def test_parse_critics(spark, response, flagged, note):
    row = one(spark, parsing.parse_critics, response)
    assert (row.flagged, row.note) == (flagged, note)


@pytest.mark.parametrize("response, expected", [
    ('{"knows": true, "yes_pct": 43.4, "confidence": 0.9, "note": "n"}', (True, 43.4, 0.9, "n")),
    ('{"knows": true, "yes_pct": null}', (True, None, 0.0, "")),
    ('{"knows": true, "yes_pct": "x", "confidence": 0.4}', (True, None, 0.0, fixed.UNPARSEABLE_PROBE)),
    ('{"knows": true, "yes_pct": "40", "confidence": "q"}', (True, 40.0, 0.0, fixed.UNPARSEABLE_PROBE)),
    ("x", (False, None, 0.0, fixed.UNPARSEABLE_PROBE)), ('{"knows": false}', (False, None, 0.0, "")),
])
def test_parse_probes(spark, response, expected):
    row = one(spark, parsing.parse_probes, response)
    assert (row.knows, row.yes_pct, row.confidence, row.note) == expected


@pytest.mark.parametrize("raw, expected", [
    ("```json\n{}\n```", "{}"), ("```{}```", "{}"), ("```", ""), (" {} ", "{}"), ("```\na```b```", "a```b"), ("a```", "a"), ("", ""),
])
def test_strip_fences(spark, raw, expected):
    assert one(spark, lambda d, c: d.select(parsing.strip_fences(F.col(c)).alias("x")), raw).x == expected


@pytest.mark.parametrize("known, recalled, flag", [
    (True, 52.0, "HIGH"), (True, 55.0, "HIGH"), (True, 60.0, "MODERATE"), (True, 65.0, "MODERATE"), (True, 80.0, "LOW"),
    (False, 50.0, "NONE"), (True, None, "NONE"), (True, float("nan"), "LOW"),
])
def test_contamination_flags(spark, known, recalled, flag):
    response = json.dumps({"knows": known, "yes_pct": recalled})
    df = spark.createDataFrame([(response, 50.0)], "response string, actual_yes_pct double")
    assert cal.contamination(df).first().flag == flag


AS_OF = date(2024, 3, 1)


@pytest.mark.parametrize("request_text, days, reason", [
    ("Predict the election outcome for the upcoming senate race.", None, "category"),
    ("Generate persuasive messaging targeted at suburban women.", None, "category"),
    ("How do we convert young rural voters to support this policy?", None, "category"),
    ("Should the state implement a carbon pollution fee on large emitters?", None, None),
    ("This is a neutral framing.", 30, "vote_window"), ("This is a neutral framing.", 365, None),
    ("This is a neutral framing.", 0, "vote_window"), ("This is a neutral framing.", 60, "vote_window"),
    ("This is a neutral framing.", 61, None), ("This is a neutral framing.", -1, None),
    ("x" * 30_000 + " voter suppression", None, "category"), ("\u00e9predict the vote", None, None),
    (None, None, None),
])
def test_requests(spark, request_text, days, reason):
    when = AS_OF + timedelta(days=days) if days is not None else None
    df = spark.createDataFrame([(request_text, when)], "text string, vote_date date")
    row = policy.check_requests(df, F.lit(AS_OF)).first()
    assert row.reason == reason and row.refused == (reason is not None)


PROBES = [
    "predict a ballot", "we forecast the vote", "persuasive message", "generate the messaging", "how can i persuade",
    "targeted at a demographic", "voter microtargeting", "campaign strategy", "optimize our persuasion",
]


def test_every_pattern_is_found_and_needs_its_anchor(spark):
    df = spark.createDataFrame([(i, f"So, {t.upper()}!") for i, t in enumerate(PROBES, start=1)], "i int, text string")
    rows = policy.with_first_match(df, "text", policy.REQUEST, "found").collect()
    assert [r.found for r in rows] == [r.i for r in rows]


def test_output_gate(spark):
    texts = ["Here is a messaging recommendation for the campaign", "suggested talking points", "The campaign should act",
             "to persuade these voters", "the probability of passing is 3", "Predicted yes-share: 47%. Notes follow."]
    kept = policy.gate_output(spark.createDataFrame([(t,) for t in texts], "text string"), "text").collect()
    assert [r.text for r in kept] == texts[-1:]


def test_two_digits_like_exact_rounding(spark):
    rng = random.Random(8)
    values = [0.125, 0.375, 0.575, 0.285, 0.565, 0.005, 0.015, 1.0, 0.0, -0.125, -1.0, 0.995, -0.001, 0.135, 1e-9]
    values += [rng.uniform(-1, 1) for _ in range(300)] + [i / 200 for i in range(-200, 200)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    rows = df.select("x", text.two_digits(F.col("x")).alias("plain"), text.two_digits(F.col("x"), True).alias("signed")).collect()
    for r in rows:
        assert r.plain == f"{r.x:.2f}" and r.signed == f"{r.x:+.2f}"


def test_templates_and_lines(spark):
    df = spark.createDataFrame([(["a", "b"], "T", [])], "xs array<string>, t string, none array<string>")
    out = df.select(
        text.fill_template('{t}:\n{xs}\n{{"k": {none}}}', t=F.col("t"), xs=text.bullets(F.col("xs")), none=text.bullets(F.col("none"))).alias("p")
    ).first().p
    assert out == 'T:\n- a\n- b\n{"k": }'


@pytest.mark.parametrize("raw, bare, full", [("i502", "i502", "wa_i502"), ("wa_i502", "i502", "wa_i502"), ("wa_wa_x", "x", "wa_wa_x")])
def test_measure_ids(spark, raw, bare, full):
    row = spark.createDataFrame([(raw,)], "m string").select(text.bare_measure_id(F.col("m")).alias("b"), text.full_measure_id(F.col("m")).alias("f")).first()
    assert (row.b, row.f) == (bare, full)


@pytest.mark.parametrize("status, error, again, delay", [
    (429, "retry_delay { seconds: 12 }", True, 12.0), (503, "x", True, None), (408, None, True, None), (400, "no", False, None),
    (404, "", False, None), (None, "seconds:3", True, 3.0), (200, None, False, None),
])
def test_retry_classes(spark, status, error, again, delay):
    row = spend.classify_failures(spark.createDataFrame([(status, error)], "status int, error string")).first()
    assert (row.retryable, row.delay_s) == (again, delay)


CALLS = "run_id string, seq long, model string, in_tok long, out_tok long"


def test_prices_and_cap(spark):
    rows = [("r", i, "gemini-2.5-pro", 400_000, 100_000) for i in range(6)] + [("s", 0, "gemma-3-1b-it", 9, 9), ("s", 1, "who", 1, 1)]
    calls = spark.createDataFrame(rows, CALLS)
    prices = spend.price_table(spark)
    with pytest.raises(Exception, match="model without a price: who"):
        spend.spend_by_model(spend.priced_calls(calls, prices)).collect()
    priced = spend.priced_calls(calls, prices, strict=False)
    assert priced.count() == 8
    assert {r.usd for r in priced.where("run_id = 'r'").collect()} == {Decimal("1.5")}
    for bits in (1, 20):
        used = spend.budget_use(priced, ["run_id"], "4.5", bits).where("run_id = 'r'").orderBy("seq").collect()
        assert [r.running_usd for r in used] == [Decimal("1.5") * (i + 1) for i in range(6)]
        # At the cap is not above it: the fourth call is charged and stops the run.
        assert [r.allowed for r in used] == [True] * 4 + [False] * 2
        assert [r.breach for r in used] == [False] * 3 + [True] + [False] * 2
    assert [tuple(r) for r in spend.unknown_models(calls, prices).collect()] == [("who", 1)]
    with pytest.raises(ValueError, match="who"):
        spend.require_priced(calls, prices)
    marked = spend.budget_use(priced, ["run_id"], "4.5").where("run_id = 's'").orderBy("seq").collect()
    assert [(r.unpriced, r.usd is None, r.allowed) for r in marked] == [(False, False, True), (True, True, True)]
    total = {(r.run_id, r.model): r for r in spend.spend_by_model(priced).collect()}
    assert total["s", "who"].unpriced_calls == total[None, None].unpriced_calls == 1 and total["s", "who"].usd is None
    assert total["r", None].usd == Decimal(9) and total[None, None].calls == 8 and total["r", "gemini-2.5-pro"].in_tok == 2_400_000


def test_model_stamp(spark):
    df = spark.createDataFrame([("r", "b"), ("r", "a"), ("r", "b"), ("s", "c")], "run string, model string")
    assert {r.run: r.stamp for r in spend.model_stamp(df, ["run"], "gemini").collect()} == {"r": "gemini:a+b", "s": "gemini:c"}


@pytest.mark.parametrize("value, tokens", [("", 1), ("abc", 1), ("abcd" * 5, 5), ("\u00e9" * 9, 2)])
def test_token_estimate(spark, value, tokens):
    assert spark.createDataFrame([(value,)], "t string").select(text.token_estimate(F.col("t")).alias("n")).first().n == tokens


def test_vote_checks(spark):
    rows = [("a", 0, 0.5, 0.5, "x"), ("b", 0, 1.5, float("nan"), "x"), (None, None, 0.0, 1.0, None)]
    df = spark.createDataFrame(rows, "persona_id string, round int, stance double, confidence double, rationale string")
    got = [r.reasons for r in validate.check_votes(df).collect()]
    assert got == [[], ["stance", "confidence"], ["persona_id", "round", "rationale"]]
    assert math.isnan(rows[1][3])


def test_run_grid(spark):
    grid = cal.run_grid(spark.createDataFrame([("m",)], "measure_id string"), (1, 5), 2).collect()
    assert sorted((r.seed, r.group_id, r.run_seed) for r in grid) == [(1, 0, 1), (1, 1, 2), (5, 0, 5), (5, 1, 6)]


def test_places_that_break_the_contract(spark):
    rows = [("a", 0), ("a", 1), ("a", 1), ("a", -1), ("b", 1 << 40), ("b", None), ("c", 5)]
    found = validate.check_places(spark.createDataFrame(rows, "run string, seq long"), ["run"]).collect()
    assert {(r.run, r.seq, r.n, tuple(r.reasons)) for r in found} == {
        ("a", 1, 2, ("repeated",)), ("a", -1, 1, ("range",)), ("b", 1 << 40, 1, ("range",)), ("b", None, 1, ("range",))}
