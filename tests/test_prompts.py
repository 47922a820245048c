"""Prompt stores: every text once, and the same prompts as by filling templates in Python."""

import pytest
from pyspark.sql import functions as F

from censemble.operators import prompts as prm

SYSTEM, VOTE = "{{role}}\n{backstory}!", 'On {framing}: {{"stance": 0.5}}'
PEOPLE = [("r1", f"p{i}", i, f"story {i % 3}") for i in range(9)] + [("r2", "p1", 0, None), ("r2", "p1", 1, "")]
MEASURES = [("r1", "schools?", 5, ["a", "b"]), ("r2", "roads?", 3, None)]


@pytest.fixture(scope="module")
def frames(spark):
    return (
        spark.createDataFrame(PEOPLE, "run string, persona_id string, draw_no int, backstory string"),
        spark.createDataFrame(MEASURES, "run string, framing string, n_rounds int, briefing_sources array<string>"),
        spark.createDataFrame([("r1", "- s (round 1): {braces}")], "run string, context string"),
    )


def texts(made, on):
    return {tuple(r[c] for c in on): (r["system"], r["user"]) for r in prm.expand(*made, on).collect()}


def test_votes_with_and_without_a_transcript(frames):
    people, measures, contexts = frames
    on = ["run", "persona_id", "draw_no"]
    framing = {m[0]: m[1] for m in MEASURES}
    for told in (None, contexts):
        got = texts(prm.vote_prompts(people, measures, ["run"], SYSTEM, VOTE, told, "\n{so far}\n"), on)
        expected = {}
        for run, p, no, story in PEOPLE:
            tail = "\n{so far}\n- s (round 1): {braces}" if told is not None and run == "r1" else ""
            expected[run, p, no] = (SYSTEM.format(backstory=story or "") + tail, VOTE.format(framing=framing[run]))
        assert got == expected


def test_a_run_stores_its_context_once(frames):
    people, measures, contexts = frames
    rows, stored = prm.vote_prompts(people, measures, ["run"], SYSTEM, VOTE, contexts, "so far:")
    found = [r["text"] for r in stored.collect()]
    assert len(found) == len(set(found))
    assert sorted(t for t in found if t.startswith(("story", "- s"))) == ["- s (round 1): {braces}", "story 0", "story 1", "story 2"]
    # Rows hold keys of 32 letters alone, whatever the length of texts.
    assert all(len(k) == 32 for r in rows.collect() for k in [*r["system"], *r["user"]])


def test_turns_critics_and_probes(spark, frames):
    people, measures, _ = frames
    turns = spark.createDataFrame([("r1", 0, "moderator", 1, "-"), ("r1", 1, "p3", 1, "ctx"), ("r2", 4, "p1", 2, None)],
                                  "run string, seq long, speaker_id string, round int, context string")
    got = texts(prm.deliberation_prompts(turns, people, measures, ["run"], SYSTEM, "{round}/{total}: {context}"), ["run", "seq"])
    assert got == {("r1", 1): ("{role}\nstory 0!", "1/5: ctx"), ("r2", 4): ("{role}\n!", "2/3: ")}
    said = spark.createDataFrame([("r1", 0, "x {y}"), ("r2", 1, None), ("r2", 2, "")], "run string, seq long, text string")
    got = texts(prm.critic_prompts(said, measures, ["run"], "be fair", "{statement}|{sources}"), ["run", "seq"])
    assert got == {("r1", 0): ("be fair", "x {y}|a\nb"), ("r2", 1): ("be fair", "[empty]|"), ("r2", 2): ("be fair", "[empty]|")}
    asked = measures.select("run", F.lit("T").alias("title"), F.lit("WA").alias("state"), F.lit(2020).alias("year"), "framing")
    got = texts(prm.probe_prompts(asked, ["run"], "recall", "{title} ({state}, {year}) {framing}"), ["run"])
    assert got == {("r1",): ("recall", "T (WA, 2020) schools?"), ("r2",): ("recall", "T (WA, 2020) roads?")}


def test_a_missing_segment_is_an_error(frames):
    people, measures, _ = frames
    rows, stored = prm.vote_prompts(people, measures, ["run"], SYSTEM, VOTE)
    with pytest.raises(Exception, match="no segment"):
        prm.expand(rows, stored.where("text <> 'story 1'"), ["run", "persona_id", "draw_no"]).collect()
