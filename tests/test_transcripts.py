import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from censemble.operators import transcripts as tr

STATEMENTS = "run string, seq long, speaker_id string, round int, text string, flagged boolean"


@pytest.fixture(scope="module")
def said():
    rng = random.Random(11)
    rows = []
    for run, n, voices in (("hot", 150, 4), ("small", 7, 3), ("two", 60, 2), ("solo", 3, 1)):
        seqs = sorted(rng.sample(range(n * 3), n))
        rows += [(run, s, "moderator" if i == 0 else f"s{rng.randrange(voices)}", i // 4, f"text {run} {s}", s % 5 == 0) for i, s in enumerate(seqs)]
    # A speaker who said nearly everything lately.
    rows += [("hot", 1000 + i, "s9", 40, f"late {i}", False) for i in range(50)]
    rng.shuffle(rows)
    return rows


def line(row):
    return f"- {row[2]} (round {row[3]}){' [flagged]' if row[5] else ''}: {row[4]}"


def by_run(rows):
    out = defaultdict(list)
    for row in sorted(rows):
        out[row[0]].append(row)
    return out


def joined(rows):
    return "\n".join(map(line, rows)) if rows else "(no statements yet)"


@pytest.mark.parametrize("limit, bits", [(6, 3), (6, 4), (20, 5), (6, 20)])
def test_recent_context(spark, said, limit, bits):
    df = spark.createDataFrame(said, STATEMENTS)
    got = {(r.run, r.seq): r.context for r in tr.recent_context(df, ["run"], limit, bits).collect()}
    assert len(got) == len(said)
    for run, rows in by_run(said).items():
        for i, row in enumerate(rows):
            assert got[run, row[1]] == joined(rows[max(0, i - limit):i])


def test_block_must_hold_the_context(spark, said):
    with pytest.raises(ValueError):
        tr.recent_context(spark.createDataFrame(said, STATEMENTS), ["run"], 6, 2)


def test_final_context(spark, said):
    got = {r.run: r.context for r in tr.final_context(spark.createDataFrame(said, STATEMENTS), ["run"]).collect()}
    assert got == {run: joined(rows[-20:]) for run, rows in by_run(said).items()}


@pytest.mark.parametrize("limit", [1, 6, 20])
def test_ablated_context(spark, said, limit):
    df = spark.createDataFrame(said, STATEMENTS)
    got = {(r.run, r.speaker_id): r.context for r in tr.ablated_context(df, ["run"], limit).collect()}
    expected = {}
    for run, rows in by_run(said).items():
        for speaker in {r[2] for r in rows} - {"moderator"}:
            expected[run, speaker] = joined([r for r in rows if r[2] != speaker][-limit:])
    assert got == expected


def test_context_is_empty_without_others(spark):
    df = spark.createDataFrame([("r", 0, "a", 1, "x", False)], STATEMENTS)
    assert tr.ablated_context(df, ["run"]).first().context == "(no statements yet)"


@pytest.mark.parametrize("block_rows", [1, 2, 100_000])
def test_next_speakers(spark, said, block_rows):
    roster = [(run, f"s{i}", i) for run in ("hot", "small", "two") for i in range(7)] + [("hot", "s1", 99), ("solo", "s0", 0), ("solo", "s1", 1)]
    df = tr.next_speakers(spark.createDataFrame(roster, "run string, persona_id string, draw_no int"), spark.createDataFrame(said, STATEMENTS), ["run"], block_rows)
    got = defaultdict(list)
    for r in df.orderBy("run", "turn").collect():
        got[r.run].append((r.persona_id, r.draw_no, r.n_spoken))
    spoken = defaultdict(int)
    for row in said:
        spoken[row[0], row[2]] += 1
    for run in {r[0] for r in roster}:
        seats = sorted((spoken[run, p], p, d) for r, p, d in roster if r == run)
        expected = [(p, d, n) for n, p, d in seats[: max(1, len(seats) // 3)]]
        assert got[run] == expected


def test_influence(spark, said):
    rng = random.Random(4)
    people = [f"p{i}" for i in range(5)]
    baseline = [("hot", p, 0, 0.9) for p in people] + [("hot", p, 1, rng.random()) for p in people]
    last = {p: s for _, p, _, s in baseline}
    votes = [("hot", f"s{k}", p, rng.random()) for k in range(3) for p in people]
    df = tr.speaker_influence(
        spark.createDataFrame(baseline, "run string, persona_id string, seq long, stance double"),
        spark.createDataFrame(votes, "run string, speaker_id string, persona_id string, stance double"),
        spark.createDataFrame(said, STATEMENTS).where(F.col("run") == "hot"), ["run"],
    )
    rows = tr.ranked_influence(df, ["run"]).collect()
    assert "moderator" not in {r.speaker_id for r in rows}
    assert [r.mean_abs_shift for r in rows] == sorted((r.mean_abs_shift for r in rows), reverse=True)
    for r in rows:
        shifts = [last[p] - s for _, k, p, s in votes if k == r.speaker_id]
        assert r.n_personas == len(shifts)
        assert r.n_statements == sum(1 for row in said if row[0] == "hot" and row[2] == r.speaker_id)
        if shifts:
            assert r.mean_signed_shift == pytest.approx(sum(shifts) / 5)
            assert r.mean_abs_shift == pytest.approx(sum(map(abs, shifts)) / 5) and r.mean_abs_shift >= abs(r.mean_signed_shift) - 1e-12
        else:
            assert r.mean_abs_shift == 0.0


def test_statement_counts(spark, said):
    rows = tr.statement_counts(spark.createDataFrame(said, STATEMENTS), ["run"]).collect()
    assert sum(r.n_statements for r in rows) == len(said)
    assert sum(r.n_flagged for r in rows) == sum(1 for r in said if r[5])


def test_counterfactuals_without_a_baseline(spark, said):
    """An error, or counted; and speakers who said nothing have a row."""
    baseline = spark.createDataFrame([("hot", "p1", 0, 0.5)], "run string, persona_id string, seq long, stance double")
    votes = spark.createDataFrame(
        [("hot", "s1", "p1", 0.25), ("hot", "s1", "nobody", 0.9), ("hot", "silent", "p1", 1.0)], "run string, speaker_id string, persona_id string, stance double"
    )
    df = spark.createDataFrame(said, STATEMENTS).where(F.col("run") == "hot")
    with pytest.raises(Exception, match="no baseline vote of nobody"):
        tr.speaker_influence(baseline, votes, df, ["run"]).collect()
    got = {r.speaker_id: r for r in tr.speaker_influence(baseline, votes, df, ["run"], strict=False).collect()}
    assert (got["s1"].n_personas, got["s1"].n_unmatched, got["s1"].mean_signed_shift) == (1, 1, 0.25)
    assert (got["silent"].n_statements, got["silent"].n_personas, got["silent"].mean_signed_shift) == (0, 1, -0.5)
    assert got["s2"].n_unmatched == 0
