import os
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from censemble.functions import fixed
from censemble.functions.recode import recode_microdata
from censemble.operators.cells import k_anonymous, weighted_cells
from censemble.plans import backtest, library, national
from censemble.sources import files, readers, writers
from censemble.sources.schemas import CELLS, MEASURES, SOURCE_VERSIONS

HEADER = "SERIALNO,ST,PUMA10,PUMA20,AGEP,SEX,RAC1P,HISP,SCHL,PINCP,PWGTP"


def write(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n")


def test_microdata_by_name_and_state(spark, tmp_path):
    write(tmp_path / "psam_p53.csv", [HEADER, "x,53,-9,23303.0,40,2,1,1,21,50000.5,10", "y,53,11,,15,1,,1,,,"])
    rows = readers.read_state_microdata(spark, str(tmp_path), "WA").orderBy("AGEP").collect()
    assert (rows[1].PUMA20, rows[1].PINCP, rows[1].PWGTP) == (23303, 50000.5, 10)
    assert rows[0].RAC1P is None and rows[0].PUMA20 is None
    with pytest.raises(FileNotFoundError):
        readers.read_state_microdata(spark, str(tmp_path), "CA")
    with pytest.raises(ValueError):
        readers.read_state_microdata(spark, str(tmp_path), "XX")


def test_national_files_prefer_the_folder(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.read_national_microdata(spark, str(tmp_path))
    write(tmp_path / "psam_pusa.csv", [HEADER, "x,53,-9,1,40,2,1,1,21,1,10"])
    assert readers.read_national_microdata(spark, str(tmp_path)).count() == 1
    for part in "ab":
        write(tmp_path / "csv_pus" / f"psam_pus{part}.csv", [HEADER, *["x,6,-9,1,40,2,1,1,21,1,10"] * 2])
    assert readers.read_national_microdata(spark, str(tmp_path)).count() == 4


def test_missing_columns_are_refused(spark, tmp_path):
    write(tmp_path / "a.csv", ["pid7,educ", "x,y"])
    with pytest.raises(KeyError, match="birthyr"):
        readers.read_label_survey(spark, str(tmp_path / "a.csv"))
    with pytest.raises(KeyError, match="AGEP"):
        readers.read_microdata(spark, [str(tmp_path / "a.csv")])
    spark.range(1).write.parquet(str(tmp_path / "p"))
    with pytest.raises(KeyError):
        readers.read_coded_survey(spark, str(tmp_path / "p"))


def test_csv_scan_reads_needed_columns_only(spark, tmp_path):
    write(tmp_path / "a.csv", [HEADER, "x,53,-9,1,40,2,1,1,21,1,10"])
    plan = readers.read_microdata(spark, [str(tmp_path / "a.csv")]).select("AGEP")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<AGEP:string>" in plan


def cells(spark, *rows):
    full = [(s, "00001", "30-44", "female", "white_nh", "hs", "lt_25k", w, n) for s, w, n in rows]
    return spark.createDataFrame(full, CELLS)


def test_replace_states_keeps_the_others(spark, tmp_path):
    lib = str(tmp_path / "lib")
    writers.create_library(spark, lib)
    assert readers.read_table(spark, lib, "cells").isEmpty() and readers.read_table(spark, lib, "priors").isEmpty()
    writers.replace_states(cells(spark, ("WA", 1, 5), ("CA", 2, 5)), lib)
    writers.replace_states(cells(spark, ("WA", 9, 6)), lib)
    table = readers.read_table(spark, lib, "cells")
    assert {(r.state, r.person_weight) for r in table.collect()} == {("WA", 9), ("CA", 2)}
    plan = k_anonymous(table, "WA")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(state" in plan and "GreaterThanOrEqual(record_count,5)" in plan
    writers.replace_cells(cells(spark, ("NY", 3, 5)), lib)
    assert [r.state for r in readers.read_table(spark, lib, "cells").collect()] == ["NY"]


def test_replace_table_may_read_itself(spark, tmp_path):
    lib = str(tmp_path / "lib")
    writers.create_library(spark, lib)
    one = spark.createDataFrame([("30-44", "hs", "hispanic", 0.1, 0.2, 0.7, 20)],
                                "age_band string, education string, race_eth string, p_dem double, p_ind double, p_rep double, cell_n long")
    writers.replace_table(one, lib, "party_distribution")
    again = readers.read_table(spark, lib, "party_distribution")
    writers.replace_table(again.withColumn("cell_n", F.col("cell_n") + 1), lib, "party_distribution")
    assert [r.cell_n for r in readers.read_table(spark, lib, "party_distribution").collect()] == [21]


PARTY = "age_band string, education string, race_eth string, p_dem double, p_ind double, p_rep double, cell_n long"


def party(spark, *counts):
    return spark.createDataFrame([("30-44", "hs", "hispanic", 0.1, 0.2, 0.7, n) for n in counts], PARTY)


def counts_of(df):
    return sorted(r.cell_n for r in df.collect())


def test_a_reader_in_the_middle_of_a_swap_sees_old_rows(spark, tmp_path, monkeypatch):
    lib = str(tmp_path / "lib")
    writers.replace_table(party(spark, 1, 2), lib, "party_distribution")
    before = readers.read_table(spark, lib, "party_distribution")
    seen, real = [], files._commit

    def watched(*args):
        # The new rows are all written, the pointer is not.
        seen.append(counts_of(readers.read_table(spark, lib, "party_distribution")))
        real(*args)

    monkeypatch.setattr(files, "_commit", watched)
    writers.replace_table(party(spark, 7), lib, "party_distribution")
    assert seen == [[1, 2]] and counts_of(before) == [1, 2]
    assert counts_of(readers.read_table(spark, lib, "party_distribution")) == [7]


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    lib = str(tmp_path / "lib")
    writers.replace_table(party(spark, 1), lib, "party_distribution")
    bad = party(spark, 5).withColumn("cell_n", F.raise_error(F.lit("no")).cast("long"))
    with pytest.raises(Exception, match="no"):
        writers.replace_table(bad, lib, "party_distribution")
    assert counts_of(readers.read_table(spark, lib, "party_distribution")) == [1]
    assert len([p for p in os.listdir(f"{lib}/party_distribution") if p.startswith("v-")]) == 1


def test_the_second_of_two_writers_is_told(spark, tmp_path, monkeypatch):
    table = str(tmp_path / "t")
    first = files.replace_snapshot(party(spark, 1), table)
    real = files._commit

    def overtaken(spark_, fs, table_, number, name):
        monkeypatch.setattr(files, "_commit", real)
        files.replace_snapshot(party(spark, 2), table)
        real(spark_, fs, table_, number, name)

    monkeypatch.setattr(files, "_commit", overtaken)
    with pytest.raises(files.SnapshotConflict):
        files.replace_snapshot(party(spark, 3), table)
    assert counts_of(files.read_snapshot(spark, table)) == [2]
    assert counts_of(files.read_snapshot(spark, table, first)) == [1]
    with pytest.raises(files.SnapshotConflict):
        files.replace_snapshot(party(spark, 4), table, expected=first, check=True)
    assert counts_of(files.read_snapshot(spark, table)) == [2]


def test_a_dead_writers_pointer_does_not_block(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "DEAD_SECONDS", 0.1)
    table = str(tmp_path / "t")
    files.replace_snapshot(party(spark, 1), table)
    open(f"{table}/{files.POINTER}-{2:012d}", "w").close()
    assert counts_of(files.read_snapshot(spark, table)) == [1]
    files.replace_snapshot(party(spark, 2), table)
    assert counts_of(files.read_snapshot(spark, table)) == [2]
    for n in range(3, 6):
        files.replace_snapshot(party(spark, n), table)
    assert len([p for p in os.listdir(table) if p.startswith("v-")]) == 2
    with pytest.raises(FileNotFoundError):
        files.read_snapshot(spark, str(tmp_path / "none"))


def test_latest_version_wins(spark, tmp_path):
    log = [("acs", "v1", datetime(2024, 1, 1)), ("acs", "v3", datetime(2024, 1, 3)), ("acs", "v2", datetime(2024, 1, 2)), ("anes", "a", datetime(2023, 1, 1))]
    versions = spark.createDataFrame(log, SOURCE_VERSIONS)
    assert {r.source_name: r.version for r in readers.latest_versions(versions).collect()} == {"acs": "v3", "anes": "a"}
    assert readers.versions_map(versions).first().source_versions == {"acs": "v3", "anes": "a"}
    lib = str(tmp_path / "lib")
    assert readers.source_versions(spark, lib) == {}
    writers.record_version(spark, lib, "acs", "old", F.lit(datetime(2020, 1, 1)))
    writers.record_version(spark, lib, "acs", "new")
    assert readers.source_versions(spark, lib) == {"acs": "new"}


def test_measure_defaults(spark, tmp_path):
    lines = ['{"measure_id": "wa_i1", "title": "T", "year": 2018, "state": "WA", "topic": "x", "framing": " f \\n", "briefing": "b "}',
             '{"measure_id": "wa_i2", "title": "U", "year": 2019, "state": "WA", "topic": "y", "framing": "f", "briefing": "b", "n_rounds": 3, '
             '"ground_truth": {"yes_pct": 43.4, "passed": true}, "pro_arguments": ["p"], "segment_results": {"party_id": {"dem": 60.0}}}']
    write(tmp_path / "m.json", lines)
    got = {r.measure_id: r for r in readers.read_measures(spark, str(tmp_path / "m.json")).collect()}
    a, b = got["wa_i1"], got["wa_i2"]
    assert (a.framing, a.briefing, a.n_rounds, a.yes_pct, a.no_pct, a.passed, a.briefing_sources) == ("f", "b", 5, 50.0, 50.0, False, [])
    assert (b.n_rounds, b.yes_pct, b.no_pct, b.passed, b.pro_arguments, b.file_id) == (3, 43.4, 50.0, True, ["p"], "i2")
    assert b.segment_results == {"party_id": {"dem": 60.0}}
    listed = readers.list_measures(readers.read_measures(spark, str(tmp_path / "m.json")))
    assert [r.measure_id for r in listed.collect()] == ["i1", "i2"]


def artifact_tables(spark):
    votes = spark.createDataFrame(
        [("wa_a", s, i, f"p{i % 6}", 0 if i < 6 else 6, 0.2 if i < 6 else 0.7, 0.5, "r") for s in (1, 2) for i in range(12)],
        "measure_id string, seed int, seq long, persona_id string, round int, stance double, confidence double, rationale string",
    )
    said = spark.createDataFrame(
        [("wa_a", s, i, "moderator" if i == 0 else f"p{i % 6}", i, f"line {i}", i == 2, None) for s in (1, 2) for i in range(5)],
        "measure_id string, seed int, seq long, speaker_id string, round int, text string, flagged boolean, critic_note string",
    )
    people = spark.createDataFrame(
        [("wa_a", s, i, f"p{i}", "30-44", "female", "white_nh", "hs", "lt_25k", "00001", "WA", "dem", 0.1, 0.2, 0.3, -0.4) for s in (1, 2) for i in range(6)],
        "measure_id string, seed int, draw_no long, persona_id string, age_band string, sex string, race_eth string, education string, income_band string, puma string, state string, "
        "party_id string, p_climate_action_support double, p_gun_restriction_support double, p_tax_on_rich_support double, ideology_score double",
    )
    return votes, said, people


@pytest.mark.parametrize("part_size", [10_000, 4])
def test_artifacts_round_trip(spark, tmp_path, part_size):
    votes, said, people = artifact_tables(spark)
    reports = spark.createDataFrame([("wa_a", 1, "fine"), ("wa_a", 2, "The campaign should act")], "measure_id string, seed int, report string")
    nested = writers.run_artifacts(reports, said, votes, people, part_size)
    assert max(len(r.votes) for r in nested.collect()) <= part_size
    path = str(tmp_path / "runs")
    # Written again, a run replaces itself.
    for _ in range(2):
        writers.write_artifacts(nested, path)
    assert len(list((tmp_path / "runs").glob("*/*/*.json"))) == nested.count()
    cut = writers.run_artifacts(reports, said, votes, people, part_size, slice_bytes=3)
    assert max(len(r.votes) for r in cut.collect()) <= 3
    writers.write_artifacts(cut, str(tmp_path / "cut"))
    again = readers.artifact_votes(readers.read_artifacts(spark, str(tmp_path / "cut"))).select(votes.columns)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, votes.where("seed = 1").collect()))
    back = readers.read_artifacts(spark, path)
    got = readers.artifact_votes(back).select(votes.columns)
    # The second run's report is refused, so nothing of that run is written.
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, votes.where("seed = 1").collect()))
    assert readers.artifact_statements(back).count() == 5
    assert readers.artifact_personas(back).first().ideology_score == -0.4


def test_reports_from_artifacts(spark, tmp_path):
    votes, said, people = artifact_tables(spark)
    reports = spark.createDataFrame([("wa_a", s, "fine") for s in (1, 2)], "measure_id string, seed int, report string")
    writers.write_artifacts(writers.run_artifacts(reports, said, votes, people), str(tmp_path / "runs"))
    raw = spark.createDataFrame([("wa_a", "T", 2018, "WA", "x", (60.0, 40.0, True), None, "neutral", "b", None, None, None, 5)], MEASURES)
    calls = spark.createDataFrame([("wa_a", 1, "gemini-2.5-pro", 1_000_000, 0)], "measure_id string, seed int, model string, in_tok long, out_tok long")
    out = str(tmp_path / "out")
    backtest.report_artifacts(spark, str(tmp_path / "runs"), readers.with_measure_defaults(raw), calls, out)
    got = {r.seed: r for r in spark.read.json(f"{out}/reports").collect()}
    assert got[1].weighted_pct == pytest.approx(70.0) and got[1].ci_low == pytest.approx(70.0) and got[1].mae_weighted == pytest.approx(10.0)
    assert got[1].flip_rate == 1.0 and got[1].n_flagged == 1 and got[1].n_personas == 6
    assert got[1].cost_usd == 1.25 and got[2].cost_usd == 0.0 and got[1].model_version == "gemini:gemini-2.5-pro"
    segments = spark.read.json(f"{out}/segments").where("axis = 'party_id'").collect()
    assert {(r.seed, r.value, r.n) for r in segments} == {(1, "dem", 6), (2, "dem", 6)}
    assert spark.read.json(f"{out}/sensitivity").first().n_seeds == 2
    summary = {r.level: r for r in spark.read.json(f"{out}/summary").collect()}
    assert summary[0].n_runs == 2 and summary[1].cost_usd == 1.25
    assert spark.read.json(f"{out}/multigroup").first().n_groups == 2
    groups = backtest.multigroup_report(votes, readers.with_measure_defaults(raw), 42).first()
    assert groups.n_groups == 2 and groups.pooled_ci_low == pytest.approx(70.0)


def test_csv_columns_go_by_name_in_every_file(spark, tmp_path):
    write(tmp_path / "csv_pus" / "psam_pusa.csv", [HEADER, "x,53,-9,1,40,2,1,1,21,1,10"])
    names = HEADER.split(",")
    values = dict(zip(names, "y,6,-9,2,70,1,2,1,16,5,30".split(","), strict=True))
    turned = ["PWGTP", *[n for n in names[::-1] if n != "PWGTP"], "MORE", "MORE"]
    write(tmp_path / "csv_pus" / "psam_pusb.csv", [",".join(turned), ",".join([values.get(n, "z") for n in turned])])
    rows = {r.ST: r for r in readers.read_national_microdata(spark, str(tmp_path)).collect()}
    assert (rows[53].PWGTP, rows[53].AGEP) == (10, 40) and (rows[6].PWGTP, rows[6].AGEP, rows[6].PINCP) == (30, 70, 5.0)
    write(tmp_path / "bad" / "psam_pusa.csv", [HEADER, "x,53,-9,1,40,2,1,1,21,1,10"])
    write(tmp_path / "bad" / "psam_pusb.csv", [HEADER.replace("AGEP", "AGE"), "x,53,-9,1,40,2,1,1,21,1,10"])
    with pytest.raises(KeyError, match="AGEP"):
        readers.read_national_microdata(spark, str(tmp_path / "bad"))


def test_contamination_report(spark, tmp_path):
    probes = spark.createDataFrame(
        [("wa_a", 1, '{"knows": true, "yes_pct": 52, "confidence": 0.5, "note": "n"}', 50.0), ("wa_a", 2, "?", 50.0),
         ("wa_a", 3, '{"knows": true, "yes_pct": 1, "note": "The campaign should act"}', 50.0)],
        "measure_id string, seed int, response string, actual_yes_pct double",
    )
    backtest.contamination_report(probes, str(tmp_path / "c"))
    rows = {r.seed: (r.flag, r.recall_error, r.knows) for r in spark.read.json(str(tmp_path / "c")).collect()}
    # The third probe's note is refused, and with it the row.
    assert rows == {1: ("HIGH", 2.0, True), 2: ("NONE", None, False)}


def test_refused_measures_do_not_run(spark):
    raw = [("wa_a", "T", 2018, "WA", "x", None, None, f, "b", None, None, None, 5) for f in ("neutral", "How do we convert young rural voters?")]
    measures = readers.with_measure_defaults(spark.createDataFrame(raw, MEASURES))
    assert [r.framing for r in backtest.allowed_measures(measures, F.current_date()).collect()] == ["neutral"]


def test_library_end_to_end(spark, tmp_path):
    lib = str(tmp_path / "lib")
    writers.create_library(spark, lib)
    specs = spark.createDataFrame([(1, "US", 50, 42), (2, "WA", 10, 42)], "spec_id int, state string, n long, seed int")
    with pytest.raises(RuntimeError, match="source versions"):
        library.sample_from_library(spark, lib, specs)
    write(tmp_path / "raw" / "csv_pus" / "psam_pusa.csv", [HEADER, *["x,53,-9,1,40,2,1,1,21,1,10"] * 6, *["x,6,-9,1,70,1,2,1,16,1,30"] * 5])
    library.build_cells(spark, lib, readers.read_national_microdata(spark, str(tmp_path / "raw")), national=True)
    names = fixed.CODED_SURVEY
    survey = spark.createDataFrame([(1.0, 4.0, 40.0, 2.0, 1.0, 1.0, 2.0, 1.0)] * 20, ", ".join(f"{names[k]} double" for k in ("party", "education", "age", "ideology", "climate", "guns", "taxes", "race")))
    library.build_coded_survey(spark, lib, survey)
    labels = [("Strong Democrat", "4-year", "1980", "Liberal", "Oppose", "For", "For")] * 20
    library.build_label_survey(spark, lib, spark.createDataFrame(labels, ", ".join(f"{c} string" for c in fixed.LABEL_SURVEY.values())))
    assert set(readers.source_versions(spark, lib)) == {"acs", "anes", "cces"}
    people = library.sample_from_library(spark, lib, specs).collect()
    assert len(people) == 60 and {r.state for r in people if r.spec_id == 2} == {"WA"}
    known = next(r for r in people if r.state == "WA")
    assert known.party_id == "dem" and known.p_climate_action_support == pytest.approx(0.5)
    with pytest.raises(RuntimeError, match="TX"):
        library.sample_from_library(spark, lib, spark.createDataFrame([(3, "TX", 1, 1)], specs.schema))


PERSON = "53,-9,{area},40,2,1,1,21,1.5,{weight}"
SHORT = "ST,PUMA10,PUMA20,AGEP,SEX,RAC1P,HISP,SCHL,PINCP,PWGTP"


def person(area=1, weight=10):
    return PERSON.format(area=area, weight=weight)


def test_unreadable_cells_and_lines_are_errors_or_listed(spark, tmp_path):
    folder = tmp_path / "a b+%20"
    write(folder / "x.csv", ["", "\ufeff" + SHORT, person("x1"), person().replace("40", "forty"), "53,-9,1,40,2,1,1", person() + ",9", person(2)])
    write(folder / "y.csv", [SHORT, "53,-9,1,40,2,1,1,NA,NaN,7", "53,-9,1,40,2,1,1,,99999999999,7", "53,-9,1,40,99999999999,1,1,,1,7"])
    (folder / "empty.csv").touch()
    with pytest.raises(Exception, match="(AGEP: no number: forty|SEX: no number: 9)"):
        readers.read_microdata(spark, [str(folder)]).collect()
    # Only rows that are worked out are looked at, and only columns that are asked for.
    assert readers.read_microdata(spark, [str(folder)]).select("PWGTP").count() == 8
    kept = readers.read_microdata(spark, [str(folder)], strict=False)
    assert sorted((r.PUMA20 or -1, r.PINCP or -1, r.PWGTP) for r in kept.collect()) == [(-1, 1.5, 10), (1, -1, 7), (1, 99999999999.0, 7), (2, 1.5, 10)]
    bad = readers.unreadable_microdata(spark, [str(folder)]).collect()
    assert sorted((r.file.rsplit("/", 2)[1:], r.column or "", r.text, r.kept) for r in bad) == [
        (["a b+%20", "x.csv"], "", "53,-9,1,40,2,1,1", False),
        (["a b+%20", "x.csv"], "", person() + ",9", False),
        (["a b+%20", "x.csv"], "AGEP", "forty", False),
        (["a b+%20", "x.csv"], "PUMA20", "x1", True),
        (["a b+%20", "y.csv"], "SEX", "99999999999", False),
    ]


def test_a_long_file_gives_its_header_without_being_read(spark, tmp_path):
    import gzip

    write(tmp_path / "long.csv", [SHORT, *[person()] * 50_000])
    (tmp_path / "short.csv.gz").write_bytes(gzip.compress(b'b,"a, c"\n1,2\n'))
    (tmp_path / "empty.csv").touch()
    found = files.csv_headers(spark, files.files_of(spark, str(tmp_path)))
    assert {k.rsplit("/", 1)[1]: v for k, v in found.items()} == {"long.csv": tuple(SHORT.split(",")), "short.csv.gz": ("b", "a, c")}
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") != str(files._WHOLE_FILE)


def test_coded_survey_text_that_is_no_number(spark, tmp_path):
    names = list(fixed.CODED_SURVEY.values())
    write(tmp_path / "s.csv", [",".join(names), ",".join(["1"] * len(names)), ",".join(["1"] * (len(names) - 1) + ["one"])])
    path = str(tmp_path / "s.csv")
    with pytest.raises(Exception, match="no number: one"):
        readers.read_coded_survey(spark, path).collect()
    assert readers.read_coded_survey(spark, path, strict=False).count() == 1
    assert [(r.column, r.text, r.kept) for r in readers.unreadable_coded_survey(spark, path).collect()] == [(names[-1], "one", False)]


def loaded(spark, lib):
    return sorted((r.puma, r.person_weight, r.record_count) for r in readers.read_table(spark, lib, "cells").collect())


def test_a_national_load_goes_on_where_it_was_stopped(spark, tmp_path, monkeypatch):
    lib, folder = str(tmp_path / "lib"), tmp_path / "raw"
    for i, name in enumerate("abcd"):
        write(folder / f"psam_pus{name} +%.csv", [SHORT, person(1, 10 * (i + 1)), person(i + 2, 1)])
    real, turns = national._load_wave, []

    def stops_at_the_third(*args):
        turns.append(args)
        if len(turns) == 3:
            raise RuntimeError("lost")
        real(*args)

    monkeypatch.setattr(national, "_load_wave", stops_at_the_third)
    with pytest.raises(RuntimeError, match="lost"):
        national.load_national(spark, lib, str(folder), wave_bytes=1)
    assert not files.exists(spark, f"{lib}/cells") and national.loaded_files(spark, lib).count() == 2
    read = national.load_national(spark, lib, str(folder), wave_bytes=1)
    assert [p.rsplit("pus", 1)[1][0] for p in read] == ["c", "d"]
    full = [("00001", 100, 4), ("00002", 1, 1), ("00003", 1, 1), ("00004", 1, 1), ("00005", 1, 1)]
    assert loaded(spark, lib) == full
    assert national.load_national(spark, lib, str(folder)) == [] and loaded(spark, lib) == full


def test_a_changed_or_missing_file_counts_as_it_is_now(spark, tmp_path):
    lib, folder = str(tmp_path / "lib"), tmp_path / "raw"
    for name in "abc":
        write(folder / f"psam_pus{name}.csv", [SHORT, person(1, 10)])
    assert len(national.load_national(spark, lib, str(folder))) == 3
    write(folder / "psam_pusa.csv", [SHORT, person(1, 500), person(7, 1)])
    assert [p.rsplit("/", 1)[1] for p in national.load_national(spark, lib, str(folder))] == ["psam_pusa.csv"]
    assert loaded(spark, lib) == [("00001", 520, 3), ("00007", 1, 1)]
    for name in "bc":
        (folder / f"psam_pus{name}.csv").unlink()
    assert national.load_national(spark, lib, str(folder), keep_cells=False) == []
    assert loaded(spark, lib) == [("00001", 500, 1), ("00007", 1, 1)]
    assert len(files.folders_of(spark, f"{lib}/cells_by_file")) == 1
    # A file that is there again as it was is read again, as its wave has gone.
    write(folder / "psam_pusb.csv", [SHORT, person(1, 10)])
    assert len(national.load_national(spark, lib, str(folder))) == 1
    assert loaded(spark, lib) == [("00001", 510, 2), ("00007", 1, 1)]


def test_a_wave_that_does_not_count_is_left_out_and_deleted(spark, tmp_path, monkeypatch):
    lib, folder = str(tmp_path / "lib"), tmp_path / "raw"
    write(folder / "psam_pusa.csv", [SHORT, person(1, 10)])
    with monkeypatch.context() as patched:
        # Stopped between the partial cells and the rows that make them count.
        patched.setattr(national, "_record", lambda *args: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            national.load_national(spark, lib, str(folder))
    assert len(files.folders_of(spark, f"{lib}/cells_by_file")) == 1
    assert len(national.load_national(spark, lib, str(folder), keep_cells=False)) == 1
    assert loaded(spark, lib) == [("00001", 10, 1)]
    assert len(files.folders_of(spark, f"{lib}/cells_by_file")) == 1


def test_waves_hold_their_bytes():
    entries = {k: (k, n, 0) for k, n in zip("abcde", [5, 5, 30, 1, 9], strict=True)}
    assert national.waves(entries, 10) == [["a", "b"], ["c"], ["d", "e"]] and national.waves({}, 10) == []


def test_numbers_in_csv_are_read_by_compiled_methods(spark, tmp_path, capsys):
    own = spark.newSession()
    own.conf.set("spark.sql.adaptive.enabled", "false")
    write(tmp_path / "x.csv", [SHORT, person()])
    people = readers.read_microdata(own, [str(tmp_path)], with_file=True)
    weighted_cells(recode_microdata(people, [readers.FILE]), [readers.FILE]).explain("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    # Above 8000 bytes the JVM does not compile a method.
    assert sizes and max(sizes) < 8000
