"""Declared schemas of every table; nothing is inferred from data."""

MICRODATA = (
    "ST int, PUMA10 int, PUMA20 int, AGEP int, SEX int, RAC1P int, HISP int, SCHL int, "
    "PINCP double, PWGTP int"
)
CELLS = (
    "state string, puma string, age_band string, sex string, race_eth string, education string, "
    "income_band string, person_weight bigint, record_count bigint"
)
PRIORS = (
    "source string, party_id string, education string, age_band string, "
    "p_climate_action_support double, p_gun_restriction_support double, "
    "p_tax_on_rich_support double, ideology_score double, cell_n bigint"
)
PARTY_DISTRIBUTION = (
    "age_band string, education string, race_eth string, p_dem double, p_ind double, "
    "p_rep double, cell_n bigint"
)
SOURCE_VERSIONS = "source_name string, version string, loaded_at timestamp"
MEASURES = (
    "measure_id string, title string, year int, state string, topic string, "
    "ground_truth struct<yes_pct: double, no_pct: double, passed: boolean>, "
    "segment_results map<string, map<string, double>>, framing string, briefing string, "
    "briefing_sources array<string>, pro_arguments array<string>, con_arguments array<string>, "
    "n_rounds int"
)
STATEMENT = (
    "struct<seq: bigint, speaker_id: string, round: int, text: string, flagged: boolean, "
    "critic_note: string>"
)
VOTE = (
    "struct<seq: bigint, persona_id: string, round: int, stance: double, confidence: double, "
    "rationale: string>"
)
PERSONA = (
    "struct<draw_no: bigint, persona_id: string, demographics: struct<age_band: string, sex: string, "
    "race_eth: string, education: string, income_band: string, puma: string, state: string>, "
    "priors: struct<party_id: string, p_climate_action_support: double, "
    "p_gun_restriction_support: double, p_tax_on_rich_support: double, ideology_score: double>>"
)
ARTIFACT = (
    "measure_id string, seed int, part bigint, slice int, report string, "
    f"statements array<{STATEMENT}>, votes array<{VOTE}>, personas array<{PERSONA}>"
)
TABLES = {
    "cells": CELLS,
    "priors": PRIORS,
    "party_distribution": PARTY_DISTRIBUTION,
    "source_versions": SOURCE_VERSIONS,
}

# A national load in parts: which file, as it was, is in which wave of partial cells.
LOADED_FILES = "file_key string, path string, bytes bigint, modified bigint, wave string"

# Tables that are always replaced as a whole: a folder per snapshot and a pointer to the current one.
SNAPSHOTS = ("priors", "party_distribution")
