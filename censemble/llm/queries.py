"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from censemble.llm.binary import op6_token_binary
from censemble.llm.chat import op4_chat_formatting
from censemble.llm.decontaminate import op1_benchmark_decontamination
from censemble.llm.merkle import op11_merkle_manifest
from censemble.llm.neardup import op7_minhash_near_dedup
from censemble.llm.pages import op3_html_extraction
from censemble.llm.passages import op9_substring_dedup
from censemble.llm.pieces import op2_sentencepiece
from censemble.llm.quality import op5_quality_rules
from censemble.llm.runs import op12_periodic_runs
from censemble.llm.secrets import op10_secret_scans
from censemble.llm.simhash import op13_simhash_near_dedup
from censemble.llm.sql import ORACLE
from censemble.llm.urls import op8_url_filters

QUERIES = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_html_extraction": op3_html_extraction,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_quality_rules": op5_quality_rules,
    "op6_token_binary": op6_token_binary,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_url_filters": op8_url_filters,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_secret_scans": op10_secret_scans,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_simhash_near_dedup": op13_simhash_near_dedup,
}

__all__ = ["ORACLE", "QUERIES"]
