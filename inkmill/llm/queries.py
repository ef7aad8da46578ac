"""The queries of this subpackage, one for each operator, and their SQL where DuckDB can express it."""

from __future__ import annotations

from inkmill.llm import credentials, decontam, html_main, lexical, license, lm, merkle, mixing, quality, simhash, suffix, token_counts, warc

QUERIES = {
    "op1_lm_scoring": lm.op1_lm_scoring,
    "op2_suffix_array_dedup": suffix.op2_suffix_array_dedup,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_license_scans": license.op4_license_scans,
    "op5_html_extraction": html_main.op5_html_extraction,
    "op6_mixing": mixing.op6_mixing,
    "op7_simhash_near_dedup": simhash.op7_simhash_near_dedup,
    "op8_benchmark_decontamination": decontam.op8_benchmark_decontamination,
    "op9_warc": warc.op9_warc,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_lexical_search": lexical.op12_lexical_search,
    "op13_secret_scans": credentials.op13_secret_scans,
}

ORACLE_SQL = {
    "op1_lm_scoring": lm.ORACLE,
    "op2_suffix_array_dedup": suffix.ORACLE,
    "op6_mixing": mixing.ORACLE,
    "op8_benchmark_decontamination": decontam.ORACLE,
    "op9_warc": warc.ORACLE,
    "op10_quality_rules": quality.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
    "op12_lexical_search": lexical.ORACLE,
    "op13_secret_scans": credentials.ORACLE,
}
