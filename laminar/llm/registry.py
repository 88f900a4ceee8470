"""The queries of the text operators and their SQL, by name."""

from __future__ import annotations

from . import bpe, decontamination, html_text, katz, quality_model, quality_rules, sharding, simhash, toxicity, url_filter

QUERIES = {
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_bpe": bpe.op6_bpe,
    "op7_decontamination": decontamination.op7_decontamination,
    "op10_simhash": simhash.op10_simhash,
    "op1_html_text": html_text.op1_html_text,
    "op2_toxicity": toxicity.op2_toxicity,
    "op8_quality_model": quality_model.op8_quality_model,
    "op3_katz": katz.op3_katz,
    "op4_kd_sharding": sharding.op4_kd_sharding,
    "op9_url_filters": url_filter.op9_url_filters,
}

ORACLE_SQL = {
    "op7_decontamination": decontamination.SQL,
    "op9_url_filters": url_filter.SQL,
}
