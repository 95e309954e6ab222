"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from quarry.llm import bpe_automaton, decontamination, html_text, impact_index, language_model, license_scan, lloyd, mixing, near_dedup, quality_rules, token_counts, toxicity, warc

QUERIES = {
    "op1_warc": warc.query,
    "op2_token_counts": token_counts.query,
    "op3_html_text": html_text.query,
    "op4_toxicity": toxicity.query,
    "op5_near_dedup": near_dedup.query,
    "op6_license_scan": license_scan.query,
    "op7_mixing": mixing.query,
    "op8_language_model": language_model.query,
    "op9_decontamination": decontamination.query,
    "op10_quality_rules": quality_rules.query,
    "quality_ablation": quality_rules.ablation_query,
    "op11_impact_search": impact_index.query,
    "op12_lloyd": lloyd.query,
    "op13_bpe_automaton": bpe_automaton.query,
}
ORACLES = {
    "op1_warc": warc.ORACLE_SQL,
    "op5_near_dedup": near_dedup.ORACLE_SQL,
    "op7_mixing": mixing.ORACLE_SQL,
    "op9_decontamination": decontamination.ORACLE_SQL,
    "op10_quality_rules": quality_rules.ORACLE_SQL,
    "quality_ablation": quality_rules.ABLATION_SQL,
    "op11_impact_search": impact_index.ORACLE_SQL,
    "op12_lloyd": lloyd.ORACLE_SQL,
}
