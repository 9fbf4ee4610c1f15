"""Queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from . import op1_sentencepiece, op2_toxicity, op3_secrets, op4_near_dedup, op5_ann, op6_token_counts, op7_substring_dedup, op8_lm_scoring, op9_decontamination, op10_html, op11_token_store, op12_repair, op13_manifest

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece.op1_sentencepiece,
    "op2_toxicity": op2_toxicity.op2_toxicity,
    "op3_secrets": op3_secrets.op3_secrets,
    "op4_near_dedup": op4_near_dedup.op4_near_dedup,
    "op5_ann": op5_ann.op5_ann,
    "op6_token_counts": op6_token_counts.op6_token_counts,
    "op7_substring_dedup": op7_substring_dedup.op7_substring_dedup,
    "op8_lm_scoring": op8_lm_scoring.op8_lm_scoring,
    "op9_decontamination": op9_decontamination.op9_decontamination,
    "op10_html": op10_html.op10_html,
    "op11_token_store": op11_token_store.op11_token_store,
    "op12_repair": op12_repair.op12_repair,
    "op13_manifest": op13_manifest.op13_manifest,
}
ORACLES = {"op3_secrets": op3_secrets.ORACLE, "op4_near_dedup": op4_near_dedup.ORACLE, "op7_substring_dedup": op7_substring_dedup.ORACLE, "op9_decontamination": op9_decontamination.ORACLE, "op12_repair": op12_repair.ORACLE, "op13_manifest": op13_manifest.ORACLE}
