"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import divergence, fim, html_text, line_runs, mixing, near_dedup, packing, pii, quality_pu, quality_rules, token_store, topk, toxicity

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_exact_topk": topk.query,
    "op3_mixing": mixing.query,
    "op4_quality_classifier": quality_pu.query,
    "op5_html_extraction": html_text.query,
    "op6_best_fit_packing": packing.query,
    "op7_minhash_near_dedup": near_dedup.query,
    "op8_quality_rules": quality_rules.query,
    "op9_pii": pii.query,
    "op10_token_store": token_store.query,
    "op11_line_dedup": line_runs.query,
    "op12_fill_in_middle": fim.query,
    "op13_source_divergence": divergence.query,
}
#: The others learn, search with hashing, follow links or call a tokenizer, which SQL cannot express.
ORACLE_SQL = {"op2_exact_topk": topk.ORACLE, "op11_line_dedup": line_runs.ORACLE, "op12_fill_in_middle": fim.ORACLE, "op13_source_divergence": divergence.ORACLE}
