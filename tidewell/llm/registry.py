"""Queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from . import cotraining, decontamination, html_extract, lexical_search, manifest, mixing, near_dedup, quality_rules, repeats, secret_scan, surrogates, token_store, toxicity

QUERIES = {
    "op1_source_mix": mixing.op1_source_mix,
    "op2_minhash_near_dedup": near_dedup.op2_minhash_near_dedup,
    "op3_secret_scan": secret_scan.op3_secret_scan,
    "op4_decontamination": decontamination.op4_decontamination,
    "op5_token_store": token_store.op5_token_store,
    "op6_surrogates": surrogates.op6_surrogates,
    "op7_cotraining": cotraining.op7_cotraining,
    "op8_suffix_repeats": repeats.op8_suffix_repeats,
    "op9_html_main_text": html_extract.op9_html_main_text,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_toxicity": toxicity.op11_toxicity,
    "op12_merkle_manifest": manifest.op12_merkle_manifest,
    "op13_lexical_search": lexical_search.op13_lexical_search,
}

ORACLES: dict[str, str] = {
    "op2_minhash_near_dedup": near_dedup.ORACLE,
    "op3_secret_scan": secret_scan.ORACLE,
    "op4_decontamination": decontamination.ORACLE,
    "op8_suffix_repeats": repeats.ORACLE,
    "op10_quality_rules": quality_rules.ORACLE,
    "op12_merkle_manifest": manifest.ORACLE,
    "op13_lexical_search": lexical_search.ORACLE,
}
