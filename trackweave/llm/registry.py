"""Queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from . import decontamination, fingerprint, language_id, manifest, near_dedup, packing, quality, quality_rules, secret_scan, substring_dedup, toxicity, url_filter, whitening

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_fingerprint": fingerprint.op2_fingerprint,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_secret_scan": secret_scan.op4_secret_scan,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_packing": packing.op6_packing,
    "op7_decontamination": decontamination.op7_decontamination,
    "op8_language_id": language_id.op8_language_id,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_quality": quality.op10_quality,
    "op11_merkle_manifest": manifest.op11_merkle_manifest,
    "op12_embedding_whitening": whitening.op12_embedding_whitening,
    "op13_quality_rules": quality_rules.op13_quality_rules,
}
ORACLES = {
    "op1_url_filter": url_filter.OP1_SQL,
    "op3_substring_dedup": substring_dedup.OP3_SQL,
    "op5_near_dedup": near_dedup.OP5_SQL,
    "op7_decontamination": decontamination.OP7_SQL,
    "op11_merkle_manifest": manifest.OP11_SQL,
}
