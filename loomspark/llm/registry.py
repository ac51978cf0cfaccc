"""Queries of the training-data operators with their oracle SQL."""

from __future__ import annotations

import corpus_pipeline
from loomspark.llm import audit, bpe, decontaminate, linededup, merkle, mixing, pii, quality, secretscan, simhash, toxicity, urlfilter, warc

QUERIES = {
    "op1_line_dedup": linededup.op1_line_dedup,
    "op2_warc": warc.op2_warc,
    "op3_url_filters": urlfilter.op3_url_filters,
    "op4_simhash_near_dedup": simhash.op4_simhash_near_dedup,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_benchmark_decontamination": decontaminate.op7_benchmark_decontamination,
    "op8_secret_scans": secretscan.op8_secret_scans,
    "op9_mixing": mixing.op9_mixing,
    "op10_pii_pseudonyms": pii.op10_pii_pseudonyms,
    "op11_filter_audit": audit.op11_filter_audit,
    "op12_byte_level_bpe": bpe.op12_byte_level_bpe,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op2_warc": warc.OP2_SQL,
    "op3_url_filters": urlfilter.OP3_SQL,
    "op6_quality_rules": quality.OP6_SQL,
    "op9_mixing": mixing.OP9_SQL,
    "op11_filter_audit": audit.OP11_SQL,
    "op13_merkle_manifest": merkle.OP13_SQL,
}
