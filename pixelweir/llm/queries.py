"""The registered queries of the text operators."""

from __future__ import annotations

from pixelweir.llm import bpe, conversation_repair, language_id, license_scan, lm_scoring, near_dedup, ogg, packing, quality_classifier, quality_rules, ranked_search, sharding, source_mixing

QUERIES = {
    "op1_language_id": language_id.query,
    "op10_ogg": ogg.query,
    "op11_conversation_repair": conversation_repair.query,
    "op12_ranked_search": ranked_search.query,
    "op13_packing": packing.query,
    "op2_bpe": bpe.query,
    "op3_license_scan": license_scan.query,
    "op4_quality_classifier": quality_classifier.query,
    "op5_lm_scoring": lm_scoring.query,
    "op6_quality_rules": quality_rules.query,
    "op7_source_mixing": source_mixing.query,
    "op8_near_dedup": near_dedup.query,
    "op9_sharding": sharding.query,
}

ORACLE_SQL = {
    "op11_conversation_repair": conversation_repair.SQL,
    "op12_ranked_search": ranked_search.SQL,
    "op6_quality_rules": quality_rules.SQL,
    "op7_source_mixing": source_mixing.SQL,
    "op8_near_dedup": near_dedup.SQL,
}
