"""The queries and SQL of this package."""

from __future__ import annotations

from . import bpe, centroids, chat, context_mixing, decontaminate, language_id, near_dup, quality_classifier, quality_rules, reassembly, sharding, token_file, url_filter

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_byte_bpe": bpe.op2_byte_bpe,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_quality_classifier": quality_classifier.op5_quality_classifier,
    "op6_sharding": sharding.op6_sharding,
    "op7_near_dedup": near_dup.op7_near_dedup,
    "op8_chat_formatting": chat.op8_chat_formatting,
    "op9_token_files": token_file.op9_token_files,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_centroids": centroids.op11_centroids,
    "op12_lm_scoring": context_mixing.op12_lm_scoring,
    "op13_turn_reassembly": reassembly.op13_turn_reassembly,
}

SQL = {
    "op3_decontamination": decontaminate.OP3_SQL,
    "op4_url_filter": url_filter.OP4_SQL,
    "op7_near_dedup": near_dup.OP7_SQL,
    "op8_chat_formatting": chat.OP8_SQL,
    "op10_quality_rules": quality_rules.OP10_SQL,
    "op11_centroids": centroids.OP11_SQL,
}
