"""The queries of this subpackage and, where SQL can state them, their SQL."""

from __future__ import annotations

from evenkeel.llm import filter_audit, fingerprint, language_id, line_dedup, media, near_dedup, packing, sentencepiece_sampling, sharding, substring_dedup, topk_search, url_filter, vector_codes

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_sentencepiece_sampling": sentencepiece_sampling.op3_sentencepiece_sampling,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_language_id": language_id.op5_language_id,
    "op6_audio_features": media.op6_audio_features,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_fingerprint": fingerprint.op8_fingerprint,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_minhash_near_dedup": near_dedup.op10_minhash_near_dedup,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_topk_search": topk_search.op12_topk_search,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}

ORACLE_SQL = {
    "op4_substring_dedup": substring_dedup.OP4_SQL,
    "op9_url_filter": url_filter.OP9_SQL,
    "op10_minhash_near_dedup": near_dedup.OP10_SQL,
    "op11_vector_codes": vector_codes.OP11_SQL,
    "op12_topk_search": topk_search.OP12_SQL,
    "op13_filter_audit": filter_audit.OP13_SQL,
}
