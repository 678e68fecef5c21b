"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import centroids, conversations, decontaminate, line_runs, mixing, passages, quality, secrets, simhash, suffix_dedup, tokens, toxicity, url_filters

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_token_counts": tokens.op5_token_counts,
    "op6_mix_sources": mixing.op6_mix_sources,
    "op7_near_passages": passages.op7_near_passages,
    "op8_url_filter": url_filters.op8_url_filter,
    "op9_simhash_near_dedup": simhash.op9_simhash_near_dedup,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_line_dedup": line_runs.op11_line_dedup,
    "op12_centroid_clustering": centroids.op12_centroid_clustering,
    "op13_conversation_trie": conversations.op13_conversation_trie,
}
ORACLES = {
    "op3_quality_rules": quality.ORACLE,
    "op6_mix_sources": mixing.ORACLE,
    "op8_url_filter": url_filters.ORACLE,
    "op11_line_dedup": line_runs.ORACLE,
    "op12_centroid_clustering": centroids.ORACLE,
    "op13_conversation_trie": conversations.ORACLE,
}
