"""Registered queries of the text operators and their DuckDB SQL."""

from __future__ import annotations

from rfmlens.llm import (bpe, chat, langid, minhash, mixing, multi_index, periodic, prefix_trie, quality, rank_queue,
                         secret_scan, suffix_dedup, url_filter)

QUERIES = {
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op4_embedding_dedup": multi_index.op4_embedding_dedup,
    "op1_language_id": langid.op1_language_id,
    "op2_secret_scans": secret_scan.op2_secret_scans,
    "op3_bpe": bpe.op3_bpe,
    "op6_minhash": minhash.op6_minhash,
    "op7_mix_sources": mixing.op7_mix_sources,
    "op8_chat_formatting": chat.op8_chat_formatting,
    "op9_url_filters": url_filter.op9_url_filters,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_rank_queue_bpe": rank_queue.op12_rank_queue_bpe,
    "op13_periodic_runs": periodic.op13_periodic_runs,
}

ORACLES = {
    "op4_embedding_dedup": multi_index.ORACLE,
    "op6_minhash": minhash.ORACLE,
    "op8_chat_formatting": chat.ORACLE,
    "op9_url_filters": url_filter.ORACLE,
    "op10_quality_rules": quality.ORACLE,
    "op11_prefix_trie": prefix_trie.ORACLE,
}
