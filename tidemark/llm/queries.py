"""The registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from tidemark.llm import chat_tree, embedding_dedup, line_dedup, merkle, mixing, near_dedup, packing, quality_rules, token_counts, url_filter, warc, wavelet, whitening

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_chat_tree": chat_tree.op3_chat_tree,
    "op4_warc": warc.op4_warc,
    "op5_mixing": mixing.op5_mixing,
    "op6_token_shards": wavelet.op6_token_shards,
    "op7_embedding_dedup": embedding_dedup.op7_embedding_dedup,
    "op8_packing": packing.op8_packing,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_url_filter": url_filter.op12_url_filter,
    "op13_whitening": whitening.op13_whitening,
}

ORACLE_SQL = {
    "op1_quality_rules": quality_rules.ORACLE_SQL,
    "op2_near_dedup": near_dedup.ORACLE_SQL,
    "op3_chat_tree": chat_tree.ORACLE_SQL,
    "op4_warc": warc.ORACLE_SQL,
    "op5_mixing": mixing.ORACLE_SQL,
    "op7_embedding_dedup": embedding_dedup.ORACLE_SQL,
    "op11_merkle_manifest": merkle.ORACLE_SQL,
    "op12_url_filter": url_filter.ORACLE_SQL,
}
