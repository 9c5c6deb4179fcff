"""The operators' queries and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from . import cap_filters, chunk_dedup, conversation_repair, katz_lm, language_id, lsh_forest, merkle, mixing, packing, permutation_index, quality_rules, warc, wavelet

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_katz_lm": katz_lm.op2_katz_lm,
    "op3_jaccard_join": lsh_forest.op3_jaccard_join,
    "op4_language_id": language_id.op4_language_id,
    "op5_warc": warc.op5_warc,
    "op6_packing": packing.op6_packing,
    "op7_chunk_dedup": chunk_dedup.op7_chunk_dedup,
    "op8_mixing": mixing.op8_mixing,
    "op9_cap_filters": cap_filters.op9_cap_filters,
    "op10_token_shards": wavelet.op10_token_shards,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_permutation_index": permutation_index.op12_permutation_index,
    "op13_conversation_repair": conversation_repair.op13_conversation_repair,
}
ORACLES = {
    "op1_quality_rules": quality_rules.ORACLE,
    "op5_warc": warc.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
    "op13_conversation_repair": conversation_repair.ORACLE,
}
