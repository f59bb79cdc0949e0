"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from lexgrove.llm import conversation_repair, embedding_dedup, exact_dedup, hard_negatives, licenses, maxent, mixing, near_dedup, packing, quality, substring_dedup, token_counts, toxicity

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_packing": packing.op3_packing,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_quality_rules": quality.op5_quality,
    "op6_lm_scoring": maxent.op6_lm_scoring,
    "op7_mixing": mixing.op7_mixing,
    "op8_minhash_near_dedup": near_dedup.op8_minhash,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_embedding_dedup": embedding_dedup.op13_embedding_dedup,
}

def oracle_sql() -> dict[str, str]:
    return ORACLE_SQL | {"op4_license_scan": licenses.oracle_sql()}


ORACLE_SQL = {
    "op1_substring_dedup": substring_dedup.ORACLE_SQL,
    "op5_quality_rules": quality.ORACLE_SQL,
    "op7_mixing": mixing.ORACLE_SQL,
    "op9_exact_dedup": exact_dedup.ORACLE_SQL,
    "op11_hard_negatives": hard_negatives.ORACLE_SQL,
    "op13_embedding_dedup": embedding_dedup.ORACLE_SQL,
}
