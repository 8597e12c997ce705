"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from baseloom.llm import decontam, exact_dedup, jaccard_join, line_dedup, lm_score, mixing, quality, sharding, substring_dedup, suffix_dedup


def queries() -> dict:
    return {
        "op1_lsm_exact_dedup": exact_dedup.op1,
        "op2_cover_substring_dedup": substring_dedup.op2,
        "op3_bloom_lm_score": lm_score.op3,
        "op4_pu_quality": quality.op4,
        "op5_radix_suffix_dedup": suffix_dedup.op5,
        "op6_ngram_jaccard_join": jaccard_join.op6,
        "op7_fair_queue_mix": mixing.op7,
        "op8_edit_decontam": decontam.op8,
        "op9_bloom_line_dedup": line_dedup.op9,
        "op10_permutation_shards": sharding.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_lsm_exact_dedup": exact_dedup.SQL,
        "op2_cover_substring_dedup": substring_dedup.SQL,
        "op6_ngram_jaccard_join": jaccard_join.SQL,
        "op7_fair_queue_mix": mixing.SQL,
        "op9_bloom_line_dedup": line_dedup.SQL,
    }
