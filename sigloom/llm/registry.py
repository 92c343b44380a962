"""The training-data queries and the SQL that some of them are checked against."""

from __future__ import annotations

from sigloom.llm import compression_classifier, decontamination, line_dedup, near_duplicates, quality_rules, sentencepieces, sharding, suffix_dedup, token_counts, token_store


def queries() -> dict:
    return {
        "op1_token_store": token_store.op1_token_store,
        "op2_jaccard_join": near_duplicates.op2_jaccard_join,
        "op3_token_counts": token_counts.op3_token_counts,
        "op4_compression_classifier": compression_classifier.op4_compression_classifier,
        "op5_external_shuffle": sharding.op5_external_shuffle,
        "op6_sentencepieces": sentencepieces.op6_sentencepieces,
        "op7_line_dedup": line_dedup.op7_line_dedup,
        "op8_decontamination": decontamination.op8_decontamination,
        "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
        "op10_repetition_coverage": quality_rules.op10_repetition_coverage,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_jaccard_join": near_duplicates.OP2_SQL, "op8_decontamination": decontamination.OP8_SQL, "op9_suffix_dedup": suffix_dedup.OP9_SQL, "op7_line_dedup": line_dedup.OP7_SQL, "op10_repetition_coverage": quality_rules.OP10_SQL}
