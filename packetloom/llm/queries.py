"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontaminate, fuzzy_passages, license_scan, line_dedup, ngram_join, packing, quality_rank, quality_rules, suffix_dedup, token_store


def queries() -> dict:
    return {f.__name__: f for f in (packing.op1_best_fit_packing, token_store.op5_token_store, ngram_join.op6_ngram_jaccard_join, quality_rules.op2_quality_rules, quality_rank.op3_quality_classifier, decontaminate.op4_benchmark_decontamination, line_dedup.op9_line_dedup, suffix_dedup.op8_suffix_array_dedup, fuzzy_passages.op7_substring_dedup, license_scan.op10_license_scan)}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_quality_rules": quality_rules.OP2_SQL,
        "op4_benchmark_decontamination": decontaminate.OP4_SQL,
        "op6_ngram_jaccard_join": ngram_join.OP6_SQL,
        "op8_suffix_array_dedup": suffix_dedup.OP8_SQL,
        "op9_line_dedup": line_dedup.OP9_SQL,
        "op10_license_scan": license_scan.OP10_SQL,
    }
