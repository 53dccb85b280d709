"""The queries over the synthetic tables, by name, and their SQL where SQL can say the same."""

from __future__ import annotations

from . import ann, exact_dedup, mixing, pieces, quality, quality_rules, resampling, simhash, suffixes, token_counts, token_files, toxicity


def queries():
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_mix_sources": mixing.op2_mix_sources,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_token_counts": token_counts.op4_token_counts,
        "op5_sentencepiece": pieces.op5_sentencepiece,
        "op6_nearest": ann.op6_nearest,
        "op7_quality": quality.op7_quality,
        "op8_simhash": simhash.op8_simhash,
        "op9_repeats": suffixes.op9_repeats,
        "op10_token_files": token_files.op10_token_files,
        "op11_resample": resampling.op11_resample,
        "op12_quality_rules": quality_rules.op12_quality_rules,
    }


def oracle_sql():
    return {
        "op1_exact_dedup": exact_dedup.ORACLE_SQL,
        "op2_mix_sources": mixing.ORACLE_SQL,
        "op11_resample": resampling.ORACLE_SQL,
    }
