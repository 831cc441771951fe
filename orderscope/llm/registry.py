"""Queries of the subpackage and their DuckDB SQL."""

from __future__ import annotations

from . import bpe_tree, chat_rotation, collocations, decontaminate, lm_scoring, mixing, ngram_jaccard, quality_classifier, quality_rules, sharding, substring_dedup, token_files, whitening


def queries() -> dict:
    return {
        "op1_quality_rules": quality_rules.op1_quality_rules,
        "op2_substring_dedup": substring_dedup.op2_substring_dedup,
        "op3_token_files": token_files.op3_token_files,
        "op4_ngram_jaccard": ngram_jaccard.op4_ngram_jaccard,
        "op5_decontamination": decontaminate.op5_decontamination,
        "op6_chat_rotation": chat_rotation.op6_chat_rotation,
        "op7_lm_scoring": lm_scoring.op7_lm_scoring,
        "op8_mixing": mixing.op8_mixing,
        "op9_sharding": sharding.op9_sharding,
        "op10_quality_classifier": quality_classifier.op10_quality_classifier,
        "op11_collocations": collocations.op11_collocations,
        "op12_whitening": whitening.op12_whitening,
        "op13_bpe_tree": bpe_tree.op13_bpe_tree,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality_rules.SQL,
        "op2_substring_dedup": substring_dedup.SQL,
        "op4_ngram_jaccard": ngram_jaccard.SQL,
        "op5_decontamination": decontaminate.SQL,
        "op6_chat_rotation": chat_rotation.SQL,
        "op11_collocations": collocations.SQL,
    }
