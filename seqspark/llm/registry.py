"""Queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline
from seqspark.llm import decontam, gbt, html_blocks, huffman, katz, langid, lempel_ziv, near_dup, packing, pii, prefix_trie, quality_rules, structure_repair


def queries() -> dict:
    return {
        "op1_decontamination": decontam.op1_decontamination,
        "op2_pii": pii.op2_pii,
        "op3_huffman_tokens": huffman.op3_huffman_tokens,
        "op4_mixture_packing": packing.op4_mixture_packing,
        "op5_language_id": langid.op5_language_id,
        "op10_quality_classifier": gbt.op10_quality_classifier,
        "op6_katz_backoff": katz.op6_katz_backoff,
        "op7_html_extraction": html_blocks.op7_html_extraction,
        "op8_quality_rules": quality_rules.op8_quality_rules,
        "op9_near_duplicates": near_dup.op9_near_duplicates,
        "op11_relative_lz": lempel_ziv.op11_relative_lz,
        "op12_zfast_trie": prefix_trie.op12_zfast_trie,
        "op13_structure_repair": structure_repair.op13_structure_repair,
        "packing_mixture": packing.packing_mixture,
        "pipeline": corpus_pipeline.run,
        "rules_ablation": quality_rules.rules_ablation,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op8_quality_rules": quality_rules.OP8_SQL,
        "op11_relative_lz": lempel_ziv.OP11_SQL,
        "op12_zfast_trie": prefix_trie.OP12_SQL,
        "op13_structure_repair": structure_repair.OP13_SQL,
        "rules_ablation": quality_rules.ABLATION_SQL,
    }
