"""The registered queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from slickwatch.llm import (
    bpe, cross_entropy, exact, interaction, language, line_dedup, neighbours, packing, quality, simhash, token_counts, toxicity, whitening,
)

QUERIES = {
    "op1_quality_classifier": quality.op1_quality_classifier,
    "op2_simhash_near_dedup": simhash.op2_simhash,
    "op3_bpe": bpe.op3_bpe,
    "op4_exact_dedup": exact.op4_exact_dedup,
    "op5_packing": packing.op5_packing,
    "op6_lm_scoring": cross_entropy.op6_lm_scoring,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_ann": neighbours.op8_ann,
    "op9_language_id": language.op9_language_id,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_filter_interaction": interaction.op11_filter_interaction,
    "op12_line_dedup": line_dedup.op12_line_dedup,
    "op13_whitening": whitening.op13_whitening,
}
ORACLES = {
    "op4_exact_dedup": exact.ORACLE_OP4,
    "op11_filter_interaction": interaction.ORACLE_OP11,
    "op12_line_dedup": line_dedup.ORACLE_OP12,
}
