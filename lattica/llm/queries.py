"""The queries of this subpackage and, where SQL can state them, their DuckDB oracles."""

from __future__ import annotations

from . import exact_dedup, line_dedup, mixing, near_dedup, packing, repeats, token_counts, token_files, topk, toxicity

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_repeats": repeats.op5_repeats,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_mixing": mixing.op7_mixing,
    "op8_token_files": token_files.op8_token_files,
    "op9_topk": topk.op9_topk,
    "op10_packing": packing.op10_packing,
}

ORACLES = {
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op9_topk": topk.ORACLE,
}
