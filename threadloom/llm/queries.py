"""Queries of the training-data operators, and their DuckDB SQL where SQL can express them."""

from threadloom.llm import (
    op01_quality,
    op02_substring,
    op03_pii,
    op04_line_dedup,
    op05_secrets,
    op06_decontamination,
    op07_lm_scoring,
    op08_language_id,
    op09_simhash,
    op10_mixing,
    op11_conversations,
    op12_packing,
    op13_alignment,
)

QUERIES = {
    "op1_quality": op01_quality.op1_quality,
    "op2_substring": op02_substring.op2_substring,
    "op3_pii": op03_pii.op3_pii,
    "op4_line_dedup": op04_line_dedup.op4_line_dedup,
    "op5_secrets": op05_secrets.op5_secrets,
    "op6_decontamination": op06_decontamination.op6_decontamination,
    "op7_lm_scoring": op07_lm_scoring.op7_lm_scoring,
    "op8_language_id": op08_language_id.op8_language_id,
    "op9_simhash": op09_simhash.op9_simhash,
    "op10_mixing": op10_mixing.op10_mixing,
    "op11_conversations": op11_conversations.op11_conversations,
    "op12_packing": op12_packing.op12_packing,
    "op13_alignment": op13_alignment.op13_alignment,
}

ORACLES = {
    "op4_line_dedup": op04_line_dedup.ORACLE_SQL,
    "op6_decontamination": op06_decontamination.ORACLE_SQL,
    "op10_mixing": op10_mixing.ORACLE_SQL,
}
