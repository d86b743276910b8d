"""The queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontam, jaccard_join, langid, line_dedup, mixing, quality, sharding, substring_arrays, substring_windows, token_output


def queries() -> dict:
    return {
        "op1_decontamination": decontam.op1_decontamination,
        "op2_quality_rules": quality.op2_quality_rules,
        "op3_line_dedup": line_dedup.op3_line_dedup,
        "op4_language_id": langid.op4_language_id,
        "op5_jaccard_join": jaccard_join.op5_jaccard_join,
        "op6_token_output": token_output.op6_token_output,
        "op7_sharding": sharding.op7_sharding,
        "op8_substring_dedup": substring_windows.op8_substring_dedup,
        "op9_mixing": mixing.op9_mixing,
        "op10_suffix_array_dedup": substring_arrays.op10_suffix_array_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": decontam.SQL, "op3_line_dedup": line_dedup.SQL}
