"""The registered query of each operator, and its SQL where SQL can express it."""

from __future__ import annotations

from rootflow.llm import ann, fingerprints, html_text, language, line_dedup, near_dedup, packing, source_mix, token_file, toxicity


def queries() -> dict:
    return {
        "op1_token_files": token_file.op1_token_files,
        "op2_language": language.op2_language,
        "op3_near_dedup": near_dedup.op3_near_dedup,
        "op4_main_text": html_text.op4_main_text,
        "op5_nearest": ann.op5_nearest,
        "op6_fingerprints": fingerprints.op6_fingerprints,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_source_mix": source_mix.op8_source_mix,
        "op9_line_dedup": line_dedup.op9_line_dedup,
        "op10_best_fit_packing": packing.op10_best_fit_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_near_dedup": near_dedup.OP3_SQL, "op9_line_dedup": line_dedup.OP9_SQL}
