"""Queries of this subpackage, by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from . import decontaminate, line_dedup, lm_scoring, mixing, pipeline, quality, quality_rules, simhash, token_counts, toxicity, warc


def queries() -> dict:
    return {
        "pipeline": pipeline.run,
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_benchmark_decontamination": decontaminate.op2_benchmark_decontamination,
        "op3_line_dedup": line_dedup.op3_line_dedup,
        "op4_source_mixing": mixing.op4_source_mixing,
        "op5_quality_classifier": quality.op5_quality_classifier,
        "op6_simhash_near_dedup": simhash.op6_simhash_near_dedup,
        "op7_warc": warc.op7_warc,
        "op8_lm_scoring": lm_scoring.op8_lm_scoring,
        "op9_token_counts": token_counts.op9_token_counts,
        "op10_quality_rules": quality_rules.op10_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_warc": warc.ORACLE_SQL, "op10_quality_rules": quality_rules.ORACLE_SQL}
