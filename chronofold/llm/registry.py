"""Queries of the text operators by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronofold.llm import decontaminate, html_text, knn, language, lines, near_duplicates, packing, quality, repair, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_repair_tokens": repair.op1_repair_tokens,
    "op2_quality": quality.op2_quality,
    "op3_line_classes": lines.op3_line_classes,
    "op4_near_duplicates": near_duplicates.op4_near_duplicates,
    "op5_top_k": knn.op5_top_k,
    "op6_decontamination": decontaminate.op6_decontamination,
    "op7_harmonic_packing": packing.op7_harmonic_packing,
    "op8_main_text": html_text.op8_main_text,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_language": language.op10_language,
}

SQL: dict[str, str] = {"op4_near_duplicates": near_duplicates.OP4_SQL, "op5_top_k": knn.OP5_SQL, "op6_decontamination": decontaminate.OP6_SQL}
