"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline

from . import decontaminate, language_id, license_scan, line_dedup, lm_scoring, media, near_dedup, sentencepiece, suffix_dedup, url_filter


def queries() -> dict:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
        "op10_line_dedup": line_dedup.op10_line_dedup,
        "op2_sentencepiece": sentencepiece.op2_sentencepiece,
        "op3_decontamination": decontaminate.op3_decontamination,
        "op4_language_id": language_id.op4_language_id,
        "op5_url_filter": url_filter.op5_url_filter,
        "op6_media_columns": media.op6_media_columns,
        "op7_license_scan": license_scan.op7_license_scan,
        "op8_near_duplicates": near_dedup.op8_near_duplicates,
        "op9_lm_scoring": lm_scoring.op9_lm_scoring,
    }


def oracle_sql() -> dict[str, str]:
    found = {"op1_suffix_dedup": suffix_dedup.ORACLE, "op5_url_filter": url_filter.ORACLE, "op7_license_scan": license_scan.ORACLE, "op8_near_duplicates": near_dedup.ORACLE}
    if corpus_pipeline.ORACLE_SQL is not None:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
