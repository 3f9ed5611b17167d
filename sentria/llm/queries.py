"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sentria.llm import binary_output, decontamination, html_extraction, license_scan, near_dedup, packing, pii, substring_dedup, toxicity, vector_search


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": decontamination.op1_decontamination,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_license_scan": license_scan.op3_license_scan,
        "op4_near_dedup": near_dedup.op4_near_dedup,
        "op5_packing": packing.op5_packing,
        "op6_html_extraction": html_extraction.op6_html_extraction,
        "op7_vector_search": vector_search.op7_vector_search,
        "op8_substring_dedup": substring_dedup.op8_substring_dedup,
        "op9_token_ids": binary_output.op9_token_ids,
        "op10_pii": pii.op10_pii,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": decontamination.SQL,
        "op3_license_scan": license_scan.SQL,
        "op4_near_dedup": near_dedup.SQL,
        "op7_vector_search": vector_search.SQL,
    }
