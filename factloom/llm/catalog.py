"""Queries of the training-data operators and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import ball_tree, decontaminate, jaccard_join, license_scan, line_dedup, mixing, quality, suffix_dedup, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": suffix_dedup.query,
        "op2_exact_top_k": ball_tree.query,
        "op3_license_scan": license_scan.query,
        "op4_line_dedup": line_dedup.query,
        "op5_warc": warc.query,
        "op6_decontaminate": decontaminate.query,
        "op7_toxicity": toxicity.query,
        "op8_jaccard_join": jaccard_join.query,
        "op9_quality": quality.query,
        "op10_mixing": mixing.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_suffix_dedup": suffix_dedup.SQL,
        "op2_exact_top_k": ball_tree.SQL,
        "op3_license_scan": license_scan.SQL,
        "op4_line_dedup": line_dedup.SQL,
        "op5_warc": warc.SQL,
        "op8_jaccard_join": jaccard_join.SQL,
    }
