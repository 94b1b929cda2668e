"""The queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import annsearch, convrepair, fillmiddle, htmlcrf, linededup, mixing, nearjoin, packing, pii, quality, topk, toxicity, urlfilter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": linededup.op1_line_dedup,
        "op2_pii": pii.op2_pii,
        "op3_ngram_jaccard": nearjoin.op3_ngram_jaccard,
        "op4_topk": topk.op4_topk,
        "op5_quality_rules": quality.op5_quality_rules,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_mixing": mixing.op7_mixing,
        "op8_packing": packing.op8_packing,
        "op9_html_extraction": htmlcrf.op9_html_extraction,
        "op10_url_filter": urlfilter.op10_url_filter,
        "op11_fill_in_middle": fillmiddle.op11_fill_in_middle,
        "op12_conversation_repair": convrepair.op12_conversation_repair,
        "op13_nearest_neighbours": annsearch.op13_nearest_neighbours,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": linededup.op1_sql(),
        "op4_topk": topk.op4_sql(),
        "op5_quality_rules": quality.op5_sql(),
        "op7_mixing": mixing.op7_sql(),
        "op11_fill_in_middle": fillmiddle.op11_sql(),
        "op12_conversation_repair": convrepair.op12_sql(),
    }
