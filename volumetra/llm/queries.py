"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from volumetra.llm import centroids, hostrules, htmltext, infill, licences, linededup, mixing, ngramjoin, packing, quality, suffixtree, tokencount, topk


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": linededup.query,
        "op2_html_text": htmltext.query,
        "op3_source_mix": mixing.query,
        "op4_ngram_join": ngramjoin.query,
        "op5_host_rules": hostrules.query,
        "op6_token_counts": tokencount.query,
        "op7_quality_classifier": quality.query,
        "op8_window_packing": packing.query,
        "op9_licence_scan": licences.query,
        "op10_exact_topk": topk.query,
        "op11_suffix_tree": suffixtree.query,
        "op12_centroid_clusters": centroids.query,
        "op13_fill_in_middle": infill.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": linededup.SQL,
        "op3_source_mix": mixing.SQL,
        "op5_host_rules": hostrules.SQL,
        "op10_exact_topk": topk.SQL,
        "op12_centroid_clusters": centroids.SQL,
        "op13_fill_in_middle": infill.SQL,
    }
