"""The queries of this subpackage, by name, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cotraining, decontaminate, hard_negatives, html_text, jaccard, learned_partitions, licences, packing, periodic_runs, quality_rules, secrets, suffix_arrays, suffix_automata


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_benchmark_decontamination": decontaminate.query,
        "op2_substring_dedup": suffix_automata.query,
        "op3_quality_classifier": cotraining.query,
        "op4_license_scans": licences.query,
        "op5_suffix_array_dedup": suffix_arrays.query,
        "op6_secret_scans": secrets.query,
        "op7_best_fit_packing": packing.query,
        "op8_ngram_jaccard_join": jaccard.query,
        "op9_html_extraction": html_text.query,
        "op10_quality_rules": quality_rules.query,
        "op11_hard_negative_mining": hard_negatives.query,
        "op12_approximate_nearest_neighbours": learned_partitions.query,
        "op13_periodic_run_detection": periodic_runs.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_benchmark_decontamination": decontaminate.SQL,
        "op4_license_scans": licences.SQL,
        "op10_quality_rules": quality_rules.SQL,
        "op11_hard_negative_mining": hard_negatives.SQL,
    }
