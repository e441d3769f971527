"""Sums over attempts and over scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import ratio

ATTEMPT_SUMS = ["input_bytes", "prompt_tokens", "generated_tokens", "output_bytes", "records_produced"]


def attempt_metrics(attempts: DataFrame) -> DataFrame:
    """One row: sums over all attempts, those included that were split and tried again.

    leaf_input_bytes counts the input of attempts that were not split, so that no
    byte counts twice.
    """
    leaf = F.col("outcome") != "split"
    return attempts.agg(
        F.count("*").alias("chunks_processed"),
        F.count_if("retried").alias("chunks_retried"),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ATTEMPT_SUMS],
        F.coalesce(F.sum(F.when(leaf, F.col("input_bytes"))), F.lit(0)).cast("long").alias("leaf_input_bytes"),
    )


def throughput(metrics: DataFrame, seconds: float) -> DataFrame:
    """`metrics` with generated tokens a second, 0 for no time."""
    return metrics.withColumn("tokens_per_second", ratio(F.col("generated_tokens"), F.lit(seconds)))


def quality_summary(scores: DataFrame) -> DataFrame:
    """One row of counts, sums and ratios over scored samples; sums are taken first, then divided.

    record_recall leaves out the records of samples whose extraction failed, as
    those were never compared; record_recall_strict, given the column
    all_expected_records, counts them as missed. A ratio of nothing is 0.
    """
    sums = ["expected_records", "actual_records", "matched_records", "missing_records", "extra_records", "expected_fields", "correct_fields", "incorrect_fields", "missing_fields", "unexpected_fields"]
    total = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in sums]
    if "all_expected_records" in scores.columns:
        total.append(F.coalesce(F.sum("all_expected_records"), F.lit(0)).cast("long").alias("all_expected_records"))
    counts = [F.count_if(c).alias(n) for c, n in (("exact_match", "exact_matches"), ("json_valid", "json_valid"), ("schema_valid", "schema_valid"), ("order_correct", "order_correct"))]
    out = scores.agg(F.count("*").alias("samples"), *counts, *total)
    ratios = {
        "record_recall": ("matched_records", "expected_records"), "record_precision": ("matched_records", "actual_records"),
        "field_accuracy": ("correct_fields", "expected_fields"), "unexpected_field_rate": ("unexpected_fields", "expected_fields"),
        "json_valid_rate": ("json_valid", "samples"), "schema_valid_rate": ("schema_valid", "samples"), "order_correct_rate": ("order_correct", "samples"),
    }
    if "all_expected_records" in scores.columns:
        ratios["record_recall_strict"] = ("matched_records", "all_expected_records")
    return out.withColumns({name: ratio(F.col(n), F.col(d)) for name, (n, d) in ratios.items()})
