"""Offline scoring of dispatcher decisions against the action rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetline.functions.rules import expected_action, normal_text


def _scored(decisions: DataFrame) -> DataFrame:
    """Rows that carry an alert type and a headway, with the expected and the actual action."""
    return (
        decisions.filter(F.col("alert_type").isNotNull() & F.col("headway_seconds").isNotNull())
        .withColumn("expected", expected_action(F.col("alert_type"), F.col("headway_seconds")))
        .withColumn("actual", normal_text(F.col("action")))
    )


def score_decisions(decisions: DataFrame) -> DataFrame:
    """One row of totals; accuracy is 1.0 without rows, the agreement rate null without suggestions."""
    right = F.col("actual") == F.col("expected")
    suggested = F.coalesce(F.col("llm_action"), F.lit("")) != ""
    agrees = suggested & (normal_text(F.col("llm_action")) == F.col("expected"))
    totals = _scored(decisions).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(right).alias("action_correct"),
        F.count_if(~right).alias("action_wrong"), F.count_if(suggested).alias("llm_present"),
        F.count_if(agrees).alias("llm_agreement"))
    return totals.select(
        "*",
        F.coalesce(F.col("action_correct") / F.nullif(F.col("total"), F.lit(0)), F.lit(1.0)).alias("action_accuracy"),
        (F.col("llm_agreement") / F.nullif(F.col("llm_present"), F.lit(0))).alias("llm_agreement_rate"))


def decision_mismatches(decisions: DataFrame) -> DataFrame:
    return (
        _scored(decisions).filter(F.col("actual") != F.col("expected"))
        .select("route_id", "stop_id", "alert_type", "headway_seconds", "expected",
                F.when(F.col("actual") == "", "(empty)").otherwise(F.col("actual")).alias("actual"))
    )
