"""Event scores: rule score, impact, fusion, and the time-dependent final score."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsflow import params
from newsflow.functions import scores, text


def rule_scores(event_rows: DataFrame, sentiment: DataFrame | None, type_scores: dict[str, float] | None = None,
                weights: dict[str, float] | None = None) -> DataFrame:
    """Adds the four dimension scores and base_rule_score (unsigned, without recency).

    Without ``sentiment`` the event rows carry its columns (``rollup.events_with_sentiment``).
    """
    rows = event_rows if sentiment is None else event_rows.join(sentiment, "event_id")
    return (
        rows.withColumn("event_type_score", scores.event_type_score(F.col("event_type_primary"), type_scores))
        .withColumn("source_authority_score", F.col("authority"))
        .withColumn("sentiment_strength_score", F.col("sentiment_strength") * params.SENTIMENT_SCALE)
        .withColumn("source_heat_score", scores.heat(F.col("source_count")))
        .withColumn(
            "base_rule_score",
            scores.base_rule_score(
                F.col("event_type_score"), F.col("source_authority_score"),
                F.coalesce("sentiment_strength_score", F.lit(0.0)), F.col("source_heat_score"), weights,
            ),
        )
    )


def checked_impact(impact: DataFrame) -> DataFrame:
    """Impact rows within [-5, 5]; a row without a reason does not count as scored."""
    low, high = -5.0, 5.0
    reason = text.strip(text.or_empty(F.col("adjustment_reason")))
    limit = params.TEXT_LIMITS["adjustment_reason"]
    return impact.where(reason != "").select(
        "event_id",
        scores.clip(F.col("stock_impact_score"), low, high).alias("stock_impact_score"),
        text.truncate(F.col("adjustment_reason"), limit).alias("adjustment_reason"),
        (scores.out_of_range(F.col("stock_impact_score"), low, high)
         | text.exceeds(F.col("adjustment_reason"), limit)).alias("violation"),
    )


def with_impact(event_rows: DataFrame, impact: DataFrame | None) -> DataFrame:
    """Adds stock_impact_score and llm_fallback; an event without an impact row gets 0 and true."""
    if impact is None:
        return (
            event_rows.withColumn("stock_impact_score", F.lit(0.0))
            .withColumn("adjustment_reason", F.lit(None).cast("string"))
            .withColumn("llm_fallback", F.lit(True))
        )
    joined = event_rows.join(checked_impact(impact).drop("violation"), "event_id", "left")
    return joined.withColumn("llm_fallback", F.col("stock_impact_score").isNull()).withColumn(
        "stock_impact_score", F.coalesce("stock_impact_score", F.lit(0.0))
    )


def fuse(scored: DataFrame, scored_at: Column) -> DataFrame:
    """Adds direction and the stored abs_final_score (without recency)."""
    sign = scores.direction(F.col("stock_impact_score"), F.col("sentiment_label"))
    return (
        scored.withColumn("direction", sign)
        .withColumn(
            "abs_final_score",
            scores.fused(F.col("base_rule_score"), F.col("stock_impact_score"), F.col("direction")),
        )
        .withColumn("scored_at", scored_at)
    )


def current_only(work: DataFrame, event_rows: DataFrame) -> DataFrame:
    """Work items whose aggregation version is still the event's; the rest is superseded."""
    version = event_rows.select("event_id", "aggregation_updated_at")
    return work.join(version, ["event_id", "aggregation_updated_at"], "left_semi")


def final_scores(event_scores: DataFrame, as_of: Column, apply_direction: bool = True) -> DataFrame:
    """Adds recency_score, final_base_rule_score and final_abs_final_score at the given clock.

    ``apply_direction=False`` leaves the rule score unsigned in the final score.
    """
    sign = F.col("direction") if apply_direction else None
    return (
        event_scores.withColumn("recency_score", scores.recency(F.col("aggregation_updated_at"), as_of))
        .withColumn("final_base_rule_score", scores.with_recency(F.col("base_rule_score"), F.col("recency_score")))
        .withColumn(
            "final_abs_final_score",
            scores.fused(F.col("final_base_rule_score"), F.col("stock_impact_score"), sign),
        )
    )


def apply_scorer(rows: DataFrame, scorer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Runs a user-supplied step ``DataFrame -> DataFrame`` that must keep ``event_id``."""
    result = scorer(rows)
    if "event_id" not in result.columns:
        raise ValueError("a scorer must keep the column event_id")
    return result
