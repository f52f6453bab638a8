"""Score arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsflow import params


def clip(value: Column, low: float, high: float) -> Column:
    return F.when(value.isNotNull(), F.greatest(F.least(value, F.lit(high)), F.lit(low)))


def out_of_range(value: Column, low: float, high: float) -> Column:
    return F.coalesce((value < low) | (value > high), F.lit(False))


def secondary_type(primary: Column, secondary: Column) -> Column:
    """Null when it repeats the primary type."""
    return F.nullif(secondary, primary)


def sentiment_sign(label: Column) -> Column:
    sign = F.when(label == "POSITIVE", F.lit(params.SENTIMENT_SIGN["POSITIVE"]))
    return sign.when(label == "NEGATIVE", F.lit(params.SENTIMENT_SIGN["NEGATIVE"])).otherwise(F.lit(0))


def direction(impact: Column, label: Column) -> Column:
    """Sign of the impact; of the sentiment label where the impact is 0."""
    return F.when(impact != 0, F.signum(impact).cast("int")).otherwise(sentiment_sign(label))


def sentiment_label(weighted: Column, threshold: float = params.SENTIMENT_THRESHOLD) -> Column:
    return (
        F.when(weighted > threshold, "POSITIVE").when(weighted < -threshold, "NEGATIVE").otherwise("NEUTRAL")
    )


def recency(updated_at: Column, as_of: Column, decay: float = params.RECENCY_DECAY) -> Column:
    """10·e^(−λ·hours) between the last aggregation and the given clock."""
    hours = (F.unix_micros(as_of) - F.unix_micros(updated_at)) / F.lit(3_600_000_000)
    return F.lit(10.0) * F.exp(F.lit(-decay) * hours)


def event_type_score(event_type: Column, table: dict[str, float] | None = None) -> Column:
    table = table or params.EVENT_TYPE_SCORE
    score = F.lit(None).cast("double")
    for name, value in table.items():
        score = F.when(event_type == name, F.lit(value)).otherwise(score)
    return F.coalesce(score, F.lit(params.UNKNOWN_TYPE_SCORE))


def heat(source_count: Column) -> Column:
    return F.least(F.lit(params.HEAT_MAX), F.lit(params.HEAT_PER_SOURCE) * source_count)


def base_rule_score(
    type_score: Column, authority: Column, sentiment: Column, heat_score: Column,
    weights: dict[str, float] | None = None,
) -> Column:
    """Unsigned weighted sum of the four dimensions; no recency."""
    w = weights or params.DIMENSION_WEIGHT
    return (
        type_score * w["event_type"] + authority * w["authority"]
        + sentiment * w["sentiment"] + heat_score * w["heat"]
    )


def fused(rule: Column, impact: Column, sign: Column | None = None) -> Column:
    """|rule · direction · 0.67 + impact · 0.66|; without ``sign`` the rule score stays unsigned."""
    signed = rule if sign is None else rule * sign
    return F.abs(signed * params.RULE_WEIGHT + impact * params.IMPACT_WEIGHT)


def with_recency(rule: Column, recency_score: Column) -> Column:
    return rule + recency_score * params.RECENCY_WEIGHT
