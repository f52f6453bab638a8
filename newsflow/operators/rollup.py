"""Members of an event to one event row, through one row per event and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsflow import params
from newsflow.functions import scores
from newsflow.operators.merging import KEY
from newsflow.session import small


def exact_sum(value: Column) -> Column:
    """Sum in decimals: the same whatever order the partitions arrive in.

    Scores decide ranks, so a last-digit difference between two runs must not occur.
    """
    return F.sum(value.cast("decimal(28,10)")).cast("double")


def per_source(merged: DataFrame) -> DataFrame:
    """Pre-aggregate at (event, source): everything later steps need, bounded by the sources.

    A source's weight is constant here, so weighted sums need only the plain sums.
    """
    sign = scores.sentiment_sign(F.col("sentiment_label"))
    first_report = F.min(F.struct("at", "source_url"))
    return merged.groupBy("event_id", *KEY, "source_name").agg(
        F.count(F.lit(1)).alias("articles"),
        F.min("at").alias("first_at"),
        F.max("at").alias("last_at"),
        first_report["source_url"].alias("first_url"),
        F.count("sentiment_score").alias("scored"),
        exact_sum(F.col("sentiment_score") * sign).alias("signed_sum"),
        exact_sum(F.col("sentiment_score")).alias("strength_sum"),
    )


def active_sources(sources: DataFrame) -> DataFrame:
    return sources.where(F.col("is_active")).select("source_name", "authority_weight")


def with_authority(rows: DataFrame, sources: DataFrame, priority: Column | None = None) -> DataFrame:
    """Adds ``weight``: the active source's authority, else the default of its priority class."""
    default = F.lit(params.DEFAULT_AUTHORITY["P3"])
    if priority is not None:
        for name in ("P1", "P2"):
            default = F.when(priority == name, F.lit(params.DEFAULT_AUTHORITY[name])).otherwise(default)
    return (
        rows.join(small(active_sources(sources)), "source_name", "left")
        .withColumn("weight", F.coalesce("authority_weight", default))
        .drop("authority_weight")
    )


def events(by_source: DataFrame) -> DataFrame:
    """Event rows: distinct sources, first report of each source, first and last time.

    The array has one entry per source, so its length is the source count.  All reports of an
    event are in ``source_articles``.
    """
    return by_source.groupBy("event_id", *KEY).agg(*_event_columns())


def _event_columns() -> list[Column]:
    entry = F.struct(
        "source_name", F.col("first_url").alias("url"), F.timestamp_micros("first_at").alias("published_at")
    )
    return [
        F.count(F.lit(1)).alias("source_count"),
        F.sum("articles").alias("article_count"),
        F.sort_array(F.collect_list(entry)).alias("source_list"),
        F.timestamp_micros(F.min("first_at")).alias("first_seen_at"),
        F.timestamp_micros(F.max("last_at")).alias("last_seen_at"),
    ]


def source_articles(merged: DataFrame) -> DataFrame:
    """Distinct (event, source, address, time): the attribution in long form."""
    return merged.select("event_id", "source_name", F.col("source_url").alias("url"), "at").distinct()


def secondary_types(merged: DataFrame, limit: int = params.SECONDARY_TYPES_MAX) -> DataFrame:
    """Most frequent secondary types of each event, the primary one excluded; ties by name."""
    counted = (
        merged.where(F.col("event_type_secondary") != F.col("event_type_primary"))
        .groupBy("event_id", "event_type_secondary")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    order = W.partitionBy("event_id").orderBy(F.col("n").desc(), "event_type_secondary")
    return (
        counted.withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= limit)
        .groupBy("event_id")
        .agg(F.sort_array(F.collect_list(F.struct("place", "event_type_secondary"))).alias("_types"))
        .select("event_id", F.col("_types.event_type_secondary").alias("event_type_secondary"))
    )


def sentiment(weighted: DataFrame, threshold: float = params.SENTIMENT_THRESHOLD) -> DataFrame:
    """Authority-weighted sentiment per event, with the greatest authority of its sources.

    Input: ``per_source`` rows with ``weight``.
    """
    grouped = weighted.groupBy("event_id").agg(*_sentiment_columns())
    return grouped.withColumn("sentiment_label", scores.sentiment_label(F.col("weighted_sentiment"), threshold))


def _sentiment_columns() -> list[Column]:
    total = F.nullif(exact_sum(F.col("weight") * F.col("scored")), F.lit(0.0))
    return [
        (exact_sum(F.col("weight") * F.col("signed_sum")) / total).alias("weighted_sentiment"),
        (exact_sum(F.col("weight") * F.col("strength_sum")) / total).alias("sentiment_strength"),
        F.max("weight").alias("authority"),
    ]


def events_with_sentiment(weighted: DataFrame, threshold: float = params.SENTIMENT_THRESHOLD) -> DataFrame:
    """Event rows with their sentiment, from one grouping of ``per_source`` rows with ``weight``."""
    grouped = weighted.groupBy("event_id", *KEY).agg(*_event_columns(), *_sentiment_columns())
    return grouped.withColumn("sentiment_label", scores.sentiment_label(F.col("weighted_sentiment"), threshold))


def members(event_rows: DataFrame, event_map: DataFrame, entity_events: DataFrame) -> DataFrame:
    """Events with their entity events, through the map.

    The map and the entity events meet first on the entity key, which is unique on both sides.
    """
    return event_map.select("event_id", "entity_event_id").join(entity_events, "entity_event_id").join(
        event_rows.select("event_id", "first_seen_at", "last_seen_at"), "event_id"
    )
