"""Raw rows to accepted and rejected rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsflow import params
from newsflow.functions import text
from newsflow.session import distinct_keys, small


def live(raw: DataFrame) -> DataFrame:
    return raw.where(~F.col("is_deleted"))


def source_check(source: Column, allowed: list[str] | None = None) -> Column:
    """Null for a known source, else an error text."""
    known = source.isin(list(allowed or params.SOURCE_AUTHORITY))
    return F.when(~F.coalesce(known, F.lit(False)), F.concat(F.lit("unknown source: "), text.or_empty(source)))


def assess(raw: DataFrame, body_min_length: int = params.BODY_MIN_LENGTH) -> DataFrame:
    """Adds title_cleaned, body_cleaned and reject_reason.

    Emptiness is tested on the raw text, length on the normalised text.
    """
    empty = (text.or_empty(F.col("title")) == "") | (text.or_empty(F.col("body")) == "")
    return (
        raw.withColumn("title_cleaned", text.normalise(F.col("title")))
        .withColumn("body_cleaned", text.normalise(F.col("body")))
        .withColumn(
            "reject_reason",
            F.when(empty, params.EMPTY_FIELD).when(
                F.length("body_cleaned") < body_min_length, params.BODY_TOO_SHORT
            ),
        )
    )


def accepted(assessed: DataFrame, created_at: Column, *carried: str) -> DataFrame:
    """Rows of the cleaned table; ``carried`` columns of the raw rows come along, without a join back to them."""
    return assessed.where(F.col("reject_reason").isNull()).select(
        text.derived_id(F.col("raw_id")).alias("cleaned_id"),
        "raw_id",
        "title_cleaned",
        "body_cleaned",
        created_at.alias("created_at"),
        *carried,
    )


def rejections(assessed: DataFrame) -> DataFrame:
    return assessed.where(F.col("reject_reason").isNotNull()).select("raw_id", "source_name", "reject_reason")


def not_yet_cleaned(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Raw rows without a cleaned row.  Only the key of the cleaned table is read."""
    return raw.join(cleaned.select("raw_id"), "raw_id", "left_anti")


def soft_delete(raw: DataFrame, rejected: DataFrame) -> DataFrame:
    """New snapshot of the raw table with the rejected rows marked.

    ``rejected`` has one row per raw_id.
    """
    marks = rejected.select("raw_id", F.col("reject_reason").alias("_reason"))
    return (
        raw.join(marks, "raw_id", "left")
        .withColumn("is_deleted", F.col("is_deleted") | F.col("_reason").isNotNull())
        .withColumn("deleted_reason", F.coalesce("_reason", "deleted_reason"))
        .drop("_reason")
    )


def skip_failed_urls(articles: DataFrame, error_log: DataFrame, url: str = "source_url",
                     since: Column | None = None) -> DataFrame:
    """Articles whose address is not in the error log, optionally only since a given time."""
    log = error_log if since is None else error_log.where(F.col("created_at") >= since)
    return articles.join(distinct_keys(log.select(F.col("url").alias(url)), url), url, "left_anti")


def with_raw_columns(cleaned: DataFrame, raw: DataFrame) -> DataFrame:
    """Cleaned rows with publish time, source and address of their raw row.

    No filter on deletion.  Four columns of the raw table are read, never its body.
    """
    return cleaned.join(raw.select("raw_id", "published_at", "source_name", "source_url"), "raw_id")


def lookup_one(table: DataFrame, cleaned_id: str) -> DataFrame:
    return table.where(F.col("cleaned_id") == cleaned_id)


def lookup_batch(table: DataFrame, cleaned_ids: list[str]) -> DataFrame:
    """Rows of 1 to 50 identifiers; repeats collapse and unknown ones are left out.

    The list is bounded, so it is sent as an IN filter that reaches the scan.
    """
    if not 1 <= len(cleaned_ids) <= params.LOOKUP_MAX_IDS:
        raise ValueError(f"between 1 and {params.LOOKUP_MAX_IDS} identifiers, got {len(cleaned_ids)}")
    return table.where(F.col("cleaned_id").isin(sorted(set(cleaned_ids))))


def lookup_many(table: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows whose identifier occurs in a table of identifiers of any size."""
    return table.join(small(wanted.select("cleaned_id").distinct()), "cleaned_id", "left_semi")
