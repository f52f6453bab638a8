"""Continuous cleaning: raw rows to cleaned, rejected and quarantined rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from newsflow import params, schemas
from newsflow.operators import cleaning
from newsflow.sources import tables
from newsflow.streaming import delivery

REJECTIONS = T.StructType([T.StructField(c, T.StringType()) for c in ("raw_id", "source_name", "reject_reason")])


def cleaning_step(root: str, body_min_length: int = params.BODY_MIN_LENGTH):
    """Step writing ``cleaned`` and ``rejected`` under ``root``, one folder per batch.

    A row delivered again, in this batch or after an earlier one, is not cleaned twice.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        earlier = tables.read_batches(spark, f"{root}/cleaned", schemas.CLEANED_NEWS, before=batch_id)
        fresh = cleaning.not_yet_cleaned(cleaning.live(batch).dropDuplicates(["raw_id"]), earlier)
        assessed = cleaning.assess(fresh, body_min_length).persist()
        try:
            tables.write_batch(cleaning.accepted(assessed, F.col("created_at")), f"{root}/cleaned", batch_id)
            tables.write_batch(cleaning.rejections(assessed), f"{root}/rejected", batch_id)
        finally:
            assessed.unpersist()

    return step


def start_cleaning(raw: DataFrame, root: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    return delivery.start(raw, cleaning_step(root), checkpoint, every)


def checked_step(root: str, expected_version: int = 1, most: int = params.MAX_DELIVERIES):
    """Step for rows with a schema version ``v``: good rows are cleaned, faulty ones retried
    with the next batches and quarantined after ``most`` deliveries."""
    clean = cleaning_step(root)

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        arrived = batch.withColumn("delivery_count", F.lit(1))
        pending = f"{root}/pending/batch_id={batch_id - 1}"
        if tables.exists(spark, pending):
            arrived = arrived.unionByName(spark.read.schema(arrived.schema).parquet(pending))
        good, retry, dead = delivery.settle(arrived, delivery.version_error(F.col("v"), expected_version), most)
        tables.write_batch(retry, f"{root}/pending", batch_id)
        letters = tables.quarantine(dead, F.col("error_detail"), "cleaning", F.col("created_at"))
        tables.write_batch(letters, f"{root}/dead", batch_id)
        clean(good.drop("delivery_count", "v"), batch_id)

    return step


def for_analysis(cleaned: DataFrame, raw: DataFrame) -> DataFrame:
    """Stream of cleaned rows with the columns of their stored raw row."""
    return cleaning.with_raw_columns(cleaned, raw)
