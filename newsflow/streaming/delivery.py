"""Bounded reads, schema-version check, retries and dead letters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from newsflow import params
from newsflow.operators import ranges
from newsflow.session import scratch
from newsflow.sources import tables


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    """New rows of a stored table.  The table is the signal: no separate message is sent."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def start(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str,
          every: str | None = None) -> StreamingQuery:
    """Run ``step`` on every micro-batch; without ``every`` stop when the input is used up.

    A failed batch is replayed under the same id from the checkpoint, so a step that writes to
    folders named by the id has the same effect however often it runs.
    """

    def tidy_step(batch: DataFrame, batch_id: int) -> None:
        with scratch(batch.sparkSession):
            step(batch, batch_id)

    writer = stream.writeStream.foreachBatch(tidy_step).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def version_error(version: Column, expected: int = 1) -> Column:
    """Error text for a row of another schema version, else null."""
    return F.when(
        F.coalesce(version != expected, F.lit(True)),
        F.concat(F.lit("schema version "), F.coalesce(version.cast("string"), F.lit("missing"))),
    )


def once(rows: DataFrame, key: str) -> DataFrame:
    """One row per key.  Rows are dealt out first, so that only the receiving side sorts them."""
    return rows.repartition(key).dropDuplicates([key])


def settle(rows: DataFrame, error: Column, most: int = params.MAX_DELIVERIES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(good, retry, dead) of rows that carry ``delivery_count``.

    A faulty row is handed out again until it has been delivered ``most`` times.
    """
    checked = rows.withColumn("error_detail", error)
    bad = F.col("error_detail").isNotNull()
    spent = F.col("delivery_count") >= most
    return (
        checked.where(~bad).drop("error_detail"),
        checked.where(bad & ~spent).drop("error_detail").withColumn("delivery_count", F.col("delivery_count") + 1),
        checked.where(bad & spent),
    )


def without_repeats(stream: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """Drops repeats of a key that arrive within the delay; state is bounded by it."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def counting_step(root: str, group: str, value: str):
    """Step keeping the merged value counts of a stream of samples as versions under ``root``; a version is as small as its cells."""

    def step(batch: DataFrame, batch_id: int) -> None:
        counts = ranges.value_counts(batch, group, value)
        if tables.exists(batch.sparkSession, f"{root}/version={batch_id - 1}"):
            counts = counts.unionByName(tables.published(batch.sparkSession, root, batch_id - 1))
        tables.publish(ranges.merged_counts(counts, group), root, batch_id)

    return step
