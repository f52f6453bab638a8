"""Continuous event merging with the batch operator and a table of open events.

Every micro-batch is merged by the same slot algorithm as a batch job, with the open events of
earlier batches as seeds.  A hot key therefore spreads over its time slots here too, which a
per-key state function, one task per key, would not allow.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from newsflow.operators import merging
from newsflow.operators.merging import HOUR, KEY, Span
from newsflow.session import materialise
from newsflow.sources import tables
from newsflow.streaming import delivery

OPEN_EVENTS = T.StructType(
    [T.StructField(k, T.StringType()) for k in KEY]
    + [T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("event_id", T.StringType())]
)


@dataclass
class Merged:
    """Outcome of one micro-batch."""

    assigned: DataFrame      # reports with first and event_id
    open_events: DataFrame   # one open event per key
    late: DataFrame          # reports that could not be placed any more
    newest: int              # greatest event time seen so far


def merge_batch(reports: DataFrame, open_events: DataFrame, newest: int | None, span: Span, lateness: int) -> Merged:
    """Merge reports (key, ``at``, …) into the open events.

    A report older than the first one of its open event joins it, and lowers its first time,
    if it lies within the window before it and the event stays shorter than the cap.  Other
    reports before the open event, and reports older than the watermark, are late.
    """
    state = open_events.select(*KEY, F.col("first").alias("_first"), F.col("last").alias("_last"))
    placed = reports.join(state, KEY, "left")
    before = F.col("at") < F.col("_first")
    fits = (F.col("_first") - F.col("at") <= span.window) & (F.col("_last") - F.col("at") < span.cap)
    watermark = F.lit(None if newest is None else newest - lateness).cast("long")
    late = F.when(F.col("_first").isNull(), F.coalesce(F.col("at") < watermark, F.lit(False))).otherwise(before & ~fits)
    placed = materialise(placed.withColumn("_late", late), "placed")
    on_time = placed.where(~F.col("_late"))
    lowered = on_time.where(before).groupBy(*KEY).agg(F.min("at").alias("_low"))
    seeds = materialise(
        open_events.join(lowered, KEY, "left")
        .withColumn("first", F.coalesce(F.least("first", "_low"), "first"))
        .drop("_low"),
        "seeds",
    )
    known = seeds.select(*KEY, "first", F.col("event_id").alias("_known"))
    assigned = materialise(
        merging.assign(on_time.drop("_late", "_first", "_last"), span, seeds, near=True)
        .join(known, [*KEY, "first"], "left")
        .withColumn("event_id", F.coalesce("_known", merging.event_key(F.col("first"))))
        .drop("_known"),
        "assigned",
    )
    newest_now = placed.agg(F.max("at")).first()[0]
    newest = max(x for x in (newest, newest_now, 0) if x is not None)
    grown = assigned.groupBy(*KEY, "first", "event_id").agg(F.max("at").alias("last")).unionByName(
        seeds.select(*KEY, "first", "event_id", "last")
    )
    last_event = F.max(F.struct("first", "last", "event_id"))
    still_open = (
        grown.groupBy(*KEY).agg(last_event.alias("_e")).select(*KEY, "_e.first", "_e.last", "_e.event_id")
        .where(F.col("last") + span.window >= newest - lateness)
    )
    return Merged(assigned, still_open, placed.where(F.col("_late")).drop("_late", "_first", "_last"), newest)


def merging_step(root: str, span: Span | None = None, lateness_hours: float = 4.0):
    """Step writing ``map`` (report to event), ``events`` (changed ones), ``late`` and ``rejected`` (without key or time)
    per batch, and the open events as a snapshot named by the batch."""
    span = span or Span.hours()
    lateness = int(lateness_hours * HOUR)

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        at = merging.micros(F.coalesce("published_at", "created_at"))
        reports = materialise(delivery.once(batch, "entity_event_id").withColumn("at", at), "arrived")
        opened, newest = _state_before(spark, root, batch_id)
        tables.write_batch(merging.unplaced(reports), f"{root}/rejected", batch_id)
        merged = merge_batch(reports.dropna(subset=[*KEY, "at"]), opened, newest, span, lateness)
        tables.write_batch(merged.assigned, f"{root}/map", batch_id)
        tables.write_batch(merged.late, f"{root}/late", batch_id)
        tables.write_batch(changed_events(merged, F.timestamp_micros(F.lit(merged.newest))), f"{root}/events", batch_id)
        tables.publish(merged.open_events, f"{root}/open", batch_id)
        tables.publish(spark.range(1).select(F.lit(merged.newest).alias("newest")), f"{root}/clock", batch_id)

    return step


def changed_events(merged: Merged, stamped_at: Column) -> DataFrame:
    """Events that gained a member in the batch; the others keep their stamp."""
    return merged.assigned.groupBy("event_id", *KEY).agg(
        F.min("first").alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("gained")
    ).withColumn("aggregation_updated_at", stamped_at)


def _state_before(spark: SparkSession, root: str, batch_id: int) -> tuple[DataFrame, int | None]:
    if not tables.exists(spark, f"{root}/open/version={batch_id - 1}"):
        return spark.createDataFrame([], OPEN_EVENTS), None
    opened = spark.read.schema(OPEN_EVENTS).parquet(f"{root}/open/version={batch_id - 1}")
    return opened, tables.published(spark, f"{root}/clock", batch_id - 1).first()["newest"]


def start_merging(reports: DataFrame, root: str, checkpoint: str, span: Span | None = None,
                  every: str | None = None) -> StreamingQuery:
    """``every='60 seconds'`` is the flush interval of a running service."""
    return delivery.start(reports, merging_step(root, span), checkpoint, every)


def open_sessions(reports: DataFrame, gap: str = "4 hours", lateness: str = "4 hours") -> DataFrame:
    """Sessions by the gap alone, with Spark's own session windows and watermark."""
    timed = reports.withColumn("seen", F.coalesce("published_at", "created_at")).withWatermark("seen", lateness)
    return timed.groupBy(*KEY, F.session_window("seen", gap).alias("session")).agg(
        F.count(F.lit(1)).alias("reports"), F.min("seen").alias("first_seen_at"), F.max("seen").alias("last_seen_at")
    )
