"""Timed closing of events: an event is handed on once no further report can join it.

An event closes when its window has passed without a report or its cap is reached, whichever is first, by the clock of
the stream: the newest report time less the lateness.  Each open event has one state entry and one timer at that
time, renewed when the event grows; the entry goes when the timer fires or the event is withdrawn, so state
holds open events only.  The stream of events has one row per event and batch (``corrections``), so a
key with many reports is many small groups, never one.

No timer fires without a clock: at the end of input, ``still_open`` gives what is left, as a service does before it stops.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from newsflow.operators.merging import KEY, Span
from newsflow.sources import tables
from newsflow.streaming import corrections

STATE = "key string, first bigint, last bigint, reports bigint, batch_id bigint, closes bigint"
CLOSED = T.StructType([*(T.StructField(c, T.StringType()) for c in ("event_id", *KEY)), *(T.StructField(c, T.LongType()) for c in ("first", "last", "reports")), T.StructField("reason", T.StringType())])
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: How long operator state is kept is decided by the timers; the store must be able to hold them.
PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"
_PART = "\u0001"


class Closing(StatefulProcessor):
    """State and timer of one event."""

    def __init__(self, window: int, cap: int):
        self.window, self.cap = window, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.event = handle.getValueState("event", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = max((r for part in rows for r in part.to_dict("records")), key=lambda r: r["batch_id"])
        if self.event.exists():
            before = self.event.get()
            if before[4] > newest["batch_id"]:
                return iter(())
            self.handle.deleteTimer(before[5])
            self.event.clear()
        if newest["reports"] > 0:
            closes = -(-min(newest["last"] + self.window, newest["first"] + self.cap) // 1000)
            parts = _PART.join(newest[k] for k in KEY)
            self.event.update((parts, newest["first"], newest["last"], newest["reports"], newest["batch_id"], closes))
            self.handle.registerTimer(closes)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.event.exists():
            return
        parts, first, last, reports, _, _ = self.event.get()
        self.event.clear()
        reason = "window" if last + self.window <= first + self.cap else "cap"
        yield pd.DataFrame([(key[0], *parts.split(_PART), first, last, reports, reason)], columns=CLOSED.fieldNames())

    def close(self) -> None:
        pass


def changes(spark: SparkSession, root: str, stream: bool = False) -> DataFrame:
    """Events as each batch left them, withdrawn ones with no reports."""
    reader = spark.readStream if stream else spark.read
    grown = reader.schema(corrections.EVENTS).parquet(f"{root}/events")
    gone = reader.schema(corrections.WITHDRAWN).parquet(f"{root}/withdrawn")
    nothing = F.lit(0).cast("bigint")
    return grown.unionByName(gone.select("event_id", *KEY, nothing.alias("first"), nothing.alias("last"), nothing.alias("reports"), "seen", "batch_id"))


def closed_events(changed: DataFrame, span: Span, lateness: str = "4 hours") -> DataFrame:
    """Stream of closed events, by the clock of ``seen``."""
    timed = changed.withColumn("clock", F.timestamp_micros("seen")).withWatermark("clock", lateness)
    return timed.groupBy("event_id").transformWithStateInPandas(Closing(span.window, span.cap), CLOSED, "Append", "EventTime")


def start(spark: SparkSession, root: str, out: str, checkpoint: str, span: Span | None = None, lateness: str = "4 hours", every: str | None = None) -> StreamingQuery:
    """Write the events that close to ``out``, a folder per batch; without ``every`` stop when the input is used up."""
    spark.conf.set(PROVIDER_KEY, PROVIDER)
    rows = closed_events(changes(spark, root, stream=True), span or Span.hours(), lateness)
    writer = rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(lambda batch, n: tables.write_batch(batch, out, n))
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def still_open(spark: SparkSession, root: str, out: str) -> DataFrame:
    """Events that have neither closed nor been withdrawn."""
    latest = F.max_by(F.struct(*KEY, "first", "last", "reports"), "batch_id")
    now = changes(spark, root).groupBy("event_id").agg(latest.alias("e")).select("event_id", "e.*").where("reports > 0")
    closed = tables.read_batches(spark, out, CLOSED)
    return now.join(closed.select("event_id"), "event_id", "left_anti").withColumn("reason", F.lit("open"))
