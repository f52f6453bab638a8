"""Continuous event merging that equals the batch result whatever the order of arrival.

A report that comes late can join an event, bridge two sessions, or lower the first time of an event and so
shift all that follow it in its session.  Each micro-batch finds the sessions its reports touch, reads the
stored reports from the event that is open at the first touched time, merges those again, and stores
what changed: new places for reports, and the ids of events that no longer exist.  A report in time order touches the
open event of its key only.

How it scales.  Sessions are found from one line per key and slot, as in the batch operator.  Stored reports are
partitioned by day, so a batch reads only days that a touched session covers; they meet the sessions
by key and slot, so a hot key spreads.  A repeated report is told by its id on its day, so the check does not grow with
the age of the stream.  Sessions that ended more than ``horizon`` before the newest report leave the state, and
reports as old as that go to ``late``.

Tables under the root, one folder per batch: ``map`` (places, the latest batch counts), ``events`` (re-merged events as
they are now), ``withdrawn`` (ids that are gone), ``late``, ``rejected`` (without key or time); ``sessions`` and ``clock`` are
versions.  A batch that is replayed replaces its own folders and reads those of earlier batches only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from newsflow.operators import merging
from newsflow.operators.merging import HOUR, KEY, SESSION, Span
from newsflow.session import materialise, small
from newsflow.sources import tables
from newsflow.streaming import delivery

DAY = 24 * HOUR
HORIZON_HOURS = 30 * 24.0
_KEYS = [T.StructField(k, T.StringType()) for k in KEY]
_longs = lambda *names: [T.StructField(n, T.LongType()) for n in names]
PLACES = T.StructType(
    [T.StructField("entity_event_id", T.StringType()), *_KEYS, *_longs("at", "first"), T.StructField("event_id", T.StringType()), *_longs("batch_id", "day")]
)
SESSIONS = T.StructType([*_KEYS, *_longs("session_start", "end")])
#: ``seen`` is the newest report time of the stream when the row was written.
EVENTS = T.StructType([T.StructField("event_id", T.StringType()), *_KEYS, *_longs("first", "last", "reports", "seen", "batch_id")])
WITHDRAWN = T.StructType([T.StructField("event_id", T.StringType()), *_KEYS, *_longs("seen", "batch_id")])


def _number(at: Column, width: int) -> Column:
    return F.call_function("div", at - F.pmod(at, F.lit(width)), F.lit(width))


def _covered(low: Column, high: Column, width: int) -> Column:
    """The cells of a width between two times, a row each."""
    return F.explode(F.sequence(_number(low, width), _number(high, width)))


def _places_on(spark: SparkSession, root: str, batch_id: int, days: DataFrame) -> DataFrame:
    """Current places of the reports on the days; only their folders are read."""
    wanted = [r["day"] for r in days.distinct().collect()]  # at most the days of the horizon
    if not wanted or not tables.exists(spark, f"{root}/map"):
        return spark.createDataFrame([], PLACES)
    rows = spark.read.schema(PLACES).parquet(f"{root}/map").where((F.col("batch_id") < batch_id) & F.col("day").isin(wanted))
    latest = F.max_by(F.struct(*KEY, "at", "first", "event_id", "day"), "batch_id")
    return rows.groupBy("entity_event_id").agg(latest.alias("p"), F.max("batch_id").alias("batch_id")).select("entity_event_id", "p.*", "batch_id")


def places(spark: SparkSession, root: str) -> DataFrame:
    """(entity_event_id, key, at, first, event_id) as of the last batch."""
    rows = spark.read.schema(PLACES).parquet(f"{root}/map")
    latest = F.max_by(F.struct(*KEY, "at", "first", "event_id"), "batch_id")
    return rows.groupBy("entity_event_id").agg(latest.alias("p")).select("entity_event_id", "p.*")


def _sessions(fresh: DataFrame, before: DataFrame, span: Span) -> tuple[DataFrame, DataFrame]:
    """(touched, all): sessions after the batch, the touched ones with ``since``, their first new time."""
    lines = fresh.groupBy(*KEY, span.slot_of(F.col("at")).alias("slot")).agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    keys = materialise(lines.select(*KEY).distinct(), "touched-keys")
    known = before.join(keys, KEY, "left_semi").select(*KEY, F.col("session_start").alias("lo"), F.col("end").alias("hi"), F.lit(None).cast("bigint").alias("new"))
    both = lines.select(*KEY, "lo", "hi", F.col("lo").alias("new")).unionByName(known)
    ordered = W.partitionBy(*KEY).orderBy("lo", "hi")
    reach = F.max("hi").over(ordered.rowsBetween(W.unboundedPreceding, -1))
    begins = reach.isNull() | (F.col("lo") - reach > span.window)
    both = both.withColumn("_start", F.when(begins, F.col("lo"))).withColumn(
        "session_start", F.max("_start").over(ordered.rowsBetween(W.unboundedPreceding, 0))
    )
    now = materialise(both.groupBy(*SESSION).agg(F.max("hi").alias("end"), F.min("new").alias("since")), "sessions")
    kept = before.join(keys, KEY, "left_anti")
    return now.where(F.col("since").isNotNull()), kept.unionByName(now.select(*SESSION, "end"))


def merge_again(fresh: DataFrame, touched: DataFrame, stored: DataFrame, span: Span) -> DataFrame:
    """Reports of the touched sessions from the event open at their first new time on, with old and new places.

    Columns: entity_event_id, key, at, ``old`` (event id before, null for new reports), first, event_id.
    """
    slots = touched.select(*SESSION, "since", _covered(F.greatest("session_start", F.col("since") - span.cap), F.col("end"), span.slot).alias("slot"))
    inside = stored.withColumn("slot", _number(F.col("at"), span.slot)).join(small(materialise(slots, "touched-slots")), [*KEY, "slot"])
    inside = materialise(inside.select("entity_event_id", *SESSION, "since", "at", F.col("first").alias("was"), F.col("event_id").alias("old")), "inside")
    last = inside.where(F.col("at") < F.col("since")).groupBy(*SESSION, "since").agg(F.max_by("was", "at").alias("was"))
    # where the cap ends the open event before the first new time, merging begins with that time
    restart = last.where(F.col("since") - F.col("was") < span.cap).select(*SESSION, F.col("was").alias("restart"))
    rows = inside.join(restart, SESSION, "left").where(F.col("at") >= F.coalesce("restart", "since"))
    again = rows.select("entity_event_id", *KEY, "at", "old").unionByName(fresh.select("entity_event_id", *KEY, "at", F.lit(None).cast("string").alias("old")))
    again = materialise(again, "again")
    return materialise(merging.assign(again, span, near=True).withColumn("event_id", merging.event_key(F.col("first"))), "merged-again")


def correcting_step(root: str, span: Span | None = None, horizon_hours: float = HORIZON_HOURS):
    """Step of exact merging; see the module for the tables it writes."""
    span = span or Span.hours()
    horizon = int(horizon_hours * HOUR)

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        at = merging.micros(F.coalesce("published_at", "created_at"))
        arrived = materialise(delivery.once(batch.select("entity_event_id", *KEY, at.alias("at")), "entity_event_id"), "arrived")
        before, newest = _state_before(spark, root, batch_id)
        tables.write_batch(merging.unplaced(arrived), f"{root}/rejected", batch_id)
        placed = arrived.dropna(subset=[*KEY, "at"])
        oldest = None if newest is None else newest - horizon
        late = F.col("at") < F.lit(oldest).cast("bigint")
        tables.write_batch(placed.where(late), f"{root}/late", batch_id)
        on_time = placed.where(~F.coalesce(late, F.lit(False)))
        known = _places_on(spark, root, batch_id, on_time.select(_number(F.col("at"), DAY).alias("day")))
        fresh = materialise(on_time.join(known.select("entity_event_id"), "entity_event_id", "left_anti"), "fresh")

        touched, sessions = _sessions(fresh, before, span)
        days = touched.select(_covered(F.greatest("session_start", F.col("since") - span.cap), F.col("end"), DAY).alias("day"))
        again = merge_again(fresh, touched, _places_on(spark, root, batch_id, days), span)
        changed = again.where(~F.col("old").eqNullSafe(F.col("event_id")))
        changed = changed.select("entity_event_id", *KEY, "at", "first", "event_id", _number(F.col("at"), DAY).alias("day"))
        changed.write.mode("overwrite").partitionBy("day").parquet(f"{root}/map/batch_id={batch_id}")
        seen = fresh.agg(F.max("at")).first()[0]
        newest = max((t for t in (newest, seen) if t is not None), default=None)
        clock = F.lit(newest).cast("bigint").alias("seen")
        events = again.groupBy("event_id", *KEY, "first").agg(F.max("at").alias("last"), F.count(F.lit(1)).alias("reports"))
        tables.write_batch(events.select("*", clock), f"{root}/events", batch_id)
        gone = again.select(F.col("old").alias("event_id"), *KEY).dropna().distinct().join(again.select("event_id"), "event_id", "left_anti")
        tables.write_batch(gone.select("*", clock), f"{root}/withdrawn", batch_id)
        tables.publish(sessions.where(F.col("end") >= F.lit((newest or 0) - horizon)), f"{root}/sessions", batch_id)
        tables.publish(spark.createDataFrame([(newest,)], "newest bigint"), f"{root}/clock", batch_id)

    return step


def _state_before(spark: SparkSession, root: str, batch_id: int) -> tuple[DataFrame, int | None]:
    if not tables.exists(spark, f"{root}/sessions/version={batch_id - 1}"):
        return spark.createDataFrame([], SESSIONS), None
    sessions = spark.read.schema(SESSIONS).parquet(f"{root}/sessions/version={batch_id - 1}")
    return sessions, tables.published(spark, f"{root}/clock", batch_id - 1).first()["newest"]


def start(reports: DataFrame, root: str, checkpoint: str, span: Span | None = None, every: str | None = None) -> StreamingQuery:
    return delivery.start(reports, correcting_step(root, span), checkpoint, every)
