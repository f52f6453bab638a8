"""Reports to events: sliding window per key with a hard cap on the span.

A report joins the open event of its key (exchange, stock, event type) when it comes at most
``window_hours`` after the last report and less than ``max_span_hours`` after the first one;
otherwise it opens a new event.

How it scales.  Time is cut into slots no wider than the window, so reports of one key and
slot always belong to one session; a hot key spreads over its slots and only (min, max) per
slot is needed to find the sessions.  The cap then needs a chain of opening times per session:
the next opening is the first report at least ``max_span_hours`` after the current one.  The
chain is followed over cells of a minute, with the least and greatest time of each, as a lower
and an upper bound of every opening.  Where the bounds agree, as they do unless an opening falls
inside a cell of several times, the chain is known.  Otherwise the reports in cells that can hold an
opening are left, and a tree of time cells (hour, minute, second, millisecond, microsecond)
with the least time of each gives their successors; pointer doubling does the rest.  No window
or array ever holds the reports of a key, a session or a slot: arrays have a line per minute, and windows at
most a thousand cells or a line per hour.  Slots
are no wider than the cap either, so each slot holds at most one opening, and the table that
tells rows their event has one line per key and slot.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsflow import params
from newsflow.functions.text import derived_id
from newsflow.session import is_small, materialise, shuffled, small

KEY = ["exchange", "stock_code", "event_type_primary"]
HOUR = 3_600_000_000
SESSION = [*KEY, "session_start"]
# Width of the cells over which openings are bounded, in microseconds.
CELL = 60_000_000
# Widths of the cells of the tree, each a multiple of the one before.
TREE = (1, 1_000, 1_000_000, 60_000_000, HOUR)


@dataclass(frozen=True)
class Span:
    """Window and cap in microseconds."""

    window: int
    cap: int

    @classmethod
    def hours(cls, window: float = params.WINDOW_HOURS, cap: float = params.MAX_SPAN_HOURS) -> "Span":
        return cls(int(window * HOUR), int(cap * HOUR))

    @property
    def slot(self) -> int:
        return min(self.window, self.cap)

    def slot_of(self, micros: Column) -> Column:
        return F.floor(micros / F.lit(self.slot))


def micros(at: Column) -> Column:
    return F.unix_micros(at)


def sessions(reports: DataFrame, span: Span, seeds: DataFrame | None = None) -> DataFrame:
    """Slots (key, slot, lo, hi, n, session_start): the gap rule alone, no cap.

    ``reports`` has the key and ``at`` in microseconds.  ``seeds`` are open events (key, first,
    last); each enters as one interval, so that the chain continues from it.
    """
    slots = reports.groupBy(*KEY, span.slot_of(F.col("at")).alias("slot")).agg(
        F.min("at").alias("lo"), F.max("at").alias("hi"), F.count(F.lit(1)).alias("n")
    )
    if seeds is not None:
        opened = seeds.select(
            *KEY, span.slot_of(F.col("first")).alias("slot"), F.col("first").alias("lo"), F.col("last").alias("hi"),
            F.lit(1).cast("long").alias("n"),
        )
        slots = slots.unionByName(opened).groupBy(*KEY, "slot").agg(
            F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")
        )
    earlier = W.partitionBy(*KEY).orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy(*KEY).orderBy("slot").rowsBetween(W.unboundedPreceding, 0)
    reach = F.max("hi").over(earlier)
    begins = reach.isNull() | (F.col("lo") - reach > span.window)
    return (
        slots.withColumn("_begins", begins)
        .withColumn("session_start", F.max(F.when(F.col("_begins"), F.col("lo"))).over(upto))
        .drop("_begins")
    )


def _cell(at: Column, width: int) -> Column:
    """Number of the cell of a time, exact for any 64-bit time."""
    return F.call_function("div", at - F.pmod(at, F.lit(width)), F.lit(width))


def _bounds(lines: DataFrame, span: Span) -> DataFrame:
    """(session, lows, highs): bounds of the k-th opening, from lines (session, lo, hi) no wider than the cap.

    An opening at or after ``a`` is followed by one no earlier than the first line that reaches ``a + cap``, one at or
    before ``b`` by one no later than a time of the first line that reaches ``b + cap``.
    """
    none, no_time = F.array().cast("array<bigint>"), F.lit(None).cast("bigint")
    start = F.struct(none.alias("lows"), no_time.alias("low"), none.alias("highs"), no_time.alias("high"))

    def step(state: Column, line: Column) -> Column:
        first = state["low"].isNull()
        after_low, after_high = state["low"] + span.cap, state["high"] + span.cap
        low = F.when(first, line["lo"]).when(line["hi"] >= after_low, F.greatest(line["lo"], after_low))
        high = F.when(first | (line["lo"] >= after_high), line["lo"]).when(line["hi"] >= after_high, line["hi"])
        more = lambda found, value: F.when(value.isNull(), found).otherwise(F.concat(found, F.array(value)))
        return F.struct(
            more(state["lows"], low).alias("lows"), F.coalesce(low, state["low"]).alias("low"),
            more(state["highs"], high).alias("highs"), F.coalesce(high, state["high"]).alias("high"),
        )

    ordered = F.array_sort(F.collect_list(F.struct("lo", "hi")))
    folded = lines.groupBy(*SESSION).agg(F.aggregate(ordered, start, step).alias("b"), F.max("hi").alias("end"))
    return folded.select(*SESSION, "b.lows", "b.highs", "end")


def _successors(times: DataFrame, span: Span) -> DataFrame:
    """(session, at, then): ``then`` is the first of the session's times at or after ``at + cap``.

    The answer lies in the millisecond of ``at + cap``, or else is the least time of the next millisecond that has any in
    its second, of the next second in its minute, and so on: one lookup per width, of which the earliest counts.
    """
    after = F.col("at") + (span.cap - 1)  # the first time beyond this one
    level = lambda at: F.explode(F.array(*[
        F.struct(F.lit(k).alias("level"), _cell(at, width).cast("bigint").alias("cell")) for k, width in enumerate(TREE)
    ])).alias("c")
    asks = times.select(*SESSION, "at", level(after)).select(*SESSION, "at", "c.level", "c.cell")
    filled = times.select(*SESSION, F.col("at").alias("lo"), level(F.col("at"))).select(*SESSION, "c.level", "c.cell", "lo")
    asked = asks.select(*SESSION, "level", "cell", F.lit(None).cast("bigint").alias("lo"))
    cells = filled.unionByName(asked).groupBy(*SESSION, "level", "cell").agg(F.min("lo").alias("lo"))
    ratio = F.element_at(F.array(*[F.lit(b // a).cast("bigint") for a, b in zip(TREE, (*TREE[1:], TREE[-1]))]), F.col("level") + 1)
    top = F.col("level") == len(TREE) - 1
    cells = cells.withColumn("parent", F.when(top, 0).otherwise(F.call_function("div", F.col("cell") - F.pmod(F.col("cell"), ratio), ratio)))
    beyond = W.partitionBy(*SESSION, "level", "parent").orderBy(F.desc("cell")).rowsBetween(W.unboundedPreceding, -1)
    following = cells.select(*SESSION, "level", "cell", F.min("lo").over(beyond).alias("then"))
    return asks.join(shuffled(following), [*SESSION, "level", "cell"]).groupBy(*SESSION, "at").agg(F.min("then").alias("then"))


def _doubling_chain(times: DataFrame, span: Span) -> DataFrame:
    """Openings among distinct times, their sessions' starts included, in about log2(openings) rounds.

    Level k maps a time to the opening 2^k steps later.  It is kept only for session starts
    and for times that level k−1 can reach, a set that shrinks from level to level.
    """
    level = materialise(_successors(times, span), "successor")
    levels = []
    while True:
        from_start = level.where((F.col("at") == F.col("session_start")) & F.col("then").isNotNull())
        if from_start.isEmpty():
            break
        levels.append(level)
        reached = level.where(F.col("then").isNotNull())
        domain = (
            reached.select(*SESSION, F.col("then").alias("at"))
            .unionByName(level.select(*SESSION, F.col("session_start").alias("at")))
            .distinct()
        )
        half = level.join(shuffled(domain), [*SESSION, "at"], "left_semi")
        onward = level.select(*SESSION, F.col("at").alias("then"), F.col("then").alias("_onward"))
        level = materialise(
            half.join(shuffled(onward), [*SESSION, "then"], "left").select(*SESSION, "at", F.col("_onward").alias("then")),
            "successor",
        )
    chain = times.select(*SESSION, F.col("session_start").alias("opening")).distinct()
    for level in reversed(levels):
        further = chain.join(shuffled(level.withColumnRenamed("at", "opening")), [*SESSION, "opening"]).select(
            *SESSION, F.col("then").alias("opening")
        )
        chain = materialise(chain.unionByName(further.where(F.col("opening").isNotNull())), "chain")
    return chain


def openings(reports: DataFrame, slots: DataFrame, span: Span, cell: int = CELL) -> DataFrame:
    """(key, session_start, opening): the first time of every event."""
    cell = min(cell, span.slot)  # so that a cell holds at most one opening, and the times of one session
    whole = slots.groupBy(*SESSION).agg(F.max("hi").alias("_end"))
    plain = whole.where(F.col("_end") - F.col("session_start") < span.cap)
    capped = whole.where(F.col("_end") - F.col("session_start") >= span.cap)
    times = reports.select(*KEY, "at").unionByName(slots.select(*KEY, F.col("lo").alias("at")))
    lines = times.groupBy(*KEY, span.slot_of(F.col("at")).alias("slot"), _cell(F.col("at"), cell).alias("cell")).agg(
        F.min("at").alias("lo"), F.max("at").alias("hi")
    )
    capped_slots = slots.join(shuffled(capped), SESSION, "left_semi").select(*KEY, "slot", "session_start")
    bounds = materialise(_bounds(lines.join(_sided(capped_slots, slots), [*KEY, "slot"]).select(*SESSION, "lo", "hi"), span), "bounds")
    known = F.col("lows") == F.col("highs")
    result = plain.select(*SESSION, F.col("session_start").alias("opening")).unionByName(
        bounds.where(known).select(*SESSION, F.explode("lows").alias("opening"))
    )
    if bounds.where(~known).isEmpty():
        return result
    # the upper chain is never the longer one; beyond its end an opening may lie anywhere
    spans = bounds.where(~known).select(*SESSION, "end", F.explode(F.arrays_zip("lows", "highs")).alias("k"))
    reached = F.sequence(_cell(F.col("k.lows"), cell), _cell(F.coalesce("k.highs", "end"), cell))
    within = materialise(spans.select(*SESSION, F.explode(reached).alias("cell")).distinct(), "cells")
    inside = times.withColumn("cell", _cell(F.col("at"), cell)).join(small(within), [*KEY, "cell"])
    return result.unionByName(_doubling_chain(materialise(inside.select(*SESSION, "at").distinct(), "times"), span))


def _sided(lines: DataFrame, slots: DataFrame) -> DataFrame:
    """Side of a join with at most a line per slot, which meets the reports where they are if the stored ``slots`` are few."""
    return F.broadcast(lines) if is_small(slots) else shuffled(lines)


def slot_events(slots: DataFrame, opened: DataFrame, span: Span) -> DataFrame:
    """(key, slot, carried, opening): the event open when the slot begins, and the one opened in it."""
    marks = opened.select(*KEY, span.slot_of(F.col("opening")).alias("slot"), "opening")
    earlier = W.partitionBy(*KEY).orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    return (
        slots.select(*KEY, "slot")
        .join(shuffled(marks), [*KEY, "slot"], "left")
        .withColumn("carried", F.max("opening").over(earlier))
    )


def event_key(first: Column) -> Column:
    """Identifier fixed when the event opens."""
    return derived_id(*[F.col(k) for k in KEY], first.cast("string"))


def assign(reports: DataFrame, span: Span | None = None, seeds: DataFrame | None = None, cell: int = CELL,
           near: bool = False) -> DataFrame:
    """Adds ``first`` (opening time of the event, microseconds) to every report.

    ``reports`` has the key columns and ``at`` in microseconds.  ``cell`` decides how much is left to the tree, never the
    rows.  Reports with a null key column or time have no event; ``unplaced`` tells them.  With ``near`` reports are not
    shuffled to meet a table of few slots.
    """
    span = span or Span.hours()
    narrow = reports.select(*KEY, "at")
    slots = materialise(sessions(narrow, span, seeds), "slots")
    table = slot_events(slots, openings(narrow, slots, span, cell), span)
    first = F.when(F.col("opening").isNotNull() & (F.col("at") >= F.col("opening")), F.col("opening")).otherwise(
        F.col("carried")
    )
    return (
        reports.withColumn("slot", span.slot_of(F.col("at")))
        .join(_sided(table, slots) if near else shuffled(table), [*KEY, "slot"])
        .withColumn("first", first)
        .drop("slot", "carried", "opening")
    )


def unplaced(reports: DataFrame) -> DataFrame:
    """Reports that ``assign`` cannot place, with the missing columns as ``reject_reason``."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in [*KEY, "at"]]))
    return reports.withColumn("reject_reason", F.concat(F.lit("missing "), F.array_join(missing, ", "))).where(F.size(missing) > 0)


def merge(entity_events: DataFrame, span: Span | None = None) -> DataFrame:
    """Entity events with ``at``, ``first`` and ``event_id``; time is published, else created."""
    at = micros(F.coalesce("published_at", "created_at"))
    return assign(entity_events.withColumn("at", at), span).withColumn("event_id", event_key(F.col("first")))


def entity_map(merged: DataFrame, created_at: Column) -> DataFrame:
    return merged.select("event_id", "entity_event_id", created_at.alias("created_at"))
