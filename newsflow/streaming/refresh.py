"""Continuous refresh of the published brief."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from newsflow import params
from newsflow.operators import brief, dedup, scoring
from newsflow.sources import tables
from newsflow.sources.buckets import Buckets
from newsflow.streaming import delivery

TIMED = ["recency_score", "final_base_rule_score", "final_abs_final_score"]


def current_work(batch: DataFrame, event_rows: DataFrame) -> DataFrame:
    """Latest version of each event in the batch, if no newer aggregation superseded it."""
    latest = dedup.latest_version(batch, ["event_id"], "aggregation_updated_at")
    return scoring.current_only(latest, event_rows)


def refresh_step(root: str, as_of: Callable[[int], Column], floor: float = params.NOISE_FLOOR):
    """Step publishing version ``batch_id`` of the brief from the one before.

    ``as_of`` gives the clock of a batch.  Time scores are recomputed for every row, as the
    order of signed sums can change with time.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        clock = as_of(batch_id)
        updated = scoring.final_scores(dedup.latest_version(batch, ["event_id"], "aggregation_updated_at"), clock)
        if tables.exists(spark, f"{root}/version={batch_id - 1}"):
            before = tables.published(spark, root, batch_id - 1)
            cached = scoring.final_scores(before.drop(*TIMED), clock).select(*updated.columns)
            merged = brief.merge_cache(cached, updated, floor)
        else:
            merged = brief.above_noise(updated, floor)
        tables.publish(brief.ordered(merged), root, batch_id)

    return step


def start_refresh(scored: DataFrame, root: str, checkpoint: str, as_of: Callable[[int], Column],
                  every: str | None = None) -> StreamingQuery:
    return delivery.start(scored, refresh_step(root, as_of), checkpoint, every)


# --- kept score index ----------------------------------------------------------------------

_ALWAYS, _NEVER = (1 << 63) - 1, -(1 << 62)
_SECOND = 1_000_000


def visible_times(scored: DataFrame, floor: float = params.NOISE_FLOOR) -> DataFrame:
    """Adds ``leaves_at`` and ``returns_at`` in microseconds: the event is above the floor until the one and from the other on.

    The final score is the amount of a + b·x, where x falls from the last aggregation on by the decay of recency.  It
    sinks below the floor at most once, and comes back at most once, with the other sign, when impact outweighs the rule score.
    """
    sign, b = F.signum("direction"), F.abs("direction") * (10.0 * params.RECENCY_WEIGHT * params.RULE_WEIGHT)
    a = F.col("base_rule_score") * F.col("direction") * params.RULE_WEIGHT + F.col("stock_impact_score") * params.IMPACT_WEIGHT
    a = F.when(sign < 0, -a).otherwise(a)
    at = lambda x: F.unix_micros("aggregation_updated_at") + (-F.log(x) / params.RECENCY_DECAY * 3_600_000_000).cast("bigint")
    low, high = (F.lit(floor) - a) / b, (F.lit(-floor) - a) / b
    return scored.withColumn(
        "leaves_at", F.when(a.isNull(), _NEVER).when(sign == 0, F.when(F.abs(a) >= floor, _ALWAYS).otherwise(_NEVER)).when(low <= 0, _ALWAYS).otherwise(at(low))
    ).withColumn("returns_at", F.when(a.isNull() | (sign == 0), _ALWAYS).when(high <= 0, _ALWAYS).otherwise(at(high)))


def score_index(root: str, scored: T.StructType, buckets: int = 64) -> Buckets:
    """The index of events with columns ``scored``, kept in buckets of the event."""
    times = [T.StructField(c, T.LongType()) for c in ("leaves_at", "returns_at")]
    return Buckets(f"{root}/index", T.StructType([*scored.fields, *times]), ("event_id",), buckets)


def index_step(root: str, scored: T.StructType, as_of: Callable[[int], Column], floor: float = params.NOISE_FLOOR,
               event_rows: Callable[[], DataFrame] | None = None, buckets: int = 64):
    """Step that takes the batch into the index and publishes version ``batch_id`` of the brief under ``brief``.

    Only buckets of the batch's events are rewritten, an older version of an event never replaces a newer one, and
    with ``event_rows`` work that a newer aggregation superseded is left out.  The version is made from the events
    that are above the floor at the clock, by their times, a filter that the scan takes; so an
    event that sinks below the floor leaves without being touched, and one that comes back is there again.
    """
    index = score_index(root, scored, buckets)

    def step(batch: DataFrame, batch_id: int) -> None:
        clock, spark = as_of(batch_id), batch.sparkSession
        work = dedup.latest_version(batch, ["event_id"], "aggregation_updated_at")
        work = work if event_rows is None else scoring.current_only(work, event_rows())
        index.upsert(visible_times(work, floor), "aggregation_updated_at")
        now = F.unix_micros(clock)
        due = index.read(spark).where((F.col("leaves_at") >= now - _SECOND) | (F.col("returns_at") <= now + _SECOND))
        current = scoring.final_scores(due.drop("leaves_at", "returns_at"), clock)
        tables.publish(brief.ordered(brief.above_noise(current, floor)), f"{root}/brief", batch_id)

    return step


def start_index(scored: DataFrame, root: str, checkpoint: str, as_of: Callable[[int], Column], every: str | None = None) -> StreamingQuery:
    return delivery.start(scored, index_step(root, scored.schema, as_of), checkpoint, every)
