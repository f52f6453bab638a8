"""Streaming queries, run to the end of their input and compared with the batch rows."""

import uuid

from pyspark.sql import functions as F

from newsflow.operators import ranges
from newsflow.operators.merging import KEY
from newsflow.plans import sql_parts as sp
from newsflow.plans.events import AS_OF, merged_reports, scored_events
from newsflow.plans.registry import r6, register, stamp
from newsflow.session import materialise, shared_dir
from newsflow.sources import driver_tables as dt
from newsflow.sources import tables
from newsflow import schemas
from newsflow.streaming import cleaning as cleaning_stream
from newsflow.streaming import closing, corrections, delivery, ledger, merging, refresh


def _root(spark, name):
    return f"{shared_dir(spark)}/newsflow/{name}-{uuid.uuid4().hex}"


def _stream(spark, sf, name):
    schema = dt.table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf}/{name}*.parquet")


def _in_turns(spark, root, parts, run):
    """Write each part beside those before it and let the stream take it up from its checkpoint: a batch or more per part."""
    for part in parts:
        part.write.mode("append").parquet(f"{root}/input")
        run(spark.readStream.schema(part.schema).parquet(f"{root}/input")).awaitTermination()


def _thirds(spark, sf):
    """The events with ``turn`` 0 to 2, by their time in the thirty days."""
    second = F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.expr(dt.EPOCH))
    return dt.table(spark, sf, "events").withColumn("turn", F.least(F.lit(2), F.greatest(F.lit(0), F.floor(second / 864_000))))


def _cleaned(spark, sf):
    root = _root(spark, "cleaning")
    raw = dt.raw_of(_stream(spark, sf, "documents"))
    cleaning_stream.start_cleaning(raw, root, f"{root}/_checkpoint").awaitTermination()
    return root


@register("st1_stream_cleaning", f"""WITH {sp.RAW}, {sp.ASSESSED} SELECT raw_id, coalesce(reject_reason, 'ACCEPTED') AS outcome FROM assessed""")
def st1(spark, sf):
    root = _cleaned(spark, sf)
    kept = tables.read_batches(spark, f"{root}/cleaned", schemas.CLEANED_NEWS).select("raw_id", F.lit("ACCEPTED").alias("outcome"))
    gone = tables.read_batches(spark, f"{root}/rejected", cleaning_stream.REJECTIONS)
    return kept.unionByName(gone.select("raw_id", F.col("reject_reason").alias("outcome")))


@register("st3_stream_article_fetch", f"""WITH {sp.RAW}, {sp.ASSESSED} SELECT sha256(raw_id) AS cleaned_id, source_name, {sp.stamp('published_at')} AS published_at FROM assessed WHERE reject_reason IS NULL""")
def st3(spark, sf):
    root, out = _cleaned(spark, sf), _root(spark, "fetched")
    cleaned = delivery.read_stream(spark, f"{root}/cleaned", schemas.CLEANED_NEWS)
    joined = cleaning_stream.for_analysis(cleaned, dt.raw_news(spark, sf)).select("cleaned_id", "source_name", stamp("published_at").alias("published_at"))
    delivery.start(joined, lambda batch, n: tables.write_batch(batch, f"{out}/rows", n), f"{out}/_checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/rows").drop("batch_id")


@register("st4_stream_merging", f"{sp.event_chain()} SELECT entity_event_id, event_id FROM merged")
def st4(spark, sf):
    root = _root(spark, "merging")
    # the places need no more of a report
    reports = dt.reports_of(_stream(spark, sf, "events")).select("entity_event_id", *KEY, "published_at", "created_at")
    merging.start_merging(reports, root, f"{root}/_checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/map").select("entity_event_id", "event_id")


@register("st4_stream_sessions", f"""WITH {sp.REPORTS}, gaps AS (
  SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY {sp.KEY} ORDER BY us, eid) <= 14400000000 THEN 0 ELSE 1 END AS begins FROM reports),
  numbered AS (SELECT *, sum(begins) OVER (PARTITION BY {sp.KEY} ORDER BY us, eid ROWS UNBOUNDED PRECEDING) AS sno FROM gaps)
  SELECT {sp.KEY}, min(us) AS first_us, max(us) AS last_us, count(*) AS reports FROM numbered GROUP BY {sp.KEY}, sno""")
def st4_sessions(spark, sf):
    root = _root(spark, "sessions")
    sessions = merging.open_sessions(dt.reports_of(_stream(spark, sf, "events")))
    query = (
        sessions.writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{root}/_checkpoint")
        .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{root}/rows")).start()
    )
    query.awaitTermination()
    rows = spark.read.parquet(f"{root}/rows")
    return rows.select(*KEY, F.unix_micros("first_seen_at").alias("first_us"), F.unix_micros("last_seen_at").alias("last_us"), "reports")


@register("st2_redelivered_reports", f"{sp.event_chain()} SELECT entity_event_id, event_id FROM merged")
def st2(spark, sf):
    """Every turn brings the whole turn before once more."""
    root, turn = _root(spark, "redelivered"), F.col("turn")
    events = _thirds(spark, sf)
    parts = [events.where((turn == k) | (turn == k - 1)).drop("turn") for k in range(3)]
    _in_turns(spark, root, parts, lambda stream: corrections.start(dt.reports_of(stream), root, f"{root}/_checkpoint"))
    return corrections.places(spark, root).select("entity_event_id", "event_id")


@register("st7_all_settled", f"""WITH {sp.RAW}, {sp.ASSESSED} SELECT raw_id, CASE WHEN doc_id % 10 = 0 THEN 'DEAD' ELSE coalesce(reject_reason, 'ACCEPTED') END AS outcome,
  CASE WHEN doc_id % 10 = 0 THEN 3 ELSE 1 END AS deliveries, CASE WHEN doc_id % 10 > 0 AND reject_reason IS NULL THEN 1 ELSE 0 END AS cleaned FROM assessed""")
def st7(spark, sf):
    """Documents in three turns, a third of each delivered again with the next; one in ten has a schema version that is not known."""
    root, n = _root(spark, "ledger"), F.col("raw_id").cast("bigint")
    docs = dt.table(spark, sf, "documents")
    turn = F.pmod(F.xxhash64("doc_id"), F.lit(3))
    again = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0
    parts = [docs.where((turn == k) | ((turn == k - 1) & again)) for k in range(3)]
    version = F.when(n % 10 == 0, 2).otherwise(1)
    _in_turns(spark, root, parts, lambda stream: ledger.start(dt.raw_of(stream).withColumn("v", version), root, f"{root}/_checkpoint"))
    ledger.settle_all(spark, root)
    cleaned = tables.read_batches(spark, f"{root}/cleaned", schemas.CLEANED_NEWS).groupBy("raw_id").agg(F.count(F.lit(1)).alias("cleaned"))
    rows = ledger.outcomes(spark, root).withColumnRenamed("id", "raw_id").join(cleaned, "raw_id", "left")
    return rows.select("raw_id", "outcome", "deliveries", F.coalesce("cleaned", F.lit(0)).alias("cleaned"))


@register("st5_idle_flush", f"""{sp.event_chain()}, clock AS (SELECT max(us) // 1000 - 14400000 AS ms FROM reports),
  ended AS (SELECT event_id, first, max(us) AS last, count(*) AS reports FROM merged GROUP BY event_id, first)
  SELECT event_id, first, last, reports, CASE WHEN (least(last + 14400000000, first + 86400000000) + 999) // 1000 > ms THEN 'open'
    WHEN last + 14400000000 <= first + 86400000000 THEN 'window' ELSE 'cap' END AS reason FROM ended, clock""")
def st5(spark, sf):
    """Events in time order, in three turns; each event once, as it closes, and what is open at the end."""
    root = _root(spark, "closing")
    events = _thirds(spark, sf)

    def run(stream):
        corrections.start(dt.reports_of(stream), root, f"{root}/_merging").awaitTermination()
        return closing.start(spark, root, f"{root}/closed", f"{root}/_closing")

    _in_turns(spark, root, [events.where(F.col("turn") == k).drop("turn") for k in range(3)], run)
    closed = tables.read_batches(spark, f"{root}/closed", closing.CLOSED)
    rows = closed.unionByName(closing.still_open(spark, root, f"{root}/closed").select(*closed.columns))
    return rows.select("event_id", "first", "last", "reports", "reason")


@register("st6_late_rows", f"{sp.event_chain()} SELECT entity_event_id, event_id, first FROM merged")
def st6(spark, sf):
    """Every seventh report comes ten days late and every tenth comes twice; the places are those of the batch."""
    root = _root(spark, "corrections")
    eid, turn = F.col("event_id"), F.col("turn")
    events = _thirds(spark, sf).withColumn("turn", F.when(eid % 7 == 0, turn + 1).otherwise(turn))
    parts = [events.where((turn == k) | ((turn == k - 1) & (eid % 10 == 0))).drop("turn") for k in range(4)]
    _in_turns(spark, root, parts, lambda stream: corrections.start(dt.reports_of(stream), root, f"{root}/_checkpoint"))
    return corrections.places(spark, root).select("entity_event_id", "event_id", "first")


@register("st9_stream_brief", f"{sp.scored_chain()} SELECT event_id, round(final_abs + 1e-9, 6) AS final_abs FROM final WHERE final_abs >= 3.0")
def st9(spark, sf):
    root = _root(spark, "brief")
    scored = scored_events(spark, sf)
    scored.write.parquet(f"{root}/scored")
    stream = delivery.read_stream(spark, f"{root}/scored", scored.schema)
    refresh.start_refresh(stream, f"{root}/brief", f"{root}/_checkpoint", lambda n: F.lit(AS_OF).cast("timestamp")).awaitTermination()
    return tables.published(spark, f"{root}/brief").select("event_id", r6("final_abs_final_score").alias("final_abs"))


@register("st9_second_version", f"{sp.scored_chain()} SELECT event_id, round(final_abs + 1e-9, 6) AS final_abs FROM final WHERE final_abs >= 3.0")
def st9_versions(spark, sf):
    """Three versions of the brief: old scores of all events, new ones of most, then the others and old ones again; the clock moves by days."""
    root, part = _root(spark, "index"), F.crc32("event_id") % 3
    scored = materialise(scored_events(spark, sf), "scored")
    old = scored.withColumn("aggregation_updated_at", F.col("aggregation_updated_at") - F.expr("INTERVAL 1 HOUR")).withColumn("base_rule_score", F.col("base_rule_score") + 5)
    clock = lambda n: F.lit(AS_OF).cast("timestamp") - F.make_dt_interval(days=F.lit(3 * max(0, 2 - n)))
    parts = [old, scored.where(part != 0), scored.where(part == 0).unionByName(old.where(part == 1))]
    _in_turns(spark, root, parts, lambda stream: refresh.start_index(stream, root, f"{root}/_checkpoint", clock))
    return tables.published(spark, f"{root}/brief").select("event_id", r6("final_abs_final_score").alias("final_abs"))


@register("st8_superseded_work", f"{sp.event_chain()} SELECT event_id, max(us) AS version FROM merged GROUP BY event_id HAVING max(us) // 1000000 % 4 > 0")
def st8(spark, sf):
    """Every event is worked on in two versions; for one in four a newer aggregation has come meanwhile."""
    merged = materialise(merged_reports(spark, sf), "merged")
    now = merged.groupBy("event_id").agg(F.max("at").alias("us"))
    stamped = lambda shift: F.timestamp_micros(F.col("us") + shift)
    work = now.select("event_id", F.explode(F.array(stamped(0), stamped(-60_000_000))).alias("aggregation_updated_at"))
    newer = F.when(F.expr("us div 1000000") % 4 == 0, 1_000_000).otherwise(0)
    current = now.select("event_id", stamped(newer).alias("aggregation_updated_at"))
    return refresh.current_work(work, current).select("event_id", F.unix_micros("aggregation_updated_at").alias("version"))


@register("a13_merged_batches", """SELECT event_type AS op, count(*) AS n, min(value) AS min, max(value) AS max, true AS median_within, true AS p95_within
  FROM events WHERE value IS NOT NULL GROUP BY event_type""")
def a13_merged(spark, sf):
    """Latency counts of three batches, merged, and whether median and p95 are within the stated error of the exact ones."""
    root, events = _root(spark, "latency"), _thirds(spark, sf).select(F.col("event_type").alias("op"), F.col("value").alias("v"), "turn")
    parts = [events.where(F.col("turn") == k).drop("turn") for k in range(3)]
    _in_turns(spark, root, parts, lambda stream: delivery.start(stream, delivery.counting_step(f"{root}/counts", "op", "v"), f"{root}/_checkpoint"))
    merged = ranges.summary_of_counts(tables.published(spark, f"{root}/counts"), "op")
    exact = ranges.latency_summary(events, "op", "v").select("op", F.col("median").alias("m"), F.col("p95").alias("p"))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= F.abs(F.col(b)) * (ranges.VALUE_ERROR + 1e-9)
    return merged.join(exact, "op").select("op", "n", "min", "max", near("median", "m").alias("median_within"), near("p95", "p").alias("p95_within"))


@register("st11_no_repeats", "SELECT event_id FROM events")
def st11(spark, sf):
    root = _root(spark, "repeats")
    twice = _stream(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    unique = delivery.without_repeats(twice, ["event_id"], "ts", "1 hour").select("event_id")
    delivery.start(unique, lambda batch, n: tables.write_batch(batch, f"{root}/rows", n), f"{root}/_checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/rows").select("event_id")
