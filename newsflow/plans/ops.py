"""Queries behind the operational reports."""

import uuid

from pyspark.sql import functions as F

from newsflow.operators import ranges, reports
from newsflow.plans import sql_parts as sp
from newsflow.plans.registry import r6, register, stamp
from newsflow.session import shared_dir
from newsflow.sources import driver_tables as dt
from newsflow.sources import tables
from newsflow.streaming import delivery, runs

# --- coverage ------------------------------------------------------------------------------

_POLL = f"""{sp.RAW}, poll AS (SELECT * FROM raw WHERE doc_id % 4 = 3),
  stored AS (SELECT source_name, created_at - CASE WHEN ascii(right(source_name, 1)) % 2 = 0 THEN INTERVAL 30 DAY ELSE INTERVAL 0 DAY END AS created_at
             FROM raw WHERE doc_id % 4 < 3 AND source_name <> 'src19')"""


def _poll(spark, sf):
    raw = dt.raw_news(spark, sf).withColumn("n", F.col("raw_id").cast("long") % 4)
    back = F.when(F.ascii(F.right("source_name", F.lit(1))) % 2 == 0, F.expr("INTERVAL 30 DAYS")).otherwise(F.expr("INTERVAL 0 DAYS"))
    stored = raw.where((F.col("n") < 3) & (F.col("source_name") != "src19")).withColumn("created_at", F.col("created_at") - back)
    return raw.where("n = 3"), stored


@register("a1_latest_crawl", f"WITH {_POLL} SELECT source_name, {sp.stamp('max(created_at)')} AS previous_crawl FROM stored GROUP BY source_name")
def a1(spark, sf):
    rows = reports.latest_crawl(_poll(spark, sf)[1])
    return rows.select("source_name", stamp("previous_crawl").alias("previous_crawl"))


@register("a2_oldest_entry", f"WITH {_POLL} SELECT source_name, {sp.stamp('min(published_at)')} AS oldest FROM poll GROUP BY source_name")
def a2(spark, sf):
    return reports.oldest_entry(_poll(spark, sf)[0]).select("source_name", stamp("oldest").alias("oldest"))


@register("a3_coverage_gap", f"""WITH {_POLL}, o AS (SELECT source_name, min(published_at) AS oldest FROM poll GROUP BY 1), p AS (SELECT source_name, max(created_at) AS prev FROM stored GROUP BY 1)
  SELECT source_name, coalesce(oldest > prev, false) AS gap FROM o LEFT JOIN p USING (source_name)""")
def a3(spark, sf):
    return reports.coverage_gaps(*_poll(spark, sf)).select("source_name", "gap")


# --- latency -------------------------------------------------------------------------------

_SUMMARY = """ordered AS (SELECT op, v, row_number() OVER (PARTITION BY op ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY op) AS n FROM samples)
  SELECT op, n, min(v) AS min, (max(v) FILTER (i = (n - 1) // 2) + max(v) FILTER (i = n // 2)) / 2 AS median,
    max(v) FILTER (i = least(n - 1, CAST(floor(0.95e0 * n) AS BIGINT))) AS p95, max(v) AS max FROM ordered GROUP BY op, n"""


def _samples(spark, sf):
    return dt.table(spark, sf, "events").select(F.col("event_type").alias("op"), F.col("value").alias("v"))


@register("a13_latency_summary", f"WITH samples AS (SELECT event_type AS op, value AS v FROM events), {_SUMMARY}")
def a13(spark, sf):
    return ranges.latency_summary(_samples(spark, sf), "op", "v")


@register("a14_pooled_latency", f"""WITH samples AS (SELECT event_type AS op, value AS v FROM events UNION ALL
  SELECT 'ALL' AS op, value AS v FROM events WHERE event_type IN ('click', 'view', 'error')), {_SUMMARY}""")
def a14(spark, sf):
    return ranges.latency_summary(ranges.pooled(_samples(spark, sf), "op", ["click", "view", "error"], "ALL"), "op", "v")


# --- skill logs ----------------------------------------------------------------------------

_LOGS = f"""calls AS (SELECT conv_id, turn // 4 AS block, turn, length(text) AS size FROM conversations),
  logs AS (SELECT conv_id, block, sum(size) AS tin, sum(size // 4) AS tout, sum(size * 3 % 5000) AS lat, sum(turn % 2) AS retries, count(*) AS calls,
    {sp.EPOCH} + to_hours(conv_id % 72) AS at_time, 'v1.' || conv_id % 3 AS skill_version,
    CASE conv_id % 2 WHEN 0 THEN 'entity_analysis_completed' ELSE 'brief_summary_completed' END AS event FROM calls GROUP BY conv_id, block)"""


def _logs(spark, sf):
    return tables.parse_skill_logs(dt.skill_log_lines(spark, sf))


@register("s16_skill_log_scan", f"WITH {_LOGS} SELECT event, CAST(conv_id AS VARCHAR) AS event_id, skill_version, {sp.stamp('at_time')} AS logged, calls FROM logs")
def s16(spark, sf):
    return _logs(spark, sf).select("event", "event_id", "skill_version", stamp("timestamp").alias("logged"), F.size("llm_calls").cast("long").alias("calls"))


@register("a11_call_totals", f"WITH {_LOGS} SELECT CAST(conv_id AS VARCHAR) AS event_id, CAST(tin AS BIGINT) AS tin, CAST(tout AS BIGINT) AS tout, CAST(lat AS BIGINT) AS lat, CAST(retries AS BIGINT) AS retries FROM logs")
def a11(spark, sf):
    return reports.call_totals(_logs(spark, sf)).select(
        "event_id", F.col("total_input_tokens").alias("tin"), F.col("total_output_tokens").alias("tout"),
        F.col("total_latency_ms").alias("lat"), F.col("total_retries").alias("retries"),
    )


@register("a12_skill_quality", f"""WITH {_LOGS} SELECT event, skill_version, strftime(at_time, '%Y-%m-%d') AS day, count(*) AS runs,
  round(avg(CASE WHEN conv_id % 5 = 0 THEN 1e0 ELSE 0e0 END) + 1e-9, 6) AS fallback_rate, round(avg(tin + tout) + 1e-9, 6) AS avg_tokens, round(avg(lat) + 1e-9, 6) AS avg_latency_ms,
  CAST(max(lat) AS BIGINT) AS max_latency_ms, CAST(sum(CASE WHEN conv_id % 7 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS errors FROM logs GROUP BY ALL""")
def a12(spark, sf):
    rows = reports.skill_quality(reports.call_totals(_logs(spark, sf)))
    return rows.select(
        "event", "skill_version", F.date_format("day", "yyyy-MM-dd").alias("day"), "runs", r6("fallback_rate").alias("fallback_rate"),
        r6("avg_tokens").alias("avg_tokens"), r6("avg_latency_ms").alias("avg_latency_ms"), "max_latency_ms", "errors",
    )


@register("a12_rounds", f"WITH {_LOGS} SELECT skill_version, calls AS rounds, count(*) AS runs, count(*) FILTER (calls >= 3) AS max_rounds_reached FROM logs GROUP BY ALL")
def a12_rounds(spark, sf):
    return reports.rounds_distribution(_logs(spark, sf)).withColumn("rounds", F.col("rounds").cast("long"))


@register("j14_logs_with_business_rows", f"WITH {_LOGS} SELECT conv_id AS event_id, event_type, CAST(tin AS BIGINT) AS tin FROM logs JOIN events ON event_id = conv_id")
def j14(spark, sf):
    events = dt.table(spark, sf, "events").select(F.col("event_id").cast("string").alias("event_id"), "event_type")
    rows = reports.with_business_rows(reports.call_totals(_logs(spark, sf)), events, "event_id")
    return rows.select(F.col("event_id").cast("long").alias("event_id"), "event_type", F.col("total_input_tokens").alias("tin"))


# --- runs ----------------------------------------------------------------------------------

_CALENDAR = """days AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events),
  jobs AS (SELECT CAST(s_suppkey AS VARCHAR) AS job_id, s_suppkey * 37 % 1440 AS start_minute, CASE s_suppkey % 3 WHEN 0 THEN 60 ELSE 1440 END AS step FROM supplier WHERE s_suppkey % 5 <> 0),
  calendar AS (SELECT job_id, CAST(day AS TIMESTAMP) + to_minutes(m) AS at_time, m FROM (SELECT job_id, day, unnest(generate_series(start_minute, 1439, step)) AS m FROM jobs, days))"""


def _calendar(spark, sf):
    return reports.run_calendar(dt.jobs(spark, sf), dt.days(spark, sf))


def _ran(calendar):
    minute = F.floor(F.unix_seconds("scheduled_time") / 60)
    return calendar.where((F.col("job_id").cast("long") * 31 + minute) % 7 != 0).withColumnRenamed("scheduled_time", "start_time")


@register("r1_run_calendar", f"WITH {_CALENDAR} SELECT job_id, {sp.stamp('at_time')} AS scheduled_time FROM calendar")
def r1(spark, sf):
    return _calendar(spark, sf).select("job_id", stamp("scheduled_time").alias("scheduled_time"))


@register("r3_missed_runs", f"""WITH {_CALENDAR} SELECT job_id, {sp.stamp('at_time')} AS scheduled_time FROM calendar
  WHERE at_time <= TIMESTAMP '2024-01-20 12:00:00' AND (CAST(job_id AS BIGINT) * 31 + epoch_us(at_time) // 60000000) % 7 = 0""")
def r3(spark, sf):
    calendar = _calendar(spark, sf)
    missed = reports.missed_runs(calendar, _ran(calendar), F.lit("2024-01-20 12:00:00").cast("timestamp"))
    return missed.select("job_id", stamp("scheduled_time").alias("scheduled_time"))


_RUNS = """items AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'N') AS successes, count(*) FILTER (l_returnflag = 'R') AS failures FROM lineitem GROUP BY 1)"""


def _executions(spark, sf):
    orders = dt.table(spark, sf, "orders")
    key = F.col("o_orderkey")
    start = F.col("o_orderdate").cast("timestamp")
    executions = orders.select(key.cast("string").alias("execution_id"), (F.col("o_custkey") % 100).alias("job_id"), start.alias("start_time"))
    completions = orders.where("o_orderstatus <> 'P'").select(
        F.when(key % 50 == 0, F.concat(F.lit("x"), key.cast("string"))).otherwise(key.cast("string")).alias("execution_id"),
        F.when(F.col("o_orderstatus") == "F", "FAILED").otherwise("SUCCESS").alias("status"),
        (start + F.make_dt_interval(secs=key % 600)).alias("completed_at"),
        F.when(F.col("o_orderstatus") == "F", "source failed").alias("error_detail"),
    )
    return executions, completions


@register("r2_run_outcomes", f"""WITH {_RUNS}, done AS (SELECT * FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 50 <> 0)
  SELECT CAST(o.o_orderkey AS VARCHAR) AS execution_id, o.o_custkey % 100 AS job_id, CASE d.o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'SUCCESS' ELSE 'MISSING' END AS status,
    coalesce(successes, 0) AS successes, coalesce(failures, 0) AS failures, CASE WHEN d.o_orderkey IS NOT NULL THEN o.o_orderkey % 600 END AS duration_s,
    CASE d.o_orderstatus WHEN 'F' THEN 'source failed' END AS error_detail
  FROM orders o LEFT JOIN done d USING (o_orderkey) LEFT JOIN items i ON i.l_orderkey = o.o_orderkey""")
def r2(spark, sf):
    executions, completions = _executions(spark, sf)
    outcome = F.when(F.col("l_returnflag") == "N", "success").when(F.col("l_returnflag") == "R", "failure").otherwise("skipped_empty")
    items = dt.table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("execution_id"), outcome.alias("outcome"))
    return reports.run_outcomes(executions, completions, reports.outcome_counts(items, "execution_id"))


@register("j13_unmatched_completions", "SELECT 'x' || o_orderkey AS execution_id FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 50 = 0")
def j13(spark, sf):
    executions, completions = _executions(spark, sf)
    return reports.unmatched_completions(completions, executions).select("execution_id")


@register("st10_stream_completions", """WITH done AS (SELECT * FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 50 <> 0)
  SELECT CAST(o.o_orderkey AS VARCHAR) AS execution_id, o.o_custkey % 100 AS job_id, CASE d.o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'SUCCESS' ELSE 'MISSING' END AS status,
    CASE WHEN d.o_orderkey IS NOT NULL THEN o.o_orderkey % 600 END AS duration_s FROM orders o LEFT JOIN done d USING (o_orderkey)
  UNION ALL SELECT 'x' || o_orderkey, NULL, 'ORPHAN', NULL FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 50 = 0""")
def st10(spark, sf):
    """Executions and completions in three turns by time, every tenth completion twice; a heartbeat at the end."""
    executions, completions = _executions(spark, sf)
    root = f"{shared_dir(spark)}/newsflow/runs-{uuid.uuid4().hex}"
    repeated = completions.where(F.crc32("execution_id") % 10 == 0)
    ends = executions.agg(F.min("start_time").alias("a"), F.max("start_time").alias("b")).first()
    step = (ends["b"] - ends["a"]) / 3
    cuts = [F.lit(ends["a"] + k * step) for k in (1, 2)]
    third = lambda at: F.when(at < cuts[0], 0).when(at < cuts[1], 1).otherwise(2)
    beat = spark.range(1).select(F.lit(None).cast("string").alias("execution_id"), (F.lit(ends["b"]) + F.expr("INTERVAL 7 DAYS")).alias("t"))
    for turn in range(4):
        if turn < 3:
            begun, done = executions.where(third(F.col("start_time")) == turn), completions.unionByName(repeated).where(third(F.col("completed_at")) == turn)
        else:
            begun = beat.select("execution_id", F.lit(None).cast("bigint").alias("job_id"), F.col("t").alias("start_time"))
            done = beat.select("execution_id", F.lit(None).cast("string").alias("status"), F.col("t").alias("completed_at"), F.lit(None).cast("string").alias("error_detail"))
        begun.select(*executions.columns).write.mode("append").parquet(f"{root}/executions")
        done.select(*completions.columns).write.mode("append").parquet(f"{root}/completions")
        streams = [delivery.read_stream(spark, f"{root}/{n}", rows.schema) for n, rows in (("executions", executions), ("completions", completions))]
        query = runs.outcomes(*streams).writeStream.outputMode("append").option("checkpointLocation", f"{root}/_checkpoint")
        query.foreachBatch(lambda batch, n: tables.write_batch(batch, f"{root}/rows", n)).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{root}/rows").where("execution_id is not null")
    return rows.select("execution_id", "job_id", "status", "duration_s")
