"""Operational reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_crawl(raw: DataFrame) -> DataFrame:
    return raw.groupBy("source_name").agg(F.max("created_at").alias("previous_crawl"))


def oldest_entry(entries: DataFrame) -> DataFrame:
    """Oldest known publish time of each source's poll; nulls do not count."""
    return entries.groupBy("source_name").agg(F.min("published_at").alias("oldest"))


def coverage_gaps(entries: DataFrame, raw: DataFrame) -> DataFrame:
    """(source_name, oldest, previous_crawl, gap): true if the poll starts after the last crawl."""
    gap = F.coalesce(F.col("oldest") > F.col("previous_crawl"), F.lit(False))
    return oldest_entry(entries).join(latest_crawl(raw), "source_name", "left").withColumn("gap", gap)


def reason_counts(rows: DataFrame, reason: str, *by: str) -> DataFrame:
    return rows.groupBy(*by, reason).agg(F.count(F.lit(1)).alias("n"))


def outcome_counts(items: DataFrame, *by: str) -> DataFrame:
    """Items per outcome; ``items`` has the column outcome."""
    of = lambda name: F.count_if(F.col("outcome") == name)
    return items.groupBy(*by).agg(
        of("success").alias("successes"), of("failure").alias("failures"),
        of("skipped_empty").alias("skipped"), of("rate_limited").alias("rate_limited"),
    )


def call_totals(logs: DataFrame) -> DataFrame:
    """Adds token, latency and retry totals over the calls of each log row."""
    total = lambda f: F.aggregate("llm_calls", F.lit(0).cast("long"), lambda s, c: s + F.coalesce(c[f], F.lit(0)))
    return (
        logs.withColumn("total_input_tokens", total("input_tokens"))
        .withColumn("total_output_tokens", total("output_tokens"))
        .withColumn("total_latency_ms", total("latency_ms"))
        .withColumn("total_retries", total("instructor_retries"))
        .withColumn("call_count", F.size("llm_calls"))
    )


def skill_quality(totalled: DataFrame) -> DataFrame:
    """Per skill event, version and day: rows, fallback rate, tokens, latency."""
    return totalled.groupBy("event", "skill_version", F.to_date("timestamp").alias("day")).agg(
        F.count(F.lit(1)).alias("runs"),
        F.avg(F.when(F.col("fallback"), 1.0).otherwise(0.0)).alias("fallback_rate"),
        F.avg(F.col("total_input_tokens") + F.col("total_output_tokens")).alias("avg_tokens"),
        F.avg("total_latency_ms").alias("avg_latency_ms"),
        F.max("total_latency_ms").alias("max_latency_ms"),
        F.percentile_approx("total_latency_ms", 0.95).alias("p95_latency_ms"),
        F.sum(F.size("llm_errors")).alias("errors"),
    )


def rounds_distribution(logs: DataFrame) -> DataFrame:
    return logs.groupBy("skill_version", F.col("fc_summary.rounds").alias("rounds")).agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(F.col("fc_summary.max_rounds_reached")).alias("max_rounds_reached"),
    )


def with_business_rows(logs: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Log rows with the business row of their key (entity_event_id or event_id)."""
    return logs.join(table, key)


def run_calendar(jobs: DataFrame, days: DataFrame) -> DataFrame:
    """(job_id, scheduled_time): start, then every interval until 23:59 of the day.

    ``jobs``: job_id, start_minute (of the day), interval_minutes (null: once), is_active.
    ``days``: day.  Every active job runs on every day, so the pairing is the result itself;
    days are few and are folded into one array that each job row unpacks.
    """
    all_days = days.agg(F.sort_array(F.collect_set("day"))).scalar()
    last = F.lit(23 * 60 + 59)
    minutes = F.when(F.col("start_minute") > last, F.array().cast("array<int>")).otherwise(
        F.sequence(F.col("start_minute").cast("int"), last, F.coalesce(F.col("interval_minutes"), F.lit(1440)).cast("int"))
    )
    return (
        jobs.where(F.col("is_active"))
        .select("job_id", F.explode(all_days).alias("day"), minutes.alias("_m"))
        .select("job_id", "day", F.explode("_m").alias("_minute"))
        .select(
            "job_id",
            F.timestamp_seconds(F.unix_date("day").cast("long") * 86400 + F.col("_minute") * 60).alias("scheduled_time"),
        )
    )


def run_outcomes(executions: DataFrame, completions: DataFrame, counts: DataFrame) -> DataFrame:
    """Executions with their completion: SUCCESS, FAILED or MISSING, item counts, duration.

    An execution completed with zero items is a success.
    """
    done = completions.select("execution_id", "status", "completed_at", "error_detail")
    return (
        executions.select("execution_id", "job_id", "start_time")
        .join(done, "execution_id", "left")
        .join(counts, "execution_id", "left")
        .select(
            "execution_id", "job_id",
            F.coalesce("status", F.lit("MISSING")).alias("status"),
            F.coalesce("successes", F.lit(0)).cast("long").alias("successes"),
            F.coalesce("failures", F.lit(0)).cast("long").alias("failures"),
            (F.unix_seconds("completed_at") - F.unix_seconds("start_time")).alias("duration_s"),
            "error_detail",
        )
    )


def unmatched_completions(completions: DataFrame, executions: DataFrame) -> DataFrame:
    return completions.join(executions.select("execution_id"), "execution_id", "left_anti")


def missed_runs(calendar: DataFrame, executions: DataFrame, now: Column) -> DataFrame:
    """Scheduled and due, but never executed."""
    due = calendar.where(F.col("scheduled_time") <= now)
    ran = executions.select("job_id", F.col("start_time").alias("scheduled_time")).distinct()
    return due.join(ran, ["job_id", "scheduled_time"], "left_anti")
