"""Run outcomes while they happen: executions and completions as two streams.

A full outer join on the execution within a time range.  A completion meets its execution as soon as both are there; an
execution whose time is up comes out as MISSING, a completion without execution as ORPHAN.  Both sides have a watermark, and
the range ties their times, so state holds only runs that may still be completed.  Repeated completions are dropped before
the join.  The clock is the slower of the two streams; a heartbeat row on each moves it when nothing runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsflow.streaming import delivery

MISSING, ORPHAN = "MISSING", "ORPHAN"


def outcomes(executions: DataFrame, completions: DataFrame, patience: str = "1 hour", lateness: str = "1 day") -> DataFrame:
    """(execution_id, job_id, status, duration_s, error_detail), one row per execution and per completion without one.

    ``executions``: execution_id, job_id, start_time.  ``completions``: execution_id, status, completed_at, error_detail; the
    completion comes between the start and ``patience`` later.
    """
    begun = executions.select("execution_id", "job_id", "start_time").withWatermark("start_time", lateness)
    done = completions.select(F.col("execution_id").alias("_done"), "status", "completed_at", "error_detail")
    done = delivery.without_repeats(done, ["_done"], "completed_at", lateness)
    in_time = (F.col("completed_at") >= F.col("start_time")) & (F.col("completed_at") <= F.col("start_time") + F.expr(f"INTERVAL {patience}"))
    both = begun.join(done, (F.col("execution_id") == F.col("_done")) & in_time, "full_outer")
    status = F.when(F.col("execution_id").isNull(), ORPHAN).otherwise(F.coalesce("status", F.lit(MISSING)))
    return both.select(
        F.coalesce("execution_id", "_done").alias("execution_id"), "job_id", status.alias("status"),
        (F.unix_seconds("completed_at") - F.unix_seconds("start_time")).alias("duration_s"), "error_detail",
    )
