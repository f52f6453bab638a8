"""Executions and completions meet in streams; what is never completed comes out when its time is up."""

from pyspark.sql import functions as F

from newsflow.sources import tables
from newsflow.streaming import delivery, runs

EXECUTIONS = "execution_id string, job_id bigint, start_time timestamp"
COMPLETIONS = "execution_id string, status string, completed_at timestamp, error_detail string"


def _frame(spark, rows, schema, at):
    return spark.createDataFrame(rows, schema.replace("timestamp", "string")).withColumn(at, F.to_timestamp(at))


def test_outcomes_over_batches(spark, tmp_path):
    day = "2024-01-0{} 0{}:00:00".format
    batches = [
        ([("a", 1, day(1, 1)), ("b", 1, day(1, 1)), ("c", 2, day(1, 2))], [("a", "SUCCESS", day(1, 1), None), ("a", "SUCCESS", day(1, 1), None)]),
        ([("d", 2, day(1, 3))], [("c", "FAILED", "2024-01-01 02:30:00", "source failed"), ("z", "SUCCESS", day(1, 3), None), ("d", "SUCCESS", day(1, 5), None)]),
        ([(None, None, day(5, 1))], [(None, None, day(5, 1), None)]),
    ]
    got = []
    for begun, done in batches:
        _frame(spark, begun, EXECUTIONS, "start_time").write.mode("append").parquet(str(tmp_path / "e"))
        _frame(spark, done, COMPLETIONS, "completed_at").write.mode("append").parquet(str(tmp_path / "c"))
        streams = [delivery.read_stream(spark, str(tmp_path / n), spark.read.parquet(str(tmp_path / n)).schema) for n in "ec"]
        query = runs.outcomes(*streams).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp"))
        query.foreachBatch(lambda batch, n: tables.write_batch(batch, str(tmp_path / "out"), n)).trigger(availableNow=True).start().awaitTermination()
        rows = spark.read.parquet(str(tmp_path / "out")).where("execution_id is not null").collect()
        got.append(sorted((r["execution_id"], r["status"], r["duration_s"]) for r in rows))
    assert got[0] == [("a", "SUCCESS", 0)]
    assert got[1] == [("a", "SUCCESS", 0), ("c", "FAILED", 1800)]
    # d was completed too late: the run is missing and its completion belongs to none
    assert got[2] == [("a", "SUCCESS", 0), ("b", "MISSING", None), ("c", "FAILED", 1800), ("d", "MISSING", None), ("d", "ORPHAN", None), ("z", "ORPHAN", None)]
