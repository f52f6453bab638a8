"""Each delivered row ends once, and a batch reads its own days of the ledger only."""

import datetime

from pyspark.sql import functions as F

from newsflow import schemas
from newsflow.sources import tables
from newsflow.streaming import ledger

LONG = "body " * 20
COLUMNS = "raw_id string, source_name string, title string, body string, created_at string, is_deleted boolean, v int"


def _raw(spark, rows):
    full = [(i, "s", "title", body, f"2024-01-{day:02} 00:00:00", False, v) for i, body, day, v in rows]
    return spark.createDataFrame(full, COLUMNS).withColumn("created_at", F.to_timestamp("created_at"))


def _outcomes(spark, root):
    return {r["id"]: (r["outcome"], r["deliveries"]) for r in ledger.outcomes(spark, root).collect()}


def test_each_row_ends_once(spark, tmp_path):
    root = str(tmp_path)
    step = ledger.cleaning_step(root)
    step(_raw(spark, [("a", LONG, 1, 1), ("a", LONG, 1, 1), ("b", "short", 1, 1), ("bad", LONG, 1, 7)]), 0)
    assert _outcomes(spark, root) == {"a": ("ACCEPTED", 1), "b": ("BODY_TOO_SHORT", 1), "bad": (None, 1)}
    for _ in range(2):  # replayed
        step(_raw(spark, [("a", LONG, 1, 1), ("b", "short", 1, 1), ("bad", LONG, 1, 7), ("c", LONG, 9, 1), ("worse", LONG, 9, None)]), 1)
    assert _outcomes(spark, root)["bad"] == (None, 2)
    assert ledger.settle_all(spark, root) == 2
    assert _outcomes(spark, root) == {
        "a": ("ACCEPTED", 1), "b": ("BODY_TOO_SHORT", 1), "bad": ("DEAD", 3), "c": ("ACCEPTED", 1), "worse": ("DEAD", 3),
    }
    assert sorted(r["raw_id"] for r in tables.read_batches(spark, f"{root}/cleaned", schemas.CLEANED_NEWS).collect()) == ["a", "c"]
    assert [r["raw_id"] for r in tables.read_batches(spark, f"{root}/rejected", schemas.CLEANED_NEWS).collect()] == ["b"]
    assert {r["delivery_count"] for r in spark.read.parquet(f"{root}/dead").collect()} == {3}


def test_only_the_days_of_the_batch_are_read(spark, tmp_path):
    step = ledger.cleaning_step(str(tmp_path))
    step(_raw(spark, [(str(i), LONG, i, 1) for i in range(1, 20)]), 0)
    lines = ledger.Ledger(f"{tmp_path}/ledger").lines(spark, 1, [datetime.date(2024, 1, 5)])
    assert "day" in lines._jdf.queryExecution().executedPlan().toString().split("PartitionFilters", 1)[1]
    assert len({f.rsplit("/", 2)[1] for f in lines.inputFiles()} & {"day=2024-01-05"}) == 1
    assert [r["id"] for r in lines.collect()] == ["5"]


def test_nothing_delivered(spark, tmp_path):
    assert ledger.settle_all(spark, str(tmp_path)) == 0
    ledger.cleaning_step(str(tmp_path))(_raw(spark, []), 0)
    assert ledger.settle_all(spark, str(tmp_path)) == 0 and _outcomes(spark, str(tmp_path)) == {}


def test_few_files_a_batch(spark, tmp_path):
    """A batch of many days in many tasks: no more files than days and cores together."""
    days = spark.range(0, 4000, 1, 16).select(
        F.col("id").cast("string").alias("id"), F.lit("ACCEPTED").alias("outcome"), F.lit(1).alias("deliveries"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 40).cast("int")).alias("day"))
    kept = ledger.Ledger(f"{tmp_path}/ledger")
    kept.record(days, 0)
    files = [f.parent.name for f in tmp_path.rglob("*.parquet")]
    assert len(set(files)) == 40 and len(files) <= 40 + spark.sparkContext.defaultParallelism
    assert kept.lines(spark).select("id", "outcome", "deliveries", "day").exceptAll(days.withColumn("deliveries", F.lit(1).cast("bigint"))).isEmpty()
    assert kept.lines(spark).count() == 4000
