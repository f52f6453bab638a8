"""Streams over several micro-batches give the batch result."""

from pyspark.sql import functions as F

from newsflow import schemas
from newsflow.operators import cleaning
from newsflow.sources import driver_tables as dt
from newsflow.sources import tables
from newsflow.streaming import cleaning as cs
from newsflow.streaming import delivery, merging, refresh


def _split(frame, path, parts, column):
    """The rows in ``parts`` files whose modification order is their time order."""
    for i in range(parts):
        frame.where(F.pmod(F.floor(F.col(column) / 60), F.lit(parts)) == i).coalesce(1).write.mode("append").parquet(path)


def test_cleaning_in_batches_and_redelivery(spark, sf, tmp_path):
    raw = dt.raw_news(spark, sf).withColumn("n", F.col("raw_id").cast("long"))
    path, root = str(tmp_path / "raw"), str(tmp_path / "out")
    _split(raw, path, 3, "n")
    _split(raw.where("n < 40"), path, 1, "n")  # delivered again
    stream = delivery.read_stream(spark, path, raw.schema, files_per_batch=1)
    cs.start_cleaning(stream, root, str(tmp_path / "cp")).awaitTermination()
    got = sorted(r["raw_id"] for r in tables.read_batches(spark, f"{root}/cleaned", schemas.CLEANED_NEWS).collect())
    want = sorted(r["raw_id"] for r in cleaning.accepted(cleaning.assess(raw), F.col("created_at")).collect())
    assert got == want


def test_replay_of_a_batch_changes_nothing(spark, sf, tmp_path):
    root = str(tmp_path / "out")
    step = cs.cleaning_step(root)
    batch = dt.raw_news(spark, sf)
    for _ in range(2):
        step(batch, 0)
    first = tables.read_batches(spark, f"{root}/cleaned", schemas.CLEANED_NEWS)
    assert first.count() == first.select("cleaned_id").distinct().count() > 0


def test_versions_retried_then_dead(spark, sf, tmp_path):
    root = str(tmp_path / "out")
    step = cs.checked_step(root)
    raw = dt.raw_news(spark, sf).withColumn("v", F.when(F.col("raw_id") == "7", 2).otherwise(1))
    step(raw, 0)
    empty = raw.limit(0)
    for n in (1, 2):
        step(empty, n)
    dead = spark.read.parquet(f"{root}/dead")
    assert dead.count() == 1 and dead.first()["delivery_count"] == 3 and "schema version 2" in dead.first()["error_detail"]
    cleaned = tables.read_batches(spark, f"{root}/cleaned", schemas.CLEANED_NEWS)
    assert cleaned.where("raw_id = '7'").count() == 0 and cleaned.count() > 100


def test_merging_over_files(spark, sf, tmp_path):
    events = dt.table(spark, sf, "events")
    path, root = str(tmp_path / "events"), str(tmp_path / "out")
    for low in range(0, 1000, 400):
        events.where(F.col("event_id").between(low, low + 399)).coalesce(1).write.mode("append").parquet(path)
    stream = dt.reports_of(delivery.read_stream(spark, path, events.schema, files_per_batch=1))
    merging.start_merging(stream, root, str(tmp_path / "cp")).awaitTermination()
    from newsflow.operators import merging as batch_merging
    got = {r["entity_event_id"]: r["event_id"] for r in spark.read.parquet(f"{root}/map").collect()}
    want = {r["entity_event_id"]: r["event_id"] for r in batch_merging.merge(dt.events_as_reports(spark, sf)).collect()}
    late = spark.read.parquet(f"{root}/late").count()
    same = sum(got.get(k) == v for k, v in want.items())
    # Files meet at most a minute out of order, where created_at stands in for published_at.
    assert len(got) + late == 1000 and same >= 995


def test_refresh_over_versions(spark, tmp_path):
    schema = "event_id string, aggregation_updated_at timestamp, base_rule_score double, stock_impact_score double, direction int, first_seen_at timestamp, last_seen_at timestamp"
    def rows(*data):
        return spark.createDataFrame(data, schema.replace("timestamp", "string")).select(
            *[F.col(c).cast(t).alias(c) for c, t in (f.split() for f in schema.split(", "))])
    root = str(tmp_path / "brief")
    step = refresh.refresh_step(root, lambda n: F.lit("2024-01-01 04:00:00").cast("timestamp"))
    t = "2024-01-01 00:00:00"
    step(rows(("a", t, 9.0, 0.0, 1, t, t), ("b", t, 9.0, 1.0, 1, t, t), ("c", t, 0.1, 0.0, 1, t, t)), 0)
    step(rows(("a", t, 0.2, 0.0, 1, t, t), ("c", t, 8.0, 0.0, 1, t, t), ("c", "2023-12-31 00:00:00", 0.0, 0.0, 1, t, t)), 1)
    assert tables.current_version(spark, root) == 1
    got = {r["event_id"]: r["final_abs_final_score"] for r in tables.published(spark, root).collect()}
    assert sorted(got) == ["b", "c"]
    assert abs(got["c"] - (8.0 + 6.703200460356394 * 0.2) * 0.67) < 1e-9


def test_superseded_work_is_dropped(spark):
    work = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "event_id string, aggregation_updated_at int")
    now = spark.createDataFrame([("a", 2), ("b", 5)], "event_id string, aggregation_updated_at int")
    assert [tuple(r) for r in refresh.current_work(work, now).collect()] == [("a", 2)]
