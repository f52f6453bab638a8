"""Exact merging of streams: any order of arrival, repeats and replays give the batch rows."""

import random

import pytest
from pyspark.sql import functions as F

from newsflow.operators.merging import HOUR, Span
from newsflow.sources import tables
from newsflow.streaming import corrections

BASE = 1_704_067_200_000_000


def sequential(rows, span):
    state, out = {}, {}
    for rid, key, at in sorted(rows, key=lambda r: (r[2], r[0])):
        first, last = state.get(key, (None, None))
        if first is None or at - last > span.window or at - first >= span.cap:
            first = at
        state[key] = (first, at)
        out[rid] = first
    return out


def reports(spark, rows):
    data = [(str(rid), "HKEX", key, "EARNINGS", at) for rid, key, at in rows]
    frame = spark.createDataFrame(data, "entity_event_id string, exchange string, stock_code string, event_type_primary string, us bigint")
    return frame.withColumn("published_at", F.timestamp_micros("us")).withColumn("created_at", F.col("published_at")).drop("us")


def current(spark, root):
    return {int(r["entity_event_id"]): r["first"] for r in corrections.places(spark, root).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_any_order_equals_batch(spark, tmp_path, seed):
    rng = random.Random(seed)
    span = Span.hours(*[(4, 24), (8, 12), (6, 5)][seed])
    rows, at = [], BASE
    for i in range(240):
        at += int(rng.choice([0, 0.1, 1, 3.9, 4, 4.1, 7]) * HOUR)
        rows.append((i, f"k{rng.randint(0, 1)}", at))
    rng.shuffle(rows)
    root, step, seen = str(tmp_path), corrections.correcting_step(str(tmp_path), span), []
    for n in range(4):
        part = rows[60 * n : 60 * n + 60]
        seen += part
        step(reports(spark, part + seen[:7]), n)  # seven are delivered again
        assert current(spark, root) == sequential(seen, span)


def test_withdrawn_and_replayed(spark, tmp_path):
    root, span = str(tmp_path), Span.hours()
    step = corrections.correcting_step(root, span)
    first = [(1, "k", BASE + 10 * HOUR), (2, "k", BASE + 16 * HOUR), (3, "other", BASE)]
    bridge = [(4, "k", BASE + 13 * HOUR)]
    step(reports(spark, first), 0)
    old = {int(r["entity_event_id"]): r["event_id"] for r in corrections.places(spark, root).collect()}
    for _ in range(2):  # a replay replaces its own rows
        step(reports(spark, bridge), 1)
    assert current(spark, root) == sequential(first + bridge, span)
    gone = spark.read.parquet(f"{root}/withdrawn").where("batch_id = 1")
    assert [r["event_id"] for r in gone.collect()] == [old[2]]
    event = spark.read.parquet(f"{root}/events").where("batch_id = 1").collect()
    assert [(r["event_id"], r["reports"]) for r in event] == [(old[1], 3)]
    assert spark.read.parquet(f"{root}/map/batch_id=1").count() == 2  # untouched reports are not written again


def test_horizon_nulls_and_empty_batch(spark, tmp_path):
    root = str(tmp_path)
    step = corrections.correcting_step(root, Span.hours(), horizon_hours=48)
    step(reports(spark, []), 0)
    step(reports(spark, [(1, "k", BASE + 100 * HOUR), (2, None, BASE + 100 * HOUR), (3, "k", None)]), 1)
    step(reports(spark, [(4, "k", BASE + 40 * HOUR), (5, "k", BASE + 60 * HOUR)]), 2)
    assert set(current(spark, root)) == {1, 5}
    assert [r["entity_event_id"] for r in spark.read.parquet(f"{root}/late").collect()] == ["4"]
    assert {(r["entity_event_id"], r["reject_reason"]) for r in spark.read.parquet(f"{root}/rejected").collect()} == {("2", "missing stock_code"), ("3", "missing at")}


def test_only_touched_days_are_read(spark, tmp_path):
    root, span = str(tmp_path), Span.hours()
    step = corrections.correcting_step(root, span)
    step(reports(spark, [(i, "k", BASE + 30 * HOUR * i) for i in range(20)]), 0)
    days = spark.createDataFrame([(BASE // corrections.DAY + 5,)], "day bigint")
    rows = corrections._places_on(spark, root, 1, days)
    assert "PartitionFilters: [isnotnull(batch_id" in rows._jdf.queryExecution().executedPlan().toString()
    assert {r["day"] for r in rows.collect()} <= {BASE // corrections.DAY + 5}
    assert tables.published(spark, f"{root}/sessions").count() == 20
