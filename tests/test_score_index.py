"""The kept score index gives the brief that a full computation gives, at any clock."""

import random

from pyspark.sql import functions as F

from newsflow import params
from newsflow.operators import brief, scoring
from newsflow.sources import tables
from newsflow.streaming import refresh

SCHEMA = "event_id string, aggregation_updated_at timestamp, base_rule_score double, stock_impact_score double, direction int, first_seen_at timestamp, last_seen_at timestamp"
START = 1_704_067_200


def _rows(spark, rows):
    frame = spark.createDataFrame([(i, t, b, s, d) for i, t, b, s, d in rows], "event_id string, t bigint, base_rule_score double, stock_impact_score double, direction int")
    at = F.timestamp_seconds(F.col("t") + START)
    return frame.select("event_id", at.alias("aggregation_updated_at"), "base_rule_score", "stock_impact_score", "direction", at.alias("first_seen_at"), at.alias("last_seen_at"))


def _clock(hours):
    return F.timestamp_seconds(F.lit(START + hours * 3600))


def test_versions_equal_full_computation(spark, tmp_path):
    rng, root, seen = random.Random(2), str(tmp_path), {}
    hours = [0, 2, 5, 12, 40]
    step = refresh.index_step(root, _rows(spark, []).schema, lambda n: _clock(hours[n]), buckets=8)
    for n in range(5):
        rows = [
            (f"e{rng.randint(0, 60)}", 3600 * rng.randint(0, 2), rng.uniform(0, 6), rng.choice([None, -5.0, 5.0]) or rng.uniform(-5, 5), rng.choice([-1, 0, 1]))
            for _ in range([120, 0, 20, 1, 5][n])
        ]
        for r in rows:
            if r[0] not in seen or r[1] > seen[r[0]][1]:
                seen[r[0]] = r
        rows = [r for r in rows if seen[r[0]] == r or r[1] < seen[r[0]][1]]  # one row per event and version
        step(_rows(spark, rows), n)
        want = brief.above_noise(scoring.final_scores(_rows(spark, list(seen.values())), _clock(hours[n]))).collect()
        got = tables.published(spark, f"{root}/brief").collect()
        assert {r["event_id"]: r["final_abs_final_score"] for r in got} == {r["event_id"]: r["final_abs_final_score"] for r in want}


def test_times_of_sinking_and_coming_back(spark):
    rows = _rows(spark, [("sinks", 0, 3.0, 0.0, 1), ("stays", 0, 9.0, 0.0, -1), ("never", 0, 0.0, 0.0, 0), ("returns", 0, 1.0, -6.5, 1), ("plain", 0, 0.0, 5.0, 0), ("none", 0, None, 1.0, 1)])
    timed = refresh.visible_times(rows)
    for hour in (0.0, 1.0, 3.0, 6.0, 30.0, 300.0):
        now = F.lit(int((START + hour * 3600) * 1_000_000))
        shown = {r["event_id"] for r in timed.where((F.col("leaves_at") >= now) | (F.col("returns_at") <= now)).collect()}
        full = brief.above_noise(scoring.final_scores(rows, F.timestamp_micros(now)), params.NOISE_FLOOR)
        assert shown == {r["event_id"] for r in full.collect()}, hour


def test_superseded_work_does_not_enter(spark, tmp_path):
    current = _rows(spark, [("a", 100, 9.0, 0.0, 1), ("b", 0, 9.0, 0.0, 1)])
    step = refresh.index_step(str(tmp_path), current.schema, lambda n: _clock(1), event_rows=lambda: current, buckets=2)
    step(_rows(spark, [("a", 0, 9.0, 0.0, 1), ("b", 0, 9.0, 0.0, 1)]), 0)
    assert [r["event_id"] for r in tables.published(spark, f"{tmp_path}/brief").collect()] == ["b"]
