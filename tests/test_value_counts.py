"""Merged counts: the same whatever the batches, and within the stated error of exact order statistics."""

import random

from newsflow.operators import ranges
from newsflow.sources import tables
from newsflow.streaming import delivery


def _frame(spark, rows):
    return spark.createDataFrame(rows, "op string, v double")


def _exact(values):
    v, n = sorted(values), len(values)
    return (v[(n - 1) // 2] + v[n // 2]) / 2, v[min(n - 1, int(0.95 * n))]


def test_batches_equal_whole_and_are_close(spark, tmp_path):
    rng = random.Random(4)
    rows = [("wide", rng.choice([-1, 1]) * 10 ** rng.uniform(-6, 9)) for _ in range(900)]
    rows += [("narrow", 100 + rng.random()) for _ in range(400)] + [("zeros", 0.0)] * 30 + [("zeros", 5.0)] * 2
    rows += [("narrow", None), ("narrow", float("nan")), ("one", -3.5)]
    rng.shuffle(rows)
    step = delivery.counting_step(str(tmp_path), "op", "v")
    for n in range(4):
        step(_frame(spark, rows[n::4]), n)
    step(_frame(spark, rows[3::4]), 3)  # a replay counts once
    merged = ranges.summary_of_counts(tables.published(spark, str(tmp_path)), "op").collect()
    whole = ranges.summary_of_counts(ranges.value_counts(_frame(spark, rows), "op", "v"), "op").collect()
    assert sorted(merged) == sorted(whole)
    for r in merged:
        values = [v for op, v in rows if op == r["op"] and v is not None and v == v]
        assert (r["n"], r["min"], r["max"]) == (len(values), min(values), max(values))
        median, p95 = _exact(values)
        assert abs(r["p95"] - p95) <= ranges.VALUE_ERROR * abs(p95) + 1e-12
        if r["op"] != "wide":  # there the two middle elements may have unlike signs
            assert abs(r["median"] - median) <= ranges.VALUE_ERROR * abs(median) + 1e-12


def test_empty(spark):
    assert ranges.summary_of_counts(ranges.value_counts(_frame(spark, []), "op", "v"), "op").count() == 0
