"""Reports meet a table of few slots where they are; repeated reports are told before anything is stored."""

import random

from newsflow.operators import merging
from newsflow.operators.merging import HOUR, Span
from newsflow.streaming import delivery


def _reports(spark):
    rng = random.Random(5)
    rows = [(i, "HKEX", f"k{i % 3}", "EARNINGS", rng.randint(0, 20 * 24 * HOUR)) for i in range(3000)]
    return spark.createDataFrame(rows, "id int, exchange string, stock_code string, event_type_primary string, at long")


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_reports_stay_where_they_are_if_slots_are_few(spark, monkeypatch):
    rows = _reports(spark)
    few = merging.assign(rows, Span.hours(), near=True)
    assert "BroadcastHashJoin" in _plan(few)
    monkeypatch.setattr(merging, "is_small", lambda df: False)
    many = merging.assign(rows, Span.hours(), near=True)
    assert "Broadcast" not in _plan(many)
    assert sorted(map(tuple, few.select("id", "first").collect())) == sorted(map(tuple, many.select("id", "first").collect()))


def test_once_sorts_behind_the_exchange_only(spark):
    rows = _reports(spark).selectExpr("cast(id % 700 as string) as id", "stock_code")
    kept = delivery.once(rows, "id")
    assert sorted(r["id"] for r in kept.collect()) == sorted(str(k) for k in range(700))
    assert _plan(kept).split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1
