"""Window and cap against sequential code, in batch and in streams."""

import random

import pytest
from pyspark.sql import functions as F

from newsflow.operators import merging
from newsflow.operators.merging import HOUR, KEY, Span
from newsflow.streaming import merging as stream


def sequential(rows, window, cap):
    """{id: first} in event-time order."""
    state, out = {}, {}
    for rid, key, at in sorted(rows, key=lambda r: (r[2], r[0])):
        first, last = state.get(key, (None, None))
        if first is None or at - last > window or at - first >= cap:
            first = at
        state[key] = (first, at)
        out[rid] = first
    return out


def frame(spark, rows):
    data = [(rid, "HKEX", key, "EARNINGS", at) for rid, key, at in rows]
    return spark.createDataFrame(data, "id int, exchange string, stock_code string, event_type_primary string, at long")


def assigned(spark, rows, span, cell=merging.CELL):
    return {r["id"]: r["first"] for r in merging.assign(frame(spark, rows), span, cell=cell).collect()}


def test_hand_made_case(spark):
    rows = [(i, "k", h * HOUR) for i, h in enumerate([0, 4, 8, 12, 16, 20, 24, 28, 33])]
    first = assigned(spark, rows, Span.hours())
    assert [first[i] // HOUR for i in range(9)] == [0, 0, 0, 0, 0, 0, 24, 24, 33]


@pytest.mark.parametrize("cell", [merging.CELL, 4 * HOUR])
@pytest.mark.parametrize("seed", range(3))
def test_random_both_chains(spark, seed, cell):
    rng = random.Random(seed)
    window, cap = rng.choice([(4, 24), (24, 48), (6, 6), (10, 5)])
    rows, at = [], 0
    for i in range(600):
        at += int(rng.choice([0, 0.1, 1, 3.9, 4, 4.1, 7]) * HOUR)
        rows.append((i, f"k{rng.randint(0, 2)}", at))
    span = Span.hours(window, cap)
    assert assigned(spark, rows, span, cell) == sequential(rows, span.window, span.cap)


def test_hot_key_holds_a_third(spark):
    rng = random.Random(9)
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 50}", rng.randint(0, 40 * 24 * HOUR)) for i in range(9000)]
    span = Span.hours()
    assert assigned(spark, rows, span, cell=HOUR) == sequential(rows, span.window, span.cap)


@pytest.mark.parametrize("seed", range(4))
def test_burst_in_one_slot(spark, seed):
    """Thousands of reports of one key within seconds, down to equal microseconds."""
    rng = random.Random(seed)
    span = Span(*rng.choice([(2_000_000, 5_000_000), (50_000, 50_000), (3_000, 1_000), (7, 20)]))
    base = 1_700_000_000_000_000 - rng.randint(0, 10**7)
    rows = [(i, "hot", base + rng.randint(0, 12 * span.cap)) for i in range(3000)]
    rows += [(5000 + i, f"k{i % 5}", base + i * span.window // 2) for i in range(100)]
    assert assigned(spark, rows, span) == sequential(rows, span.window, span.cap)


def test_tree_windows_hold_cells_only(spark, monkeypatch):
    """No window of the openings is partitioned by a key, session or slot alone."""
    times = frame(spark, [(1, "k", 0), (2, "k", HOUR)]).withColumn("session_start", F.lit(0).cast("bigint"))
    plan = merging._successors(times, Span.hours())._jdf.queryExecution().optimizedPlan().toString()
    assert [line for line in plan.splitlines() if "Window [" in line and "parent" not in line] == []


def test_reports_without_key_are_told(spark):
    rows = frame(spark, [(1, None, 5), (2, "k", 7), (3, "k", None)])
    assert {r["id"]: r["reject_reason"] for r in merging.unplaced(rows).collect()} == {1: "missing stock_code", 3: "missing at"}
    assert [r["id"] for r in merging.assign(rows).collect()] == [2]


def test_no_row_window_over_a_key(spark):
    """Rows meet windows only after they were reduced to slots."""
    slots = merging.sessions(frame(spark, [(1, "k", 0)]), Span.hours())
    plan = slots._jdf.queryExecution().executedPlan().toString()
    assert plan.index("HashAggregate") > plan.index("Window")


def test_rows_meet_their_event_on_key_and_slot(spark):
    """A hot key must not go to one task: the final join is on key and slot."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = merging.assign(frame(spark, [(1, "k", 0), (2, "k", HOUR)]), Span.hours())
        text = plan._jdf.queryExecution().executedPlan().toString()
        line = next(l for l in text.splitlines() if "SortMergeJoin" in l)
        assert "slot" in line
        shuffles = [l for l in text.splitlines() if "Exchange hashpartitioning" in l]
        assert "slot" in shuffles[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def stream_batches(spark, batches, span, lateness=0):
    opened, newest, out, late = spark.createDataFrame([], stream.OPEN_EVENTS), None, {}, []
    for rows in batches:
        m = stream.merge_batch(frame(spark, rows), opened, newest, span, lateness)
        out.update({r["id"]: r["event_id"] for r in m.assigned.collect()})
        late += [r["id"] for r in m.late.collect()]
        opened, newest = m.open_events, m.newest
    return out, late, opened


def test_stream_equals_batch_in_order(spark):
    rng = random.Random(4)
    rows, at = [], 0
    for i in range(300):
        at += int(rng.choice([0.5, 2, 3.9, 4, 4.5]) * HOUR)
        rows.append((i, f"k{rng.randint(0, 2)}", at))
    span = Span.hours(8, 24)
    got, late, _ = stream_batches(spark, [rows[:90], rows[90:91], rows[91:200], rows[200:]], span)
    want = merging.assign(frame(spark, rows), span).withColumn("event_id", merging.event_key(F.col("first")))
    assert late == [] and got == {r["id"]: r["event_id"] for r in want.collect()}


def test_late_rows(spark):
    span = Span.hours()
    first = [(1, "k", 100 * HOUR), (2, "k", 103 * HOUR)]
    second = [(3, "k", 97 * HOUR), (4, "k", 50 * HOUR), (5, "new", 10 * HOUR), (6, "k", 104 * HOUR)]
    got, late, opened = stream_batches(spark, [first, second], span)
    assert sorted(late) == [4, 5]
    assert got[3] == got[1] == got[6]
    row = opened.where("stock_code = 'k'").first()
    assert (row["first"], row["last"], row["event_id"]) == (97 * HOUR, 104 * HOUR, got[1])


def test_closed_events_leave_the_state(spark):
    span = Span.hours()
    _, _, opened = stream_batches(spark, [[(1, "a", 0)], [(2, "b", 100 * HOUR)]], span)
    assert [r["stock_code"] for r in opened.collect()] == ["b"]


def test_stored_times_are_never_broadcast(spark, tmp_path):
    """Few bytes of file may be many rows: neither the lookup of successors nor a join with a table beyond the limit goes through the driver."""
    from newsflow.session import small

    spark.range(1000).selectExpr("'HKEX' exchange", "'00001.HK' stock_code", "'E' event_type_primary", "0L session_start", "id at").write.parquet(f"{tmp_path}/times")
    times = spark.read.parquet(f"{tmp_path}/times")
    for joined in (merging._successors(times, merging.Span(5, 5)), times.join(small(times, 10), "at")):
        assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    assert merging._successors(times, merging.Span(5, 5)).where("then = at + 5").count() == 995
