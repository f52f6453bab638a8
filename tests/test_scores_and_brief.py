import random

import pytest
from pyspark.sql import functions as F

from newsflow.operators import brief, ranges, reports, rollup, scoring
from newsflow.sources import tables


def by_source(spark, rows):
    return spark.createDataFrame(rows, "event_id string, source_name string, weight double, scored long, signed_sum double, strength_sum double")


def test_sentiment_golden(spark):
    row = rollup.sentiment(by_source(spark, [("e", "A", 9.0, 1, 0.8, 0.8), ("e", "B", 6.0, 1, -0.5, 0.5)])).first()
    assert row["weighted_sentiment"] == pytest.approx(0.28) and row["sentiment_strength"] == pytest.approx(0.68)
    assert (row["sentiment_label"], row["authority"]) == ("POSITIVE", 9.0)


def entries(spark, rows):
    return spark.createDataFrame(rows, "event_id string, entity_event_id string, source_name string, weight double, at long, entity_summary string, headline string")


def test_budget_skips_and_goes_on(spark):
    rows = [("e", str(i), "S", 9.0, 10 - i, "x" * n, "h") for i, n in enumerate([4, 8, 2])]
    r = brief.within_budget(entries(spark, rows), budget=7).first()
    assert [s.split("] ")[1] for s in r["summaries"]] == ["xxxx", "xx"] and r["truncated_by_char_cap"]


@pytest.mark.parametrize("seed", range(3))
def test_budget_property(spark, seed):
    rng = random.Random(seed)
    rows = [(f"e{rng.randint(0, 9)}", f"{i:03d}", rng.choice("AB"), rng.choice([4.0, 9.0]), rng.randint(0, 50), "y" * rng.randint(0, 90), "h") for i in range(150)]
    want = {}
    for r in sorted(rows, key=lambda r: (-r[3], -r[4], r[1])):
        used, kept = want.get(r[0], (0, []))
        if used + len(r[5]) <= 200:
            used, kept = used + len(r[5]), kept + [f"[{r[2]}] {r[5]}"]
        want[r[0]] = (used, kept)
    got = {r["event_id"]: (r["total_chars"], r["summaries"]) for r in brief.within_budget(entries(spark, rows)).collect()}
    assert got == want


def test_latest_per_source_limits_before_the_shuffle(spark):
    rows = [("e", f"{i:03d}", "A" if i % 3 else "B", 9.0, i, "s", f"h{i}") for i in range(50)]
    top = brief.latest_per_source(entries(spark, rows))
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    got = sorted((r["source_name"], r["at"]) for r in top.collect())
    assert got == [("A", 46), ("A", 47), ("A", 49), ("B", 42), ("B", 45), ("B", 48)]


def final(spark, rows):
    schema = "event_id string, stock_code string, final_abs_final_score double, final_base_rule_score double, first_seen_at timestamp, last_seen_at timestamp"
    return spark.createDataFrame([(*r, r[2], None, None) for r in rows], schema)


def test_watchlist_backfill(spark):
    rows = final(spark, [("a", "00700.HK", 3.1), ("b", "00700.HK", 3.2), ("c", "00001.HK", 9.0), ("d", "00002.HK", 8.0)])
    top = brief.watchlist(rows, ["700"], 3)
    assert "TakeOrderedAndProject" in top._jdf.queryExecution().executedPlan().toString()
    assert [(r["event_id"], r["position"]) for r in top.orderBy("rank").collect()] == [("b", 2), ("a", 3), ("c", 1)]


@pytest.mark.parametrize("codes,k", [([], 5), (["700"], 0), (["700"], 51)])
def test_watchlist_bounds(spark, codes, k):
    with pytest.raises(ValueError):
        brief.watchlist(final(spark, [("a", "00700.HK", 3.1)]), codes, k)


def test_merge_actions_and_cache(spark):
    cached = final(spark, [("a", "x", 5.0), ("b", "x", 5.0), ("z", "x", 4.0)])
    updated = final(spark, [("a", "x", 6.0), ("b", "x", 1.0), ("c", "x", 3.0), ("d", "x", 2.9)])
    got = {r["event_id"]: r["action"] for r in brief.merge_actions(cached, updated).collect()}
    assert got == {"a": "replace", "b": "remove", "c": "insert", "d": "ignore"}
    merged = {r["event_id"]: r["final_abs_final_score"] for r in brief.merge_cache(cached, updated).collect()}
    assert merged == {"a": 6.0, "c": 3.0, "z": 4.0}


def test_impact_without_reason_falls_back(spark):
    events = spark.createDataFrame([("a",), ("b",), ("c",)], "event_id string")
    impact = spark.createDataFrame([("a", 9.0, "r" * 90), ("b", 2.0, "  ")], "event_id string, stock_impact_score double, adjustment_reason string")
    got = {r["event_id"]: (r["stock_impact_score"], r["llm_fallback"]) for r in scoring.with_impact(events, impact).collect()}
    assert got == {"a": (5.0, False), "b": (0.0, True), "c": (0.0, True)}
    checked = scoring.checked_impact(impact).first()
    assert len(checked["adjustment_reason"]) == 80 and checked["violation"]


def test_ranks_over_many_partitions(spark):
    rows = spark.range(20_000, numPartitions=7).withColumn("v", F.pmod(F.hash("id"), F.lit(50)))
    ranked = ranges.ranked(rows, [F.col("v").desc(), F.col("id").asc()]).collect()
    want = sorted(((r["v"], r["id"]) for r in ranked), key=lambda t: (-t[0], t[1]))
    assert [(r["v"], r["id"]) for r in sorted(ranked, key=lambda r: r["rank"])] == want
    assert sorted(r["rank"] for r in ranked) == list(range(1, 20_001))


def test_latency_summary_hot_group(spark):
    rng = random.Random(1)
    data = [("hot" if i % 3 else rng.choice("abc"), float(rng.randint(1, 900))) for i in range(3000)] + [("solo", 7.0), ("none", None)]
    got = {r["op"]: tuple(r)[1:] for r in ranges.latency_summary(spark.createDataFrame(data, "op string, v double"), "op", "v").collect()}
    import statistics
    for op in {o for o, v in data if v is not None}:
        s = sorted(v for o, v in data if o == op)
        assert got[op] == (len(s), s[0], statistics.median(s), s[min(len(s) - 1, int(0.95 * len(s)))], s[-1])
    assert "none" not in got


def test_coverage_gap(spark):
    poll = spark.createDataFrame([("a", "2024-01-01 12:00:00"), ("b", "2024-01-01 00:00:00"), ("c", "2024-01-01 00:00:00"), ("d", None)], "source_name string, p string")
    raw = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 12:00:00"), ("d", "2024-01-01 00:00:00")], "source_name string, c string")
    gaps = reports.coverage_gaps(poll.withColumn("published_at", F.col("p").cast("timestamp")), raw.withColumn("created_at", F.col("c").cast("timestamp")))
    assert {r["source_name"]: r["gap"] for r in gaps.collect()} == {"a": True, "b": False, "c": False, "d": False}


def test_publish_switches_the_pointer(spark, tmp_path):
    root = str(tmp_path / "brief")
    assert tables.published(spark, root) is None
    for version in (1, 2, 2):
        tables.publish(spark.range(version), root, version)
    assert tables.current_version(spark, root) == 2 and tables.published(spark, root).count() == 2
    assert tables.published(spark, root, 1).count() == 1


def test_bucketed_join_has_no_shuffle(spark):
    raw = spark.range(1000).select(F.col("id").cast("string").alias("raw_id"), F.lit("body").alias("body"))
    tables.save_bucketed(raw, "nf_raw", "raw_id", 4)
    tables.save_bucketed(raw.where("raw_id like '1%'"), "nf_cleaned", "raw_id", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = spark.table("nf_raw").join(spark.table("nf_cleaned").select("raw_id"), "raw_id", "left_anti")
        assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
        assert plan.count() == 889
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table nf_raw")
        spark.sql("drop table nf_cleaned")


def test_live_scan_is_pushed_down(spark, tmp_path):
    path = str(tmp_path / "raw")
    rows = [("1", "s", "u", "t", "b", None, None, "h", None, False, None)]
    from newsflow import schemas
    spark.createDataFrame(rows, schemas.RAW_NEWS).write.parquet(path)
    plan = tables.read_raw(spark, path).select("raw_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(is_deleted), Not(EqualTo(is_deleted,true))]" in plan and "body" not in plan
