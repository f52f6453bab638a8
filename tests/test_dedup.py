"""First-accepted-wins and the other duplicate rules against plain sequential code."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsflow.operators import dedup


def sequential(rows):
    urls, hashes, kept = set(), set(), []
    for rid, url, digest, at in sorted(rows, key=lambda r: (r[3], r[0])):
        if url not in urls and digest not in hashes:
            urls.add(url), hashes.add(digest), kept.append(rid)
    return sorted(kept)


def accepted(spark, rows):
    df = spark.createDataFrame(rows, "raw_id string, source_url string, raw_hash string, at int")
    return sorted(r["raw_id"] for r in dedup.first_accepted(df, F.col("at")).collect())


def test_counter_example(spark):
    rows = [("A", "u1", "h1", 1), ("B", "u2", "h1", 2), ("C", "u2", "h3", 3)]
    assert accepted(spark, rows) == ["A", "C"]


@pytest.mark.parametrize("seed", range(6))
def test_random(spark, seed):
    rng = random.Random(seed)
    n = rng.randint(5, 200)
    rows = [(f"{i:03d}", f"u{rng.randint(0, n // 2)}", f"h{rng.randint(0, n // 3)}", rng.randint(0, 20)) for i in range(n)]
    assert accepted(spark, rows) == sequential(rows)


def test_hot_hash_holds_a_third(spark):
    rows = [(f"{i:05d}", f"u{i}", "hot" if i % 3 == 0 else f"h{i % 700}", i) for i in range(6000)]
    assert accepted(spark, rows) == sequential(rows)


def test_hot_keys_by_broadcast(spark):
    rng = random.Random(3)
    rows = [(f"{i:04d}", f"u{rng.randint(0, 300)}", "hot" if i % 3 == 0 else f"h{rng.randint(0, 300)}", i) for i in range(900)]
    df = spark.createDataFrame(rows, "raw_id string, source_url string, raw_hash string, at int")
    got = sorted(r["raw_id"] for r in dedup.first_accepted(df, F.col("at"), hot_rows=50).collect())
    assert got == sequential(rows)


def test_no_rows(spark):
    assert accepted(spark, []) == []


def test_long_conflict_chain(spark):
    rows = [(f"{i:02d}", f"u{(i + 1) // 2}", f"h{i // 2}", i) for i in range(14)]
    assert accepted(spark, rows) == sequential(rows)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4)), min_size=1, max_size=25))
def test_property(spark, pairs):
    rows = [(f"{i:02d}", f"u{u}", f"h{h}", i) for i, (u, h) in enumerate(pairs)]
    assert accepted(spark, rows) == sequential(rows)


def test_insert_if_absent_against_store(spark):
    schema = "raw_id string, source_url string, raw_hash string, at int"
    stored = spark.createDataFrame([("s", "u0", "h0", 0)], schema)
    batch = spark.createDataFrame([("a", "u0", "h9", 1), ("b", "u1", "h0", 2), ("c", "u1", "h1", 3), ("d", "u2", "h1", 4)], schema)
    assert [r["raw_id"] for r in dedup.insert_if_absent(batch, stored, F.col("at")).collect()] == ["c"]


def test_latest_version_and_absent(spark):
    df = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), ("j", 1, "one")], "key string, v int, x string")
    assert sorted(map(tuple, dedup.latest_version(df, ["key"], "v").collect())) == [("j", 1, "one"), ("k", 2, "new")]
    kept = dedup.absent(df.select("key", "x"), df.where("key = 'j'"), ["key"]).collect()
    assert [tuple(r) for r in kept] == [("k", "new")]
