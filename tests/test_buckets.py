"""Bucketed tables: untouched files stay, probes read few buckets, hot keys spread."""

import glob
import os
import random

from pyspark.sql import functions as F

from newsflow.operators import dedup
from newsflow.sources.buckets import SPREAD, Buckets

SCHEMA = "k string, v bigint, at bigint"


def _table(spark, tmp_path, count=16, keys=("k",)):
    return Buckets(str(tmp_path / "t"), spark.createDataFrame([], SCHEMA).schema, keys, count)


def _rows(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    table, rng, want = _table(spark, tmp_path), random.Random(1), {}
    for turn, keys in enumerate((200, 3, 40)):
        rows = [(f"k{rng.randint(0, 199)}", rng.randint(0, 9), rng.randint(0, 50)) for _ in range(keys)]
        before = set(table.paths(spark))
        touched = table.upsert(_rows(spark, rows), "at", "v")
        for k, v, at in rows:
            want[k] = max(want.get(k, (-1, -1)), (at, v))
        assert {r["k"]: (r["at"], r["v"]) for r in table.read(spark).collect()} == want
        after = set(table.paths(spark))
        stayed = {p for p in before if int(p.rsplit("=", 1)[1]) not in touched}
        assert stayed <= after and all(f"gen={turn}/" in p for p in after - stayed)
    assert len(after) <= 16


def test_probe_reads_only_buckets_a_key_may_be_in(spark, tmp_path, monkeypatch):
    table = _table(spark, tmp_path)
    table.append(_rows(spark, [(f"k{i}", i, 0) for i in range(0, 400, 2)]))
    table.append(_rows(spark, [("late", 1, 1)]))
    asked = []
    paths = Buckets.paths
    monkeypatch.setattr(Buckets, "paths", lambda self, spark, buckets=None: asked.append(buckets) or paths(self, spark, buckets))
    rows = _rows(spark, [("k2", 0, 0), ("late", 0, 0), ("new", 0, 0), ("other", 0, 0), (None, 0, 0)])
    assert sorted(str(r["k"]) for r in table.absent(rows).collect()) == ["None", "new", "other"]
    assert len(asked) == 1 and len(asked[0]) == 2  # of 16
    suspects = table.suspected(_rows(spark, [(f"x{i}", i, 0) for i in range(1000)])).where("_may").count()
    assert suspects <= 2  # a few hundred keys in sixteen times 65536 bits


def test_empty_store_and_empty_rows(spark, tmp_path):
    table = _table(spark, tmp_path)
    assert table.read(spark).count() == 0 and table.absent(_rows(spark, [("a", 1, 1)])).count() == 1
    assert table.lookup(_rows(spark, [("a", 1, 1)])).count() == 0
    table.upsert(_rows(spark, []), "at")
    table.append(_rows(spark, []))
    assert table.read(spark).count() == 0


def test_hot_key_spreads_and_lookup_reads_its_bucket(spark, tmp_path):
    table = _table(spark, tmp_path)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # it would join partitions as small as these
    table.append(_rows(spark, [("hot" if i % 3 == 0 else f"k{i}", i, 0) for i in range(3000)]))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    (bucket,) = table.touched(_rows(spark, [("hot", 0, 0)]))
    files = glob.glob(f"{table.root}/data/gen=0/bucket={bucket}/*.parquet")
    assert 1 < len(files) <= SPREAD * 2
    got = table.lookup(_rows(spark, [("hot", 0, 0), ("hot", 1, 1), ("none", 0, 0)]))
    assert got.count() == 1000
    read = {os.path.basename(os.path.dirname(f)) for f in got.inputFiles()}
    assert f"bucket={bucket}" in read or len(read) <= 2


def test_inserts_in_two_batches_equal_one(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"r{i:03}", f"u{rng.randint(0, 30)}", f"h{rng.randint(0, 30)}", i) for i in range(120)]
    frame = spark.createDataFrame(rows, "raw_id string, source_url string, raw_hash string, at bigint")
    stores = [
        Buckets(str(tmp_path / c), spark.createDataFrame([], f"{c} string").schema, (c,), 8) for c in ("source_url", "raw_hash")
    ]
    stored = frame.where("at < 20")
    for store in stores:
        store.append(stored)
    got = []
    for low, high in ((20, 70), (70, 120)):
        got += dedup.insert_if_absent_in(frame.where((F.col("at") >= low) & (F.col("at") < high)), *stores, F.col("at")).collect()
    want = dedup.insert_if_absent(frame.where("at >= 20"), stored, F.col("at")).collect()
    assert sorted(r["raw_id"] for r in got) == sorted(r["raw_id"] for r in want)
