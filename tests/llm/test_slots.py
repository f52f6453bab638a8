import zlib

from helpers import AWKWARD, documents, prose

from newsflow.llm import slots


def test_shards(spark):
    rows = AWKWARD + [(100 + i, prose(i, 20 + i % 7)) for i in range(400)]
    got = slots.sharded(documents(spark, rows), 5).collect()
    assert sorted((r["size"], r["text_crc32"]) for r in got) == sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t in rows)
    for shard in range(5):
        assert sorted(r["place"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))
    assert len({r["virtual_slot"] for r in got if r["doc_id"] == 7}) == 1


def test_empty_table(spark):
    assert slots.sharded(documents(spark, []), 5).count() == 0


def test_rebalancing_is_near_equal_and_moves_little():
    sizes = {slot: 100 + slot * 37 % 91 for slot in range(4096)}
    first = slots.rebalanced(slots.first_map(24), sizes, 24)
    load = [sum(sizes[s] for s in range(4096) if first[s] == k) for k in range(24)]
    assert max(load) - min(load) < 100  # less than the smallest slot
    grown = slots.rebalanced(first, sizes, 25)
    load = [sum(sizes[s] for s in range(4096) if grown[s] == k) for k in range(25)]
    assert max(load) - min(load) < 100  # less than the smallest slot
    assert sum(a != b for a, b in zip(first, grown)) < 4096 / 25 * 1.5


def test_map_versions(spark, tmp_path):
    slots.write_map(spark, str(tmp_path), 1, [0, 1, 0])
    slots.write_map(spark, str(tmp_path), 2, [1, 1, 0])
    assert [r["shard"] for r in slots.read_map(spark, str(tmp_path), 2).orderBy("virtual_slot").collect()] == [1, 1, 0]


def test_written_shards(spark, tmp_path):
    docs = documents(spark, [(i, prose(i, 9)) for i in range(50)]).drop("shard")
    slots.write_map(spark, str(tmp_path / "map"), 1, slots.first_map(3))
    slots.write_shards(docs, slots.read_map(spark, str(tmp_path / "map"), 1), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50
