"""Sharding by fixed virtual slots.

A record's hash names one of a fixed number of slots.  Bytes are summed per slot, and a stored map,
one version per edit, says which shard holds each slot.  Rebalancing edits the map: slots leave
the fullest shards for the emptiest ones until their sizes are near equal; records never change slot.

Law of the default map: ``bytes``.  Size of a record: UTF-8 bytes of its text (none if null) plus 8.
Defined results: equal rows share a slot; null ids and texts hash as such; an empty table gives no
rows and an even map; further columns are kept by ``place`` and ignored by the query.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsflow.session import materialise, shared_dir

SLOTS = 4096


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Size, checksum and slot of each document, without its text."""
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def slot_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def first_map(shards: int, slots: int = SLOTS) -> list[int]:
    """Slots dealt in turn: the map before any sizes are known."""
    return [slot % shards for slot in range(slots)]


def rebalanced(held: list[int], sizes: dict[int, int], shards: int) -> list[int]:
    """An edited map with near equal bytes; slots that need not move stay.

    Shards above the mean give up slots, largest that fit the excess first; what was given up is
    dealt, largest first, to the emptiest shard.  Then slots are swapped down from the fullest to
    the emptiest shard while that narrows the gap.
    """
    held = list(held)
    load = [0] * shards
    members: list[list[int]] = [[] for _ in range(shards)]
    loose = []
    for slot, shard in enumerate(held):
        if shard < shards:
            load[shard] += sizes.get(slot, 0)
            members[shard].append(slot)
        else:
            loose.append(slot)
    goal = sum(sizes.values()) / shards
    for shard in range(shards):
        kept = []
        for slot in sorted(members[shard], key=lambda s: (-sizes.get(s, 0), s)):
            size = sizes.get(slot, 0)
            if size and load[shard] - goal >= size / 2:
                load[shard] -= size
                loose.append(slot)
            else:
                kept.append(slot)
        members[shard] = kept
    heap = [(load[s], s) for s in range(shards)]
    heapq.heapify(heap)
    for slot in sorted(loose, key=lambda s: (-sizes.get(s, 0), s)):
        _, shard = heapq.heappop(heap)
        members[shard].append(slot)
        load[shard] += sizes.get(slot, 0)
        heapq.heappush(heap, (load[shard], shard))
    for _ in range(8 * shards):
        full, empty = max(range(shards), key=lambda s: (load[s], -s)), min(range(shards), key=lambda s: (load[s], s))
        gap = load[full] - load[empty]
        # moving x out and y in (y may be nothing) changes the gap by twice their difference
        gains = [(sizes.get(x, 0), x, None) for x in members[full] if 0 < sizes.get(x, 0) < gap]
        incoming = sorted(((sizes.get(y, 0), y) for y in members[empty]), reverse=True)[:64]
        gains += [(sizes.get(x, 0) - size, x, y) for x in members[full][:64] for size, y in incoming if 0 < sizes.get(x, 0) - size < gap]
        if not gains:
            break
        step, out, back = min(gains, key=lambda g: (abs(gap - 2 * g[0]), g[1]))
        if abs(gap - 2 * step) >= gap:
            break
        members[full].remove(out)
        members[empty].append(out)
        if back is not None:
            members[empty].remove(back)
            members[full].append(back)
        load[full] -= step
        load[empty] += step
    for shard, slots in enumerate(members):
        for slot in slots:
            held[slot] = shard
    return held


def write_map(spark: SparkSession, folder: str, version: int, held: list[int]) -> None:
    """Store one version of the map: a row per slot."""
    rows = spark.createDataFrame([(slot, shard) for slot, shard in enumerate(held)], "virtual_slot int, shard int")
    rows.coalesce(1).write.parquet(f"{folder}/version={version}")


def read_map(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.schema("virtual_slot int, shard int").parquet(f"{folder}/version={version}")


def place(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """The shard of each record.  The map has one row per slot, so it is broadcast."""
    return rows.join(F.broadcast(slot_map), "virtual_slot", "left")


def sharded(docs: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """All documents with shard and place in it.

    The map is stored twice: version 1 before sizes are known, version 2 edited to near equal bytes.
    Places are counted per slot, one of thousands that hashing fills evenly, and a slot's first
    place is the number of records in the shard's earlier slots.
    """
    spark = docs.sparkSession
    rows = materialise(records(docs, slots), "slots")
    sizes = slot_sizes(rows).collect()  # one row per slot at most
    folder = f"{shared_dir(spark)}/newsflow/{spark.sparkContext.applicationId}/slot-map-{uuid.uuid4().hex}"
    write_map(spark, folder, 1, first_map(shards, slots))
    held = rebalanced(first_map(shards, slots), {r["virtual_slot"]: r["bytes"] for r in sizes}, shards)
    write_map(spark, folder, 2, held)
    before, counts = {}, [0] * shards
    for row in sorted(sizes, key=lambda r: r["virtual_slot"]):
        shard = held[row["virtual_slot"]]
        before[row["virtual_slot"]] = counts[shard]
        counts[shard] += row["rows"]
    firsts = spark.createDataFrame(sorted(before.items()), "virtual_slot int, _first bigint")
    slot_map = read_map(spark, folder, 2).join(F.broadcast(firsts), "virtual_slot", "left")
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return place(rows, slot_map).withColumn("place", F.col("_first") + F.row_number().over(within) - 1).drop("_first")


def write_shards(docs: DataFrame, slot_map: DataFrame, folder: str, slots: int = SLOTS) -> None:
    """Write whole documents into one folder per shard; a shard's files come from many tasks."""
    slot = F.pmod(F.xxhash64("doc_id", "text"), F.lit(slots)).cast("int")
    rows = docs.withColumn("virtual_slot", slot)
    place(rows, slot_map).drop("virtual_slot").repartition("shard", F.pmod(F.xxhash64("doc_id"), F.lit(64))).write.partitionBy(
        "shard"
    ).parquet(folder)
