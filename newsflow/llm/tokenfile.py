"""Token files: frequency-ranked ids in byte-aligned variable-length coding.

The most frequent id of the corpus gets rank 0, and so on.  A rank takes one to four data bytes,
little-endian, as few as it needs.  The number of bytes less one is two bits of a control byte that
holds those of four ids; control bytes stand apart from data bytes, so numpy decodes with one table
lookup per control byte.  A file is Parquet, written by Spark: one row per document in ascending
order of doc_id, with its control and data bytes, the number of its segment (file part) and the ids
before it in the segment.  The rank table lies beside the segments.

Defined results: a null or empty text is the end id alone; null document ids come first; repeated
rows are written one after another; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsflow.llm import arrow, tokens
from newsflow.session import materialise, small

_CODED = "doc_id bigint, segment int, segment_start bigint, n_tokens bigint, control binary, data binary"
_READ = "doc_id bigint, segment int, segment_start bigint, n_tokens bigint, ids_crc32 bigint"

_SLICE = 1 << 20

#: Byte counts of the four ids of each control byte.
_LENGTHS = ((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3) + 1


def encode_ranks(ranks: np.ndarray, cuts: np.ndarray) -> list[tuple[bytes, bytes]]:
    """Control and data bytes of each text's ranks; ``cuts`` are the texts' offsets."""
    ranks = ranks.astype("<u4")
    code = ((ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)).astype(np.uint8)
    sizes = np.diff(cuts)
    quads = -(-sizes // 4)
    first = np.concatenate([[0], np.cumsum(quads)])
    padded = np.zeros(4 * first[-1], dtype=np.uint8)
    padded[np.arange(len(ranks)) + np.repeat(4 * first[:-1] - cuts[:-1], sizes)] = code
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1, dtype=np.uint8).tobytes()
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) <= code[:, None]].tobytes()
    ends = np.concatenate([[0], np.cumsum(code, dtype=np.int64) + np.arange(1, len(code) + 1)])[cuts].tolist()
    first = first.tolist()
    return [(control[first[k] : first[k + 1]], data[ends[k] : ends[k + 1]]) for k in range(len(sizes))]


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """Ranks from control and data bytes, by looking up each control byte in a table."""
    lengths = _LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:n]
    starts = np.cumsum(lengths) - lengths
    raw = np.frombuffer(data + b"\0\0\0", dtype=np.uint8)
    value = raw[starts].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(lengths > k)
        if not len(more):
            break
        value[more] |= raw[starts[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return value


def _id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def token_ids(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, number of ids, their CRC-32 and the ids as bytes (two or four each, by the vocabulary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = _id_type(tokens.encoder(path).vocabulary)
        for batch, ids, cuts in tokens.encoded(batches, path):
            spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
            narrow = ids.astype(kind)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(np.diff(cuts), pa.int64()),
                    pa.array([tokens.crc32(ids[a:b]) for a, b in spans], pa.int64()),
                    pa.array([narrow[a:b].tobytes() for a, b in spans], pa.binary()),
                ],
                ["doc_id", "n_tokens", "ids_crc32", "ids"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_crc32 bigint, ids binary")


def id_counts(ids: DataFrame, kind: str, vocabulary: int) -> DataFrame:
    """How often each id occurs; summed in each task first, so at most a vocabulary per task moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, dtype=np.int64)
        for batch in arrow.slices(batches, "ids"):
            total += np.bincount(np.frombuffer(b"".join(v.as_py() for v in batch.column("ids")), dtype=kind), minlength=vocabulary)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], ["id", "n"])

    return ids.select("ids").mapInArrow(run, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def write(docs: DataFrame, folder: str, path: str) -> None:
    """Write the rank table and the token files of ``docs`` under ``folder``."""
    vocabulary = max(tokens.encoder(path).vocabulary, tokens.END_ID + 1)
    kind = _id_type(vocabulary)
    stored = materialise(token_ids(docs, path), "ids")
    counted = id_counts(stored, kind, vocabulary).collect()  # bounded by the vocabulary
    order = sorted(counted, key=lambda r: (-r["n"], r["id"]))
    spark = docs.sparkSession
    spark.createDataFrame([(i, r["id"], r["n"]) for i, r in enumerate(order)], "rank int, id int, n bigint").coalesce(
        1
    ).write.parquet(f"{folder}/ranks")
    table = np.zeros(vocabulary, dtype=np.uint32)
    table[[r["id"] for r in order]] = np.arange(len(order), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, before = TaskContext.get().partitionId(), 0
        for batch in arrow.slices(batches, "ids", limit=_SLICE):
            sizes = np.asarray(batch.column("n_tokens"))
            ids = np.frombuffer(b"".join(v.as_py() for v in batch.column("ids")), dtype=kind)
            coded = encode_ranks(shared.value[ids], np.concatenate([[0], np.cumsum(sizes)]))
            starts = before + np.cumsum(sizes) - sizes
            before += int(sizes.sum())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(np.full(len(sizes), segment), pa.int32()), pa.array(starts, pa.int64()),
                    batch.column("n_tokens"), pa.array([c for c, _ in coded], pa.binary()), pa.array([d for _, d in coded], pa.binary()),
                ],
                ["doc_id", "segment", "segment_start", "n_tokens", "control", "data"],
            )

    order_by = [F.asc_nulls_first("doc_id"), F.asc("ids_crc32")]
    ranged = stored.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    ranged.select("doc_id", "n_tokens", "ids").mapInArrow(run, _CODED).write.parquet(f"{folder}/segments")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Decode the files: doc_id, ids before it in all files, number of ids, CRC-32 of the ids."""
    ranks = spark.read.schema("rank int, id int, n bigint").parquet(f"{folder}/ranks").orderBy("rank").collect()
    shared = spark.sparkContext.broadcast(np.array([r["id"] for r in ranks], dtype=np.uint32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("control"), batch.column("data"), batch.column("n_tokens").to_pylist())
            crcs = [tokens.crc32(shared.value[decode_ranks(c.as_py(), d.as_py(), n)]) for c, d, n in rows]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in ("doc_id", "segment", "segment_start", "n_tokens")), pa.array(crcs, pa.int64())],
                ["doc_id", "segment", "segment_start", "n_tokens", "ids_crc32"],
            )

    stored = spark.read.schema(_CODED).parquet(f"{folder}/segments")
    totals = stored.groupBy("segment").agg(F.sum("n_tokens").alias("_total"))
    # one row per file part
    ahead = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("segment", F.coalesce(F.sum("_total").over(ahead), F.lit(0)).alias("_base"))
    return (
        stored.mapInArrow(run, _READ)
        .join(small(bases), "segment")
        .select("doc_id", (F.col("segment_start") + F.col("_base")).alias("start"), "n_tokens", "ids_crc32")
    )
