"""Bounded-space online best-fit packing of documents into sequences of a fixed number of tokens.

A document is its token ids and an end id.  Only documents longer than a sequence are cut.  Pieces
are dealt by hash into lots of bounded size, each packed by one task: every open sequence is kept
under its free space, whose set of values is a bitset, so the tightest sequence that holds a piece
is found with a few integer operations.  A fixed number of sequences is open; when a piece fits in
none and no more may be opened, the fullest closes.  Pieces arrive in rounds of a few hundred
sequences' worth, the longest of a round first, so that short ones fill what is left.

Defined results: a null or empty text is the end id alone; equal rows are packed as separate pieces;
null document ids are kept; an empty table gives no rows; further input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsflow.llm import tokens
from newsflow.session import materialise

SEQUENCE_TOKENS = 4096
OPEN_SEQUENCES = 512
#: Tokens and pieces of a lot: what one task packs.
LOT_TOKENS = 1 << 24
LOT_PIECES = 1 << 16
#: Tokens of a round within a lot.
ROUND_TOKENS = 1 << 20

_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, path: str, capacity: int = SEQUENCE_TOKENS, with_ids: bool = False) -> DataFrame:
    """One row per piece of at most ``capacity`` tokens; ``with_ids`` adds the ids themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, cuts in tokens.encoded(batches, path):
            sizes = np.diff(cuts)
            per_doc = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), per_doc)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
            start = piece * capacity
            length = np.minimum(sizes[row] - start, capacity)
            low = cuts[:-1][row] + start
            spans = list(zip(low.tolist(), (low + length).tolist()))
            out = [
                batch.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                pa.array(length, pa.int64()), pa.array([tokens.crc32(ids[a:b]) for a, b in spans], pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                out.append(pa.array([ids[a:b].astype(np.int32) for a, b in spans], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _PIECES + (", ids array<int>" if with_ids else ""))


def best_fit(lengths: list[int], capacity: int, open_limit: int) -> tuple[list[int], list[int]]:
    """Sequence number and offset of each length, taken in the given order."""
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    frees, opened, made = 0, 0, 0
    places, offsets = [], []
    for length in lengths:
        fitting = frees >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
        else:
            if opened == open_limit:
                fullest = (frees & -frees).bit_length() - 1
                by_free[fullest].pop()
                if not by_free[fullest]:
                    frees ^= 1 << fullest
                opened -= 1
            free = capacity
            by_free[free].append(made)
            frees |= 1 << free
            made += 1
            opened += 1
        place = by_free[free].pop()
        if not by_free[free]:
            frees ^= 1 << free
        places.append(place)
        offsets.append(capacity - free)
        left = free - length
        if left:
            by_free[left].append(place)
            frees |= 1 << left
        else:
            opened -= 1
    return places, offsets


def pack(cut: DataFrame, capacity: int = SEQUENCE_TOKENS, open_limit: int = OPEN_SEQUENCES) -> DataFrame:
    """Give each piece a ``sequence_id`` and its ``offset`` there.

    ``cut`` should be stored: it is read once for its totals and once to be packed.  Only the
    narrow rows move, once, dealt evenly by hash.
    """
    total = cut.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("tokens"), F.count("*").alias("pieces")).first()
    lots = max(1, -(-total["tokens"] // LOT_TOKENS), -(-total["pieces"] // LOT_PIECES))
    rounds = max(1, -(-total["tokens"] // (lots * ROUND_TOKENS)))
    dealt = F.xxhash64("doc_id", "piece", "ids_crc32")
    rows = cut.withColumn("_lot", F.pmod(dealt, F.lit(lots))).withColumn(
        "_round", F.pmod(F.shiftright(dealt, 20), F.lit(rounds))
    )

    def place(lot: pd.DataFrame) -> pd.DataFrame:
        # packed in place order: round, then length, then the key, so a repeated task gives the same places
        lot = lot.sort_values(["_round", "length", "doc_id", "piece", "ids_crc32"], ascending=[True, False, True, True, True])
        bins, offsets = best_fit(lot["length"].tolist(), capacity, open_limit)
        lot["sequence_id"] = lot["_lot"].astype("int64") * (1 << 32) + np.array(bins, dtype=np.int64)
        lot["offset"] = np.array(offsets, dtype=np.int64)
        return lot.drop(columns=["_lot", "_round"])

    schema = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return rows.groupBy("_lot").applyInPandas(place, schema)


def packed_documents(docs: DataFrame, path: str, capacity: int = SEQUENCE_TOKENS) -> DataFrame:
    """Places of all pieces of ``docs``."""
    return pack(materialise(pieces(docs, path, capacity), "pieces"), capacity)


def sequences(docs: DataFrame, path: str, capacity: int = SEQUENCE_TOKENS) -> DataFrame:
    """The packed sequences themselves: ``sequence_id`` and its ids, at most ``capacity`` of them."""
    cut = pieces(docs, path, capacity, with_ids=True).withColumn("_n", F.monotonically_increasing_id())
    cut = materialise(cut, "pieces")
    places = pack(cut.select("doc_id", "piece", "ids_crc32", "length", "_n"), capacity)
    joined = cut.select("_n", "ids").join(places.select("_n", "sequence_id", "offset"), "_n")
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return joined.groupBy("sequence_id").agg(F.flatten(parts.getField("ids")).alias("ids"))
