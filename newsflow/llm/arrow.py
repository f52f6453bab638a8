"""Helpers for Arrow batches inside tasks: bounded slices, words of texts, text values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled at a time; bounds the memory of a task whatever the batch size.
SLICE_BYTES = 4 << 20


def slices(batches: Iterator[pa.RecordBatch], *columns: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches evenly into runs of rows of about ``limit`` bytes of ``columns`` (``text``); a longer row begins a run."""
    for batch in batches:
        lengths = [pc.fill_null(pc.binary_length(batch.column(c)), 0) for c in columns or ("text",)]
        sizes = sum(np.asarray(n, dtype=np.int64) for n in lengths)
        upto = np.cumsum(sizes)
        runs = max(1, round(int(upto[-1]) / limit)) if len(upto) else 1
        part = upto * runs // (int(upto[-1]) + 1) if runs > 1 else np.zeros(len(upto), dtype=np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:]):
            if high > low:
                yield batch.slice(low, high - low)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hashed(values: pa.Array) -> np.ndarray:
    """64-bit hashes of a string array without nulls, from its bytes; eight at a time are scrambled into those before."""
    _, offsets, data = values.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    starts, sizes = offsets[:-1], np.diff(offsets)
    out = mix(sizes)
    if not len(values) or not sizes.any():
        return out
    low, high = int(offsets[0]), int(offsets[-1])
    padded = np.zeros(high - low + 8, dtype=np.uint8)
    padded[: high - low] = np.frombuffer(data, dtype=np.uint8)[low:high]
    eights = np.ndarray(high - low + 1, dtype="<u8", buffer=padded, strides=(1,))
    at, left, rows = starts - low, sizes, None
    while True:
        last = np.minimum(left, 8)
        # bytes beyond the end are shifted out
        chunk = np.where(last > 0, eights[at] << (np.uint64(8) * (8 - last).astype(np.uint64) % np.uint64(64)), np.uint64(0))
        if rows is None:
            out = mix(out ^ chunk)
        else:
            out[rows] = mix(out[rows] ^ chunk)
        more = np.flatnonzero(left > 8)
        if not len(more):
            return out
        rows = more if rows is None else rows[more]
        at, left = at[more] + 8, left[more] - 8


def texts(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The text column with empty texts for nulls."""
    return pc.fill_null(batch.column(column), "")


def split_words(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words split at ASCII white space (space, \\t to \\r), empty ones too at the ends of texts, and the texts' offsets."""
    split = pc.ascii_split_whitespace(values)
    offsets = np.asarray(split.offsets, dtype=np.int64)
    return split.flatten(), offsets - offsets[0]


def distinct_words(values: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words split at ASCII white space, without empty ones.

    Returns the number of each word in the array of distinct words, that array, and the offsets
    of the texts in the first array.
    """
    words, offsets = split_words(values)
    codes = words.dictionary_encode()
    number, distinct = np.asarray(codes.indices), codes.dictionary
    filled = np.asarray(pc.binary_length(distinct)) > 0
    if not filled.all():
        keep = filled[number]
        before = np.concatenate([[0], np.cumsum(keep)])
        renumber = np.cumsum(filled) - 1
        return renumber[number[keep]], distinct.filter(pa.array(filled)), before[offsets]
    return number, distinct, offsets


def ascii_words(values: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """``distinct_words`` with the distinct words as a list."""
    number, distinct, offsets = distinct_words(values)
    return number, distinct.to_pylist(), offsets
