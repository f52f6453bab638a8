"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into passages of words.  A randomised SVD of their TF-IDF matrix, in which benchmark
passages are weighted rows, gives a latent space: each task adds up its part of A'(A R) for a seeded random
matrix R, the parts are summed by blocks of columns, and an orthonormal base of the sum spans the space.
The columns are the benchmark's words, as others never add to an inner product with a benchmark passage; those
count in the lengths of passages only, and words of more than a tenth of all passages have no weight.
Passage frequencies and the sum cover every passage.  Sliding windows of every document whose cosine with a
benchmark passage, estimated in that space, is high are candidates; so are windows with enough of an item's rarest
words, which any window with ``ITEM_SHARE`` of its words in order has, however common they are or large the corpus is.  A candidate is a leak if the longest common subsequence of the item's words and the text around the
window holds enough of the item, and enough of the answer, the item's last words.

The benchmark is taken in blocks of bounded size, one search over all documents for each.

Defined results: null or empty texts and items without words match nothing; repeated items are all
reported; repeated rows are reported once per (doc_id, text, item); null ids are kept; an empty benchmark or
table gives no rows; further columns are ignored (``clean`` keeps them).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsflow.llm import arrow
from newsflow.llm.names import unused
from newsflow.session import is_small, materialise

#: Words of a passage, and the step of sliding windows (a passage is a whole number of steps).
PASSAGE, STEP = 48, 16
#: Latent dimensions.
RANK = 96
#: Words of more than this share of passages have no weight in the space.
COMMON = 0.1
#: Weight of benchmark rows, as a share of the number of corpus passages over that of benchmark passages.
BENCHMARK_WEIGHT = 1.0
COSINE = 0.25
#: Shares of the item's and of the answer's words that must be found in order.
ITEM_SHARE, ANSWER_SHARE = 0.7, 0.5
#: The answer: this share of an item's words, at its end.
ANSWER = 0.25
BLOCKS = 64
ITEMS_AT_ONCE = 20_000
_SLICE = 768 << 10
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_PLAIN_ENDS = "^[0-9A-Za-zß-öø-ÿ](?s:.*[0-9A-Za-zß-öø-ÿ])?$"


class Vocabulary:
    """The benchmark's words as columns, found by a bitmap of hashes and then by search."""

    def __init__(self, words: list[np.ndarray]):
        self.codes = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint32)
        self.bitmap = np.zeros(1 << 20, dtype=bool)
        self.bitmap[self.codes & np.uint32((1 << 20) - 1)] = True

    def __len__(self) -> int:
        return len(self.codes)

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the known words in ``codes``, and their columns."""
        at = np.flatnonzero(self.bitmap[codes & np.uint32((1 << 20) - 1)])
        if not len(at):
            return at, at
        column = np.searchsorted(self.codes, codes[at]).clip(max=len(self.codes) - 1)
        known = self.codes[column] == codes[at]
        return at[known], column[known]


@dataclass(frozen=True)
class Weights:
    """Weights of the columns (0 for common words), that of any other word, and passages that hold each column."""

    vocabulary: Vocabulary
    idf: np.ndarray
    other: float
    held: np.ndarray


@dataclass(frozen=True)
class Space:
    """Weights and an orthonormal base (columns x rank)."""

    weights: Weights
    base: np.ndarray


@dataclass(frozen=True)
class Rare:
    """Items (by column, ``first`` to the next) that have the column among their rarest words; least number of these in a leak."""

    first: np.ndarray
    item: np.ndarray
    least: np.ndarray


@dataclass(frozen=True)
class Items:
    """Items' words; scaled latent vectors of their passages and the item of each."""

    ids: list
    words: list[np.ndarray]
    latent: np.ndarray
    item: np.ndarray
    rare: Rare



def word_codes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the lower-case words without outer punctuation, and the texts' offsets."""
    number, words, offsets = arrow.distinct_words(pc.utf8_lower(values))
    bare = _without_edges(words)
    code = (arrow.hashed(bare) >> np.uint64(32)).astype(np.uint32)
    filled = np.asarray(pc.binary_length(bare)) > 0
    keep = filled[number] if len(number) else np.zeros(0, dtype=bool)
    before = np.concatenate([[0], np.cumsum(keep)])
    return code[number[keep]], before[offsets]


def _without_edges(words: pa.Array) -> pa.Array:
    """Words without outer punctuation.  Where plain letters or digits are left at both ends once ASCII marks are gone, nothing else is to go."""
    bare = pc.ascii_trim(words, characters=_MARKS)
    odd = np.flatnonzero(~np.asarray(pc.match_substring_regex(bare, _PLAIN_ENDS)))
    if not len(odd):
        return bare
    mask = np.zeros(len(bare), dtype=bool)
    mask[odd] = True
    return pc.replace_with_mask(bare, pa.array(mask), pa.array([_EDGE.sub("", w) for w in bare.take(pa.array(odd)).to_pylist()], pa.string()))


def coded(docs: DataFrame) -> DataFrame:
    """Stored: ``doc_id``, ``text_key`` and the word hashes of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow.slices(batches, limit=2 * arrow.SLICE_BYTES):
            codes, cuts = word_codes(arrow.texts(batch))
            rows = [codes[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(rows, pa.binary())], ["doc_id", "text_key", "codes"])

    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text")
    )
    return materialise(rows.mapInArrow(run, "doc_id bigint, text_key bigint, codes binary"), "codes")


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Codes and offsets of a slice of stored rows."""
    values = [v.as_py() for v in batch.column("codes")]
    return np.frombuffer(b"".join(values), dtype=np.uint32), np.concatenate([[0], np.cumsum([len(v) // 4 for v in values])]).astype(np.int64)


def _pieces(cuts: np.ndarray, size: int) -> np.ndarray:
    """First positions of runs of ``size`` words inside texts with these offsets."""
    lengths = np.diff(cuts)
    runs = -(-lengths // size)
    within = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    return np.repeat(cuts[:-1], runs) + size * within


def frequencies(stored: DataFrame, vocabulary: Vocabulary) -> tuple[np.ndarray, int]:
    """Passages that hold each column, and all passages."""
    shared = stored.sparkSession.sparkContext.broadcast(vocabulary)
    columns = len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, passages = np.zeros(columns, dtype=np.int64), 0
        for batch in arrow.slices(batches, "codes"):
            codes, cuts = _read(batch)
            at, column = shared.value.find(codes)
            starts = _pieces(cuts, PASSAGE)
            passage = np.searchsorted(starts, at, side="right")
            total += np.bincount(np.unique(passage * columns + column) % max(1, columns), minlength=columns)
            passages += len(starts)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(held, -1), pa.int32()), pa.array(np.append(total[held], passages), pa.int64())], ["column", "n"]
        )

    rows = stored.select("codes").mapInArrow(run, "column int, n bigint").groupBy("column").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(columns + 1, dtype=np.int64)  # one row per column
    for row in rows:
        counts[row["column"]] = row["n"]
    return counts[:columns], int(counts[columns])


def summed_by_piece(codes: np.ndarray, starts: np.ndarray, weights: Weights, vectors: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per piece: weighted sum of its words' vectors, squared length; and position's piece, column and weight of the weighty words."""
    at, column = weights.vocabulary.find(codes)
    piece = np.searchsorted(starts, at, side="right") - 1
    known = np.bincount(piece, minlength=len(starts))
    weight = weights.idf[column]
    use = weight > 0
    piece, column, weight = piece[use], column[use], weight[use]
    others = np.diff(np.append(starts, len(codes))) - known
    squared = np.bincount(piece, weights=weight.astype(np.float64) ** 2, minlength=len(starts)) + others * weights.other**2
    sums = np.zeros((len(starts), RANK), dtype=np.float32)
    if len(piece):
        first = np.flatnonzero(np.diff(piece, prepend=-1))
        sums[piece[first]] = np.add.reduceat(vectors[column] * weight[:, None], first)
    return sums, squared, piece, column, weight


def product(codes: np.ndarray, cuts: np.ndarray, weights: Weights, random: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The columns of a slice and their rows of A'(A R), for passages of unit length."""
    sums, squared, piece, column, weight = summed_by_piece(codes, _pieces(cuts, PASSAGE), weights, random)
    inner = (sums / np.maximum(squared, 1e-9)[:, None]).astype(np.float32)
    order = np.argsort(column, kind="stable")
    held, first = np.unique(column[order], return_index=True)
    if not len(held):
        return held, np.zeros((0, RANK), np.float32)
    return held, np.add.reduceat(inner[piece[order]] * weight[order][:, None], first)


def _random(columns: int) -> np.ndarray:
    return np.random.default_rng(11).standard_normal((columns, RANK)).astype(np.float32)


def space(stored: DataFrame, benchmark: list[np.ndarray]) -> Space:
    """The latent space of all passages and the weighted benchmark."""
    vocabulary = Vocabulary(benchmark)
    columns = len(vocabulary)
    counts, passages = frequencies(stored, vocabulary)
    idf = np.log((passages + 1) / (counts + 1)).astype(np.float32)
    # the few passages of a small corpus say nothing on what is common
    idf[counts > max(COMMON * passages, 10)] = 0
    weights = Weights(vocabulary, np.maximum(idf, 0), float(np.log((passages + 1) / 2)), counts)
    shared = stored.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random, total = _random(columns), np.zeros((columns, RANK), dtype=np.float32)
        for batch in arrow.slices(batches, "codes", limit=2 * _SLICE):
            codes, cuts = _read(batch)
            held, rows = product(codes, cuts, shared.value, random)
            total[held] += rows
        for block, part in enumerate(np.array_split(total, BLOCKS)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["block", "part"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(part, dtype=np.float32) for part in rows["part"])
        return pd.DataFrame({"block": rows["block"].iloc[:1], "part": [total.astype(np.float32).tobytes()]})

    tasks = max(2 * stored.sparkSession.sparkContext.defaultParallelism, stored.rdd.getNumPartitions() // 8)
    parts = stored.select("codes").coalesce(tasks).mapInArrow(run, "block int, part binary")
    if tasks > 256:
        parts = parts.groupBy("block", F.pmod(F.xxhash64("part"), F.lit(64)).alias("_t")).applyInPandas(add, "block int, part binary")
    summed = np.zeros((columns, RANK), dtype=np.float64)
    places = np.array_split(np.arange(columns), BLOCKS)
    for row in parts.groupBy("block").applyInPandas(add, "block int, part binary").collect():  # BLOCKS rows, a row of numbers per column in all
        summed[places[row["block"]]] = np.frombuffer(row["part"], dtype=np.float32).reshape(-1, RANK)
    filled = [w for w in benchmark if len(w)]
    if filled:
        codes, cuts = np.concatenate(filled), np.concatenate([[0], np.cumsum([len(w) for w in filled])]).astype(np.int64)
        held, rows = product(codes, cuts, weights, _random(columns))
        summed[held] += rows * (BENCHMARK_WEIGHT * max(1, passages) / max(1, len(_pieces(cuts, PASSAGE))))
    base, _ = np.linalg.qr(summed) if columns else (summed, None)
    full = np.zeros((columns, RANK), dtype=np.float32)
    full[:, : base.shape[1]] = base
    return Space(weights, full)


def latent(codes: np.ndarray, cuts: np.ndarray, space: Space) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Latent vectors of the windows that start at every step, their full lengths and their first positions."""
    starts = _pieces(cuts, STEP)
    steps, squared, *_ = summed_by_piece(codes, starts, space.weights, space.base)
    text = np.searchsorted(cuts, starts, side="right")
    windows, length = steps.copy(), squared.copy()
    for ahead in range(1, PASSAGE // STEP):
        same = np.flatnonzero(text[ahead:] == text[:-ahead])
        windows[same] += steps[same + ahead]
        length[same] += squared[same + ahead]
    return windows, np.sqrt(np.maximum(length, 1e-9)), starts


def rarest(words: list[np.ndarray], weights: Weights) -> Rare:
    """A leak lacks at most ``missing`` of an item's words, so it has ``least`` of any ``missing + least`` of them."""
    pairs, least = [], np.ones(len(words), dtype=np.int64)
    for number, codes in enumerate(words):
        if len(codes):
            missing = len(codes) - math.ceil(ITEM_SHARE * len(codes) - 1e-9)
            least[number] = max(1, (len(codes) - missing) // 4)
            column = np.searchsorted(weights.vocabulary.codes, codes)
            column = np.unique(column[np.argsort(weights.held[column], kind="stable")][: missing + least[number]])
            pairs.append(np.stack([column, np.full(len(column), number)]))
    column, item = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), dtype=np.int64)
    order = np.argsort(column, kind="stable")
    return Rare(np.searchsorted(column[order], np.arange(len(weights.vocabulary) + 1)), item[order], least)


def exact_candidates(codes: np.ndarray, cuts: np.ndarray, vocabulary: Vocabulary, items: Items) -> np.ndarray:
    """Text, first position of a window and item, for windows with enough of the item's rarest words about them."""
    at, column = vocabulary.find(codes)
    first, rare = items.rare.first, items.rare
    many = first[column + 1] - first[column]
    within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    item = rare.item[np.repeat(first[column], many) + within]
    order = np.argsort(item.astype(np.uint16) if len(items.words) <= 1 << 16 else item, kind="stable")
    item, at = item[order], np.repeat(at, many)[order]
    last = np.arange(len(item)) + rare.least[item] - 1
    inside = np.flatnonzero(last < len(item))
    last, sizes = last[inside], np.array([len(w) for w in items.words], dtype=np.int64)
    inside_at, inside_item = at[inside], item[inside]
    near = (item[last] == inside_item) & (at[last] - inside_at < PASSAGE + 2 * sizes[inside_item])
    inside_at, inside_item, end = inside_at[near], inside_item[near], at[last[near]]
    text = np.searchsorted(cuts, inside_at, side="right") - 1
    same = end < cuts[text + 1]
    text, inside_at, inside_item = text[same], inside_at[same], inside_item[same]
    low = inside_at - (inside_at - cuts[text]) % STEP
    return np.unique(np.stack([text, low, inside_item], axis=1), axis=0) if len(low) else np.zeros((0, 3), dtype=np.int64)


def prepared(ids: list, words: list[np.ndarray], space: Space) -> Items:
    """Latent passages of the items; items without words have none, those of common words only have empty ones."""
    starts, rows = [], []
    for number, codes in enumerate(words):
        if len(codes):
            cuts = np.array([0, len(codes)], dtype=np.int64)
            vectors, lengths, at = latent(codes, cuts, space)
            whole = [k for k, low in enumerate(at.tolist()) if low % PASSAGE == 0]
            # divided by the share of the passage that the space holds: a product then estimates the cosine itself
            held = (vectors[whole] ** 2).sum(axis=1)
            scale = np.where(held > 1e-6, lengths[whole] / np.maximum(held, 1e-6), 0)
            rows.append((vectors[whole] * scale[:, None]).astype(np.float32))
            starts += [number] * len(whole)
    return Items(ids, words, np.concatenate(rows) if rows else np.zeros((0, RANK), np.float32), np.array(starts, dtype=np.int64), rarest(words, space.weights))


def common_subsequence(masks: dict[int, int], length: int, text: list[int]) -> int:
    """Length of the longest common subsequence of a pattern (bit masks of its words) and a text."""
    full = (1 << length) - 1
    rest = full
    for word in text:
        hit = masks.get(word)
        if hit is not None:
            met = rest & hit
            rest = ((rest + met) | (rest - met)) & full
    return length - rest.bit_count()


def _masks(words: np.ndarray) -> dict[int, int]:
    masks: dict[int, int] = {}
    for k, word in enumerate(words.tolist()):
        masks[word] = masks.get(word, 0) | 1 << k
    return masks


def search(stored: DataFrame, space: Space, items: Items) -> DataFrame:
    """Leaks of these items in all documents: ``doc_id``, ``text_key``, ``item``, ``cosine``, ``item_share``, ``answer_share``."""
    shared = stored.sparkSession.sparkContext.broadcast((space, items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, items = shared.value
        answers = [w[-max(1, round(ANSWER * len(w))) :] for w in items.words]
        masks = [(_masks(w), _masks(a)) for w, a in zip(items.words, answers)]
        for batch in arrow.slices(batches, "codes", limit=_SLICE):
            codes, cuts = _read(batch)
            vectors, lengths, every = latent(codes, cuts, space)
            filled = np.flatnonzero(vectors.any(axis=1))
            starts = every[filled]
            cosine = (vectors[filled] @ items.latent.T) / lengths[filled, None]
            window, passage = np.nonzero(cosine >= COSINE)
            text = np.searchsorted(cuts, starts[window], side="right") - 1
            found: dict[tuple[int, int], tuple[float, float, float]] = {}

            def shares(row: int, low: int, item: int) -> tuple[float, float] | None:
                """Shares of item and answer around a window, if it is a leak."""
                size = len(items.words[item])
                around = codes[max(int(cuts[row]), low - size) : min(int(cuts[row + 1]), low + PASSAGE + size)].tolist()
                share = common_subsequence(masks[item][0], size, around) / size
                if share >= ITEM_SHARE:
                    answer = common_subsequence(masks[item][1], len(answers[item]), around) / len(answers[item])
                    return (share, answer) if answer >= ANSWER_SHARE else None
                return None

            for k in np.argsort(-cosine[window, passage], kind="stable").tolist():
                row, item = int(text[k]), int(items.item[passage[k]])
                if (row, item) not in found and (leak := shares(row, int(starts[window[k]]), item)):
                    found[row, item] = (float(cosine[window[k], passage[k]]), *leak)
            for row, low, item in exact_candidates(codes, cuts, space.weights.vocabulary, items).tolist():
                if (row, item) not in found and (leak := shares(row, low, item)):
                    k = int(np.searchsorted(every, low))
                    close = (items.latent[items.item == item] @ vectors[k]) / lengths[k]
                    found[row, item] = (float(close.max()), *leak)
            if found:
                rows = pa.array([r for r, _ in found])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(rows), batch.column("text_key").take(rows), pa.array([i for _, i in found], pa.int32()),
                     *(pa.array([v[k] for v in found.values()], pa.float64()) for k in range(3))],
                    ["doc_id", "text_key", "item", "cosine", "item_share", "answer_share"],
                )

    return stored.mapInArrow(run, "doc_id bigint, text_key bigint, item int, cosine double, item_share double, answer_share double")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document text and benchmark item that it holds."""
    spark = docs.sparkSession
    kind = benchmark.schema["item_id"].dataType
    stored = coded(docs)
    blocks = max(1, -(-benchmark.count() // ITEMS_AT_ONCE))
    found = None
    for block in range(blocks):
        part = benchmark.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).select("item_id", "text").collect()  # a bounded block
        part = sorted(part, key=lambda r: (r["item_id"] is None, r["item_id"], r["text"] or ""))
        codes, cuts = word_codes(pa.array([r["text"] or "" for r in part], pa.string()))
        words = [codes[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        base = space(stored, words)
        items = prepared([r["item_id"] for r in part], words, base)
        names = spark.createDataFrame([(k, i) for k, i in enumerate(items.ids)], f"item int, item_id {kind.simpleString()}")
        hits = search(stored, base, items).join(F.broadcast(names), "item").drop("item")
        found = hits if found is None else found.unionByName(hits)
    return found.groupBy("doc_id", "text_key", "item_id").agg(
        F.max("cosine").alias("cosine"), F.max("item_share").alias("item_share"), F.max("answer_share").alias("answer_share")
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item."""
    key, doc, text = unused(docs, "_key", "_doc", "_text_key")
    bad = materialise(leaks(docs, benchmark).select(F.col("doc_id").alias(doc), F.col("text_key").alias(text)).distinct(), "leaks")
    bad = F.broadcast(bad) if is_small(bad, 1_000_000) else bad
    same = (F.col(key) == F.col(text)) & F.col("doc_id").cast("bigint").eqNullSafe(F.col(doc))
    return docs.withColumn(key, F.xxhash64("text")).join(bad, same, "left_anti").drop(key)
