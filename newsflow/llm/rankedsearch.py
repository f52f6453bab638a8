"""Ranked lexical search by NRA: sequential reads of impact-sorted lists, with score intervals per document.

One pass over the texts counts the terms of the items in every document; corpus statistics come from those counts.
The documents are cut into shards of a fixed number.  A shard has one list per term: its documents by falling impact,
stored, so that other searches over the same terms read it again.  A search reads the lists of an item's terms from
the top, all to the same depth.  What a document has been seen with is the lower end of its score; the upper end
adds, for every list it has not been seen in, the impact last read there.  Reading goes on until no document outside
the best k can reach them, no tie is open and the scores of the best k are exact.  The best k of all
documents are among the best k of the shards.

How it scales.  Texts are read once per block of items and never shuffled; lists are dealt by shard, whose size is fixed.
Tasks keep the best k per item of their shards before the last shuffle.  What is sent to all tasks is bounded by
the block: ``ITEMS`` items of ``ITEM_BYTES`` text bytes altogether, or one longer item.

Defined results: terms are maximal runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased; a null text
has none; a document or item without terms is in no result; rows with one item_id are one item with the terms of all;
a null item_id is an item of its own; equal scores go by ascending doc_id, null last; repeated documents are ranked each;
texts of any length are read whole; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsflow.llm import arrow
from newsflow.session import materialise

#: Results per item; documents of a shard; entries first read of each list (doubled with every further read).
BEST, SHARD_DOCS, FIRST_READ = 50, 8192, 64
ITEMS, ITEM_BYTES = 20_000, 16 << 20

# What parts terms, and the letters that are lower-cased.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))

_FORWARD = "doc_id bigint, n bigint, terms binary, counts binary"
_LISTS = "shard bigint, term int, docs binary, factors binary"
_HITS = "item int, doc_id bigint, score bigint"


def terms(values: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """The number of each term in the list of distinct terms, that list, and the offsets of the texts."""
    values = values.cast(pa.string())
    _, offsets, data = values.buffers()
    if not len(values) or data is None:
        return np.zeros(0, dtype=np.int32), [], np.zeros(len(values) + 1, dtype=np.int64)
    ends = np.frombuffer(offsets, dtype=np.int32)[values.offset : values.offset + len(values) + 1]
    folded = memoryview(data)[ends[0] : ends[-1]].tobytes().translate(_FOLD)
    moved = pa.py_buffer((ends - ends[0]).astype(np.int32).tobytes())
    return arrow.ascii_words(pa.Array.from_buffers(pa.string(), len(values), [None, moved, pa.py_buffer(folded)]))


@dataclass(frozen=True)
class Items:
    """A block of items on the driver: ids, the numbers of their terms, and the number of each term."""

    ids: list[int | None]
    terms: list[np.ndarray]
    vocabulary: dict[str, int]


def item_blocks(items: DataFrame) -> Iterator[Items]:
    """The items in blocks of bounded size; rows of one id are in one block."""
    rows = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).first()
    blocks = max(1, math.ceil(total["n"] / ITEMS), math.ceil(total["size"] / ITEM_BYTES))
    for block in range(blocks):
        held = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()  # bounded by the block
        number, words, ends = terms(pa.array([r["text"] for r in held], pa.string()))
        by_id: dict[int | None, set[int]] = {}
        for row, low, high in zip(held, ends[:-1], ends[1:]):
            by_id.setdefault(row["item_id"], set()).update(number[low:high].tolist())
        ids = [i for i, found in by_id.items() if found]
        yield Items(ids, [np.array(sorted(by_id[i]), dtype=np.int32) for i in ids], {w: k for k, w in enumerate(words)})


def forward(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """Documents with a term: doc_id, number of terms, the known terms (sorted) and how often each occurs."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in arrow.slices(batches):
            number, words, ends = terms(arrow.texts(batch))
            wanted = np.array([known.get(w, -1) for w in words], dtype=np.int64)[number] if len(words) else np.zeros(0, np.int64)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            held = wanted >= 0
            pairs, counts = np.unique(doc[held] * len(known) + wanted[held], return_counts=True)
            cuts = np.searchsorted(pairs, np.arange(batch.num_rows + 1) * len(known)).tolist()
            term, counts = (pairs % max(len(known), 1)).astype("<i4"), counts.astype("<i4")
            some = np.flatnonzero(np.diff(ends))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(some)), pa.array(np.diff(ends)[some], pa.int64()),
                    *(pa.array([v[cuts[i] : cuts[i + 1]].tobytes() for i in some.tolist()], pa.binary()) for v in (term, counts)),
                ],
                ["doc_id", "n", "terms", "counts"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _FORWARD)


@dataclass(frozen=True)
class Corpus:
    """Documents with a term, all their terms, and the documents that hold each known term."""

    documents: int
    length: int
    holding: np.ndarray

    @property
    def weights(self) -> np.ndarray:
        top = 2 * self.documents + 2
        return np.array([math.floor(1000 * math.log(top / (2 * df + 1))) for df in self.holding.tolist()], dtype=np.int64)

    def factors(self, counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """What a term's occurrences in a document of some length are worth; the weight is left out."""
        m = 100 - 50 + (50 * lengths * self.documents) // self.length
        return (1_000_000_000 * counts) // (1000 * counts + 20 * m)


def statistics(rows: DataFrame, vocabulary: int) -> Corpus:
    """Counts over all documents; added up in each task first, so at most a vocabulary per task moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, dtype=np.int64)
        for batch in arrow.slices(batches, "terms"):
            total += np.bincount(np.frombuffer(b"".join(batch.column("terms").to_pylist()), dtype="<i4"), minlength=vocabulary)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], ["term", "n"])

    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    counted = rows.select("terms").mapInArrow(run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    holding = np.zeros(vocabulary, dtype=np.int64)
    holding[[r["term"] for r in counted]] = [r["n"] for r in counted]
    return Corpus(whole["n"], whole["length"], holding)


def lists(rows: DataFrame, corpus: Corpus, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """The lists of every shard: per term its documents by falling factor, numbered in ascending doc_id order.

    A further row per shard (term -1) has the ids of its documents; a null id is the last number and has no entry.
    """

    def shard(number: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        table = table.sort_by([("doc_id", "ascending")])  # nulls last
        sizes = np.array([len(v) // 4 for v in table.column("terms").to_pylist()], dtype=np.int64)
        term, counts = (np.frombuffer(b"".join(table.column(c).to_pylist()), dtype="<i4") for c in ("terms", "counts"))
        doc = np.repeat(np.arange(table.num_rows, dtype="<i4"), sizes)
        factor = corpus.factors(counts.astype(np.int64), np.asarray(table.column("n"))[doc]).astype("<i4")
        order = np.lexsort((doc, -factor, term))
        term, doc, factor = term[order], doc[order], factor[order]
        starts = np.flatnonzero(np.diff(term, prepend=-1))
        cuts = list(zip(starts.tolist(), [*starts[1:].tolist(), len(term)]))
        ids = table.column("doc_id").drop_null().to_numpy().astype("<i8")
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(cuts) + 1, number), pa.int64()), pa.array([-1, *term[starts].tolist()], pa.int32()),
                pa.array([ids.tobytes(), *(doc[a:b].tobytes() for a, b in cuts)], pa.binary()),
                pa.array([b"", *(factor[a:b].tobytes() for a, b in cuts)], pa.binary()),
            ],
            ["shard", "term", "docs", "factors"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, held = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, shard_docs - held)
                batch = batch.slice(part.num_rows)
                parts.append(part)
                held += part.num_rows
                if held == shard_docs:
                    yield shard(number, parts)
                    number, parts, held = number + 1, [], 0
        if held:
            yield shard(number, parts)

    return rows.mapInArrow(run, _LISTS)


def nra(found: list[tuple[np.ndarray, np.ndarray]], documents: int, k: int, first_read: int = FIRST_READ) -> tuple[np.ndarray, np.ndarray]:
    """The best ``k`` documents with a score above 0 and their scores, by falling score, then number.

    ``found`` has per list its documents and their impacts, falling.  All lists are read to one depth.
    """
    low = np.zeros(documents, dtype=np.int64)
    seen = np.zeros((len(found), documents), dtype=bool)
    depth, step = 0, first_read
    while True:
        for t, (docs, impacts) in enumerate(found):
            read = docs[depth : depth + step]
            low[read] += impacts[depth : depth + step]
            seen[t, read] = True
        depth, step = depth + step, 2 * step
        last = np.array([impacts[depth - 1] if depth < len(impacts) else 0 for _, impacts in found], dtype=np.int64)
        open_ = int(last.sum())
        least = max(int(np.partition(low, documents - k)[documents - k]), 1) if documents > k else 1
        # documents whose upper end reaches the best k, the members among them
        near = np.flatnonzero(low + open_ >= least)
        near = near[np.lexsort((near, -low[near]))]
        if open_ == 0:
            break
        high = low[near] + open_ - (seen[:, near] * last[:, None]).sum(axis=0)
        settled = high == low[near]
        if settled[:k].all() and (settled[k:] | (high[k:] < least)).all():
            break
    best = near[:k]
    best = best[low[best] > 0]
    return best, low[best]


def search(index: DataFrame, items: Items, corpus: Corpus, k: int = BEST) -> DataFrame:
    """item_id, rank, doc_id and score of the best ``k`` documents of each item."""
    context = index.sparkSession.sparkContext
    asked, weights = context.broadcast(items.terms), context.broadcast(corpus.weights)

    def run(part: pa.Table) -> pa.Table:
        term = part.column("term").to_pylist()
        docs, factors = (part.column(c).to_pylist() for c in ("docs", "factors"))
        at = {t: i for i, t in enumerate(term)}
        ids = np.frombuffer(docs[at[-1]], dtype="<i8")
        read = {t: (np.frombuffer(docs[i], dtype="<i4"), np.frombuffer(factors[i], dtype="<i4").astype(np.int64)) for t, i in at.items() if t >= 0}
        # documents without an id have the last numbers
        count = 1 + max([len(ids) - 1, *(int(d.max()) for d, _ in read.values())])
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for number, wanted in enumerate(asked.value):
            found = [(read[t][0], read[t][1] * weights.value[t]) for t in wanted.tolist() if t in read]
            if found:
                best, score = nra(found, count, k)
                out.append((np.full(len(best), number), best, score))
        item, best, score = (np.concatenate([o[c] for o in out]) if out else np.zeros(0, np.int64) for c in range(3))
        known = best < len(ids)
        doc_id = pa.array(ids[np.where(known, best, 0)] if len(ids) else np.zeros(len(best), np.int64), pa.int64(), mask=~known)
        return pa.Table.from_arrays([pa.array(item, pa.int32()), doc_id, pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    hits = index.groupBy("shard").applyInArrow(run, _HITS)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = index.sparkSession.createDataFrame(list(enumerate(items.ids)), "item int, item_id bigint")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # bounded by the block


def ranked(docs: DataFrame, items: DataFrame, k: int = BEST, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """The best ``k`` documents of each item: item_id, rank (from 1), doc_id, score."""
    parts = []
    for block in item_blocks(items):
        rows = materialise(forward(docs, block.vocabulary), "forward")
        corpus = statistics(rows, len(block.vocabulary))
        index = materialise(lists(rows, corpus, shard_docs), "lists")
        parts.append(search(index, block, corpus, k))
    return functools.reduce(DataFrame.unionByName, parts)


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SQL = f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS words FROM documents WHERE text IS NOT NULL),
corpus AS (SELECT count(*) AS n_docs, sum(len(words))::BIGINT AS n_terms FROM docs WHERE len(words) > 0),
items AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark)),
counted AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(words) AS term FROM docs) WHERE term IN (SELECT term FROM items) GROUP BY r, term),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM counted GROUP BY term), corpus),
lengths AS (SELECT r, doc_id, 100 - 50 + (50 * len(words)::BIGINT * n_docs) // n_terms AS m FROM docs, corpus WHERE len(words) > 0),
scores AS (
  SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM items JOIN weights USING (term) JOIN counted USING (term) JOIN lengths USING (r) GROUP BY item_id, r, doc_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scores WHERE score > 0)
SELECT item_id, place::INTEGER AS rank, doc_id, score FROM placed WHERE place <= {BEST}"""
