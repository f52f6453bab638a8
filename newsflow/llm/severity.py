"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

Features are the lower-case words of a text and the first four and five letters of each, hashed.  A model has
one weight per chosen feature, shared by all thresholds, and ordered thresholds: P(grade > k) is the
logistic function of score - threshold k.  The score adds up weight times 1 + log(count) for each feature that occurs.  Results are
the probabilities of the grades and the expected severity, their mean grade.

Labels say toxic or not.  Grades of the training texts are made from them: 0 if not toxic, else
1 to 3 by how often indicative features occur, cut at the thirds of the toxic training texts.
A feature is indicative if it is at least ``LIFT`` times as frequent in toxic texts.  The model is fitted
on at most ``SAMPLE`` labelled rows, those of the smallest hashes, and scores every text.

Defined results: a null or empty text has no features and gets the base rates; equal rows get equal
results; labels that are null or lack a text are not used, repeated labels of a text count each;
without labels of both kinds nothing is toxic; an empty table gives no rows; further columns are ignored by
``scored`` and kept as they are by ``accepted``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsflow.llm import arrow
from newsflow.session import materialise

SAMPLE = 8_000
GRADES = 4
BITS = 22
#: Features chosen at most; each is in at least this share of the toxic training texts (and in
#: ``LEAST_TEXTS``), and at least ``LIFT`` times as frequent in them as in others.
FEATURES, LEAST_SHARE, LEAST_TEXTS, LIFT = 1_000, 0.01, 4, 8.0
#: A text is toxic if a grade over 0 is at least this likely.
TOXIC = 0.5

_OUTSIDE = re.compile(r"^[\W_]+|[\W_]+$")


@dataclass(frozen=True)
class Model:
    """Sorted feature numbers, their weights, and the ordered thresholds."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray


def features(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature number and count of all (text, feature) pairs, sorted; and the words of each row."""
    number, words, offsets = arrow.ascii_words(pa.compute.utf8_lower(values))
    rows = np.repeat(np.arange(len(values)), np.diff(offsets))
    bare = [_OUTSIDE.sub("", w) for w in words]
    kinds = []
    for prefix, least in (("w", 2), (4, 5), (5, 6)):
        names = [("" if len(w) < least else f"w{w}" if prefix == "w" else f"{prefix}{w[:prefix]}") for w in bare]
        code = (pd.util.hash_array(np.array(names, dtype=object), categorize=False) >> np.uint64(64 - BITS)).astype(np.int64) if names else np.zeros(0, np.int64)
        code[[n == "" for n in names]] = -1
        kinds.append(code[number])
    code = np.concatenate(kinds)
    key = np.tile(rows, len(kinds)) << BITS | code
    key, count = np.unique(key[code >= 0], return_counts=True)
    return key, count, np.diff(offsets)


def sketches(key: np.ndarray, rows: int) -> np.ndarray:
    """The three smallest hashed features of each row; near copies agree in them."""
    mixed = (key & ((1 << BITS) - 1)) * 0x9E3779B1 % (1 << 32)
    order = np.lexsort((mixed, key >> BITS))
    mixed, row = mixed[order], (key >> BITS)[order]
    starts = np.searchsorted(row, np.arange(rows))
    sketch = np.full((rows, 3), -1, dtype=np.int64)
    for k in range(3):
        there = starts + k < np.searchsorted(row, np.arange(rows), side="right")
        sketch[there, k] = mixed[starts[there] + k]
    return sketch


def one_of_copies(key: np.ndarray, rows: int) -> np.ndarray:
    """Marks one row of each group of near copies."""
    kept = np.zeros(rows, dtype=bool)
    kept[np.unique(sketches(key, rows), axis=0, return_index=True)[1]] = True
    return kept


def _thirds(hits: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Grades 1 to 3 of toxic rows by hits, 0 for others."""
    cuts = np.quantile(hits[toxic], np.arange(1, GRADES - 1) / (GRADES - 1)) if toxic.any() else []
    return np.where(toxic, 1 + np.searchsorted(cuts, hits, side="left"), 0)


def _least(n_bad: int) -> float:
    return max(LEAST_TEXTS, LEAST_SHARE * n_bad)


def indicative(bad: np.ndarray, good: np.ndarray, n_bad: int, n_good: int) -> np.ndarray:
    """Features that occur in enough toxic texts and much more often in them than in others."""
    lift = np.log((bad + 0.5) / (n_bad + 1)) - np.log((good + 0.5) / (n_good + 1))
    return (lift >= np.log(LIFT)) & (bad >= _least(n_bad))


def fit(key: np.ndarray, count: np.ndarray, words: np.ndarray, toxic: np.ndarray, steps: int = 400) -> Model | None:
    """A model from labelled texts at hand; None without both kinds of label.  ``train`` is the same for tables."""
    kept = one_of_copies(key, len(words))
    row, code = key >> BITS, key & ((1 << BITS) - 1)
    use = kept[row]
    row, code, count = (np.cumsum(kept) - 1)[row[use]], code[use], count[use]
    toxic = toxic[kept]
    ids, at = np.unique(code, return_inverse=True)
    bad = np.bincount(at, weights=toxic[row], minlength=len(ids))
    good = np.bincount(at, minlength=len(ids)) - bad
    telling = indicative(bad, good, toxic.sum(), (~toxic).sum())
    used = telling[at]
    return optimised(row[used], code[used], count[used], ids[telling], bad[telling], toxic, steps)


def optimised(row: np.ndarray, code: np.ndarray, count: np.ndarray, telling: np.ndarray, bad: np.ndarray, toxic: np.ndarray, steps: int = 400) -> Model | None:
    """The model from the indicative features (sorted, with the toxic texts that hold them) of each training row."""
    if not toxic.any() or toxic.all():
        return None
    features = np.sort(telling[np.argsort(-bad, kind="stable")[:FEATURES]])
    hits = np.bincount(row, weights=count, minlength=len(toxic))
    grade = _thirds(hits, toxic)
    used = np.isin(code, features)
    r, c, x = row[used].astype(np.int32), np.searchsorted(features, code[used]).astype(np.int32), 1 + np.log(count[used])
    weight, gaps = np.zeros(len(features)), np.zeros(GRADES - 1)
    share = np.array([(grade > k).mean() for k in range(GRADES - 1)]).clip(1e-4, 1 - 1e-4)
    start = -np.log(share / (1 - share))
    gaps[0], gaps[1:] = start[0], np.log(np.maximum(np.diff(start), 1e-2))
    params, first, second = np.concatenate([weight, gaps]), 0.0, 0.0
    for step in range(1, steps + 1):  # Adam
        gradient = loss_and_gradient(params, r, c, x, grade)[1]
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        params = params - 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        params[: len(features)] = np.maximum(params[: len(features)], 0)  # features speak for severity only
    weight, gaps = params[: len(features)], params[len(features) :]
    return Model(features, weight, np.cumsum(np.concatenate([gaps[:1], np.exp(gaps[1:])])))


def loss_and_gradient(params: np.ndarray, r: np.ndarray, c: np.ndarray, x: np.ndarray, grade: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean negative log likelihood of the grades, with a ridge on the weights.

    ``params`` are the weights, the first threshold and the logarithms of the gaps to the others; ``r``, ``c`` and ``x``
    the rows, features and values of the training texts.
    """
    weight, gaps = params[: len(params) - GRADES + 1], params[len(params) - GRADES + 1 :]
    rows = len(grade)
    theta = np.cumsum(np.concatenate([gaps[:1], np.exp(gaps[1:])]))
    score = np.bincount(r, weights=x * weight[c], minlength=rows)
    p = 1 / (1 + np.exp(-np.clip(score[:, None] - theta, -40, 40)))
    edges = np.concatenate([np.ones((rows, 1)), p, np.zeros((rows, 1))], axis=1)
    mass = np.maximum(np.take_along_axis(edges, grade[:, None], 1) - np.take_along_axis(edges, grade[:, None] + 1, 1), 1e-12)
    slope = p * (1 - p) / mass
    # derivative of log mass in (score - theta_k)
    d = np.where(np.arange(GRADES - 1) == grade[:, None] - 1, slope, 0) - np.where(np.arange(GRADES - 1) == grade[:, None], slope, 0)
    g_weight = -np.bincount(c, weights=x * d.sum(axis=1)[r], minlength=len(weight)) / rows + 1e-5 * weight
    tail = np.cumsum(d.mean(axis=0)[::-1])[::-1]
    gradient = np.concatenate([g_weight, tail[:1], tail[1:] * np.exp(gaps[1:])])
    return float(-np.log(mass).mean() + 0.5e-5 * (weight**2).sum()), gradient


def scores(model: Model, key: np.ndarray, count: np.ndarray, rows: int) -> np.ndarray:
    """P(grade > k) of each row."""
    code = key & ((1 << BITS) - 1)
    at = np.searchsorted(model.features, code).clip(max=max(0, len(model.features) - 1))
    known = model.features[at] == code if len(model.features) else np.zeros(len(code), bool)
    value = (1 + np.log(count[known])) * model.weights[at[known]]
    score = np.bincount((key >> BITS)[known], weights=value, minlength=rows)
    return 1 / (1 + np.exp(-np.clip(score[:, None] - model.thresholds, -40, 40)))


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on at most ``SAMPLE`` labelled rows.

    Features are counted in the tasks, per label.  The driver gets the counts of those in enough toxic texts, and then
    the indicative features of each training text only.
    """
    known = labels.where("doc_id is not null and toxic is not null").select("doc_id", (F.col("toxic") > 0).alias("_toxic"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    share = min(1.0, SAMPLE / max(1, known.count()))
    ids = known.where(place <= int(share * (1 << 20))).orderBy(place, "doc_id", "_toxic").limit(SAMPLE)  # bounded, so it is broadcast
    texts = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow.slices(batches):
            key, count, words = features(arrow.texts(batch))
            cuts = pa.array(np.searchsorted(key >> BITS, np.arange(batch.num_rows + 1)), pa.int32())
            of_row = lambda flat: pa.ListArray.from_arrays(cuts, pa.array(flat, pa.int32()))
            three = pa.array(sketches(key, batch.num_rows).tolist(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [three, batch.column("doc_id"), pa.array(words, pa.int64()), batch.column("_toxic"), of_row(key & ((1 << BITS) - 1)), of_row(count)],
                ["sketch", "doc_id", "words", "toxic", "codes", "counts"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    kind = f"sketch array<bigint>, doc_id {id_type}, words bigint, toxic boolean, codes array<int>, counts array<int>"
    rows = materialise(texts.select("doc_id", "_toxic", "text").mapInArrow(counted, kind), "labelled")
    kept = rows.groupBy("sketch").agg(F.min(F.struct("doc_id", "words", "toxic", "codes", "counts")).alias("r"))
    kept = materialise(kept.select("r.*"), "training")
    sizes = kept.agg(F.count_if("toxic").alias("bad"), F.count_if(~F.col("toxic")).alias("good")).first()
    if not sizes["bad"] or not sizes["good"]:
        return None
    per_code = kept.select("toxic", F.explode("codes").alias("code")).groupBy("code").agg(F.count_if("toxic").alias("bad"), F.count_if(~F.col("toxic")).alias("good"))
    # at most a hundred times the features of a text
    counts = per_code.where(F.col("bad") >= _least(sizes["bad"])).orderBy("code").toArrow()
    code, bad, good = (np.asarray(counts[c]) for c in ("code", "bad", "good"))
    telling = indicative(bad, good, sizes["bad"], sizes["good"])
    code, bad = code[telling], bad[telling]
    shared = docs.sparkSession.sparkContext.broadcast(code)

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = np.asarray(batch.column("codes").offsets, dtype=np.int64)
            held, count = (np.asarray(batch.column(c).flatten()) for c in ("codes", "counts"))
            use = np.isin(held, shared.value)
            cuts = pa.array(np.concatenate([[0], np.cumsum(use)])[cuts - cuts[0]], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("toxic"), *(pa.ListArray.from_arrays(cuts, pa.array(v[use], pa.int32())) for v in (held, count))],
                ["doc_id", "toxic", "codes", "counts"],
            )

    columns = kept.select("doc_id", "toxic", "codes", "counts")
    sample = columns.mapInArrow(narrowed, f"doc_id {id_type}, toxic boolean, codes array<int>, counts array<int>").toArrow().combine_chunks()
    sample = sample.sort_by([("doc_id", "ascending")]).combine_chunks()
    lengths = np.asarray(pa.compute.list_value_length(sample["codes"]), dtype=np.int64)
    held, count = (np.asarray(sample[c].combine_chunks().flatten()) for c in ("codes", "counts"))
    toxic = np.asarray(sample["toxic"].combine_chunks().to_numpy(zero_copy_only=False)).astype(bool)
    return optimised(np.repeat(np.arange(len(toxic)), lengths), held, count, code, bad, toxic)


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id``, ``p1`` to ``p3`` (grade at least 1 to 3), ``severity`` (the expected grade) and ``toxic``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    results = [*(f"p{k}" for k in range(1, GRADES)), "severity", "toxic"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow.slices(batches):
            p = _probabilities(batch, shared.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(p[:, k]) for k in range(GRADES - 1)), pa.array(p.sum(axis=1)), pa.array(p[:, 0] >= TOXIC)],
                ["doc_id", *results],
            )

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = ", ".join([f"doc_id {docs.schema['doc_id'].dataType.simpleString()}", *(f"{c} double" for c in results[:-1]), "toxic boolean"])
    return rows.mapInArrow(run, kind)


def _probabilities(batch: pa.RecordBatch, model: Model | None) -> np.ndarray:
    if model is None:
        return np.zeros((batch.num_rows, GRADES - 1))
    key, count, _ = features(arrow.texts(batch))
    return scores(model, key, count, batch.num_rows)


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` that are not toxic, unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow.slices(batches):
            yield batch.filter(pa.array(_probabilities(batch, shared.value)[:, 0] < TOXIC))

    return docs.mapInArrow(run, docs.schema)
