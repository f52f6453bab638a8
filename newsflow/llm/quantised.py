"""Near-duplicate vectors by product quantisation, found and counted exactly.

Unit vectors are put into coarse inverted lists, and the residual to the list's centre is coded in
subspaces.  A vector probes every list that can hold one within reach: two vectors with cosine of
at least t are at most d = sqrt(2 - 2t) apart, so a partner's list is one whose centre is within d plus the
list's radius, and whose half-space (the points nearer to its centre than to the query's own) is within d.  Inner products with the vectors of a
list are looked up from tables of the query's subspaces and the codes; as each vector's coding error
is stored, a lookup plus that error is an upper bound, and no true link is lost.  What passes
is reranked by the exact cosine in double precision.  Centres and codes are fitted on a bounded sample;
every vector is indexed.

Equal vectors with equal labels are one node with a count.  Lists are cut into blocks of bounded
size on both sides, so a hot label or list spreads over tasks; a cell of two blocks returns counts and
the edges of a forest, never its pairs.

Defined results: vectors that are null, empty, zero, hold null or non-finite components, or have a null
label link with nothing; vectors of unlike length do not link; equal rows link with each other, each a
vector of its own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsflow.llm.components import components
from newsflow.session import is_small, materialise

THRESHOLD = 0.98
#: Vectors that centres and codes are fitted on, at most.
SAMPLE = 16_384
SUBSPACES, CODES = 8, 256
#: Vectors per coarse list aimed at, and bounds on the number of lists.
LIST_SIZE, LISTS_MIN, LISTS_MAX = 1024, 8, 1024
#: Vectors of a list and queries of a list that one task compares.
BLOCK = 1536
_SLACK = 1e-6
_OTHER = -1  # list of the vectors whose length is not the index's


@dataclass(frozen=True)
class Index:
    """Coarse centres (lists x dim) and, per subspace, residual codes (codes x width)."""

    centres: np.ndarray
    cuts: list[tuple[int, int]]
    codes: list[np.ndarray]

    @property
    def dim(self) -> int:
        return self.centres.shape[1]


def units(values: pa.Array) -> np.ndarray:
    """Unit vectors in double precision from lists of one length."""
    flat = np.asarray(values.flatten(), dtype=np.float64)
    rows = flat.reshape(len(values), -1) if len(values) else flat.reshape(0, 0)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    squared = (centres * centres).sum(axis=1) - 2 * points @ centres.T
    best = squared.argmin(axis=1)
    return best, np.sqrt(np.maximum(0, ((points - centres[best]) ** 2).sum(axis=1)))


def _means(points: np.ndarray, k: int, steps: int = 8, seed: int = 7) -> np.ndarray:
    """Centres by Lloyd's steps from a seeded choice of points."""
    chosen = np.random.default_rng(seed).permutation(len(points))[:k]
    centres = points[np.sort(chosen)].copy()
    for _ in range(steps):
        best, _ = _nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, best, points)
        count = np.bincount(best, minlength=len(centres))
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    return centres


def fit(sample: np.ndarray, lists: int) -> Index:
    """Coarse centres and residual codes of a sample of unit vectors (in a fixed order)."""
    centres = _means(sample, lists)
    best, _ = _nearest(sample, centres)
    residual = sample - centres[best]
    bounds = np.linspace(0, sample.shape[1], min(SUBSPACES, sample.shape[1]) + 1).astype(int).tolist()
    cuts = list(zip(bounds, bounds[1:]))
    return Index(centres, cuts, [_means(residual[:, a:b], CODES) for a, b in cuts])


def nodes(vectors: DataFrame) -> DataFrame:
    """Every vector with its node: null if it links with nothing."""
    comparable = (
        F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("embedding", lambda x: x != 0)
    )
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.withColumn("node", F.when(F.coalesce(comparable, F.lit(False)), F.xxhash64("label", "embedding")))


def coded(distinct: DataFrame, index: Index | None) -> DataFrame:
    """List, codes, coding error and distance to the list's centre of each distinct vector."""
    shared = distinct.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            lengths = np.asarray(batch.column("dim"))
            n = batch.num_rows
            place, error, radius = np.full(n, _OTHER, dtype=np.int32), np.zeros(n), np.zeros(n)
            code = np.zeros((n, len(index.cuts)), dtype=np.uint8)
            own = np.flatnonzero(lengths == index.dim)
            if len(own):
                points = units(batch.column("embedding").take(pa.array(own)))
                place[own], radius[own] = _nearest(points, index.centres)
                residual = points - index.centres[place[own]]
                squared = np.zeros(len(own))
                for m, (a, b) in enumerate(index.cuts):
                    best, off = _nearest(residual[:, a:b], index.codes[m])
                    code[own, m] = best
                    squared += off * off
                error[own] = np.sqrt(squared)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("node", "label", "dim", "copies", "embedding")), pa.array(place), pa.array(error),
                 pa.array(radius), pa.array([c.tobytes() for c in code], pa.binary())],
                ["node", "label", "dim", "copies", "embedding", "list", "error", "radius", "codes"],
            )

    kinds = "node bigint, label {0}, dim int, copies bigint, embedding array<double>, list int, error double, radius double, codes binary"
    return distinct.mapInArrow(run, kinds.format(distinct.schema["label"].dataType.simpleString()))


def probes(stored: DataFrame, index: Index, radii: np.ndarray, reach: float) -> DataFrame:
    """The lists that can hold a partner, for each vector."""
    shared = stored.sparkSession.sparkContext.broadcast((index, radii))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, radii = shared.value
        lengths = (index.centres**2).sum(axis=1)
        between = np.sqrt(np.maximum(0, lengths[:, None] + lengths - 2 * index.centres @ index.centres.T))
        for batch in batches:
            own = np.asarray(batch.column("dim")) == index.dim
            lists: list[list[int]] = [[_OTHER]] * batch.num_rows
            rows = np.flatnonzero(own)
            if len(rows):
                points = units(batch.column("embedding").take(pa.array(rows)))
                squared = np.maximum(0, 1 + lengths - 2 * points @ index.centres.T)
                near = np.sqrt(squared) <= reach + radii + _SLACK
                for own_list in np.argsort(squared, axis=1)[:, :3].T:
                    beyond = (squared - squared[np.arange(len(rows)), own_list, None]) / 2
                    near &= beyond <= (reach + _SLACK) * between[own_list] + _SLACK
                for row, hits in zip(rows.tolist(), near):
                    lists[row] = np.flatnonzero(hits).tolist()
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("node", "label", "dim", "embedding")), pa.array(lists, pa.list_(pa.int32()))],
                ["node", "label", "dim", "embedding", "lists"],
            )

    kinds = f"node bigint, label {stored.schema['label'].dataType.simpleString()}, dim int, embedding array<double>, lists array<int>"
    return stored.select("node", "label", "dim", "embedding").mapInArrow(run, kinds)


def _bound(index: Index, centre: int, queries: np.ndarray, codes: np.ndarray, error: np.ndarray) -> np.ndarray:
    """Upper bounds of the inner products, by table lookup."""
    total = (queries @ index.centres[centre])[:, None] + error[None, :]
    for m, (a, b) in enumerate(index.cuts):
        total += (queries[:, a:b] @ index.codes[m].T)[:, codes[:, m]]
    return total


def compare_cell(cell: pa.Table, index: Index, threshold: float) -> pa.Table:
    """Links of a cell's queries with its stored vectors: counts per query, and edges that keep its components."""
    stored = cell.filter(cell["codes"].is_valid())
    asked = cell.filter(cell["codes"].is_null())
    v_node, q_node = (np.asarray(t["node"], dtype=np.int64) for t in (stored, asked))
    empty = pa.table({"node": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "other": pa.array([], pa.int64())})
    if not len(v_node) or not len(q_node):
        return empty
    copies, error = np.asarray(stored["copies"], dtype=np.int64), np.asarray(stored["error"])
    vectors, queries = units(stored["embedding"].combine_chunks()), units(asked["embedding"].combine_chunks())
    place = stored["list"][0].as_py()
    codes = np.array([np.frombuffer(c.as_py(), dtype=np.uint8) for c in stored["codes"]])
    links = np.zeros((len(q_node), len(v_node)), dtype=bool)
    for low in range(0, len(q_node), 256):
        part = slice(low, low + 256)
        same = q_node[part, None] == v_node[None, :]
        if place == _OTHER:
            likely = ~same
        else:
            likely = (_bound(index, place, queries[part], codes, error) >= threshold - _SLACK) & ~same
        rows, columns = np.flatnonzero(likely.any(axis=1)), np.flatnonzero(likely.any(axis=0))
        if len(rows):
            exact = queries[part][rows] @ vectors[columns].T
            links[low + rows[:, None], columns[None, :]] = (exact >= threshold) & likely[rows[:, None], columns[None, :]]
    counts = links @ copies
    # the smallest node of each component of the cell, found by passing minima between the two sides
    rows, columns = np.flatnonzero(links.any(axis=1)), np.flatnonzero(links.any(axis=0))
    if not len(rows):
        return empty
    dense = links[rows[:, None], columns[None, :]]
    top = np.iinfo(np.int64).max
    q_low, v_low = q_node[rows], v_node[columns]
    while True:
        new_q = np.minimum(q_low, np.where(dense, v_low[None, :], top).min(axis=1))
        new_v = np.minimum(v_low, np.where(dense, new_q[:, None], top).min(axis=0))
        if (new_q == q_low).all() and (new_v == v_low).all():
            break
        q_low, v_low = new_q, new_v
    node = np.concatenate([q_node[rows], v_node[columns]])
    return pa.table(
        {"node": pa.array(node), "n": pa.array(np.concatenate([counts[rows], np.zeros(len(columns), np.int64)])),
         "other": pa.array(np.concatenate([q_low, v_low]))}
    )


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every row."""
    spark = vectors.sparkSession
    rows = materialise(nodes(vectors), "vectors")
    named = rows.where("node is not null")
    distinct = materialise(
        named.groupBy("node").agg(
            F.any_value("label").alias("label"), F.any_value("embedding").alias("embedding"), F.min("vec_id").alias("first"), F.count("*").alias("copies")
        ).withColumn("dim", F.size("embedding")),
        "distinct",
    )
    count = distinct.count()
    kept = F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")
    if not count:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    dim = distinct.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()["dim"]
    share = F.pmod(F.xxhash64("node"), F.lit(1 << 20)) < int(min(1.0, SAMPLE / count) * (1 << 20))
    chosen = distinct.where(F.col("dim") == dim).where(share).select("node", "embedding").limit(SAMPLE).toArrow().sort_by("node")
    if not chosen.num_rows:
        chosen = distinct.where(F.col("dim") == dim).select("node", "embedding").limit(1).toArrow()
    index = fit(units(chosen["embedding"].combine_chunks()), min(LISTS_MAX, max(LISTS_MIN, count // LIST_SIZE)))
    stored = materialise(coded(distinct.select("node", "label", "dim", "copies", "embedding"), index), "coded")
    radii = np.zeros(len(index.centres))
    for row in stored.where(F.col("list") != _OTHER).groupBy("list").agg(F.max("radius").alias("r")).collect():  # a row per list
        radii[row["list"]] = row["r"]
    asked = probes(stored, index, radii, float(np.sqrt(2 - 2 * threshold))).withColumn("list", F.explode("lists")).drop("lists")
    asked = materialise(asked, "asked")

    cell = ["label", "dim", "list"]
    blocks = lambda df, name: df.groupBy(*cell).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    cells = materialise(blocks(stored, "v_blocks").join(blocks(asked, "q_blocks"), cell), "cells")
    cells = F.broadcast(cells) if is_small(cells) else cells
    left = stored.join(cells, cell).withColumn("v_block", F.pmod("node", "v_blocks")).withColumn(
        "q_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("q_blocks") - F.lit(1).cast("bigint")))
    )
    right = asked.join(cells, cell).withColumn("q_block", F.pmod("node", "q_blocks")).withColumn(
        "v_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("v_blocks") - F.lit(1).cast("bigint")))
    )
    columns = [*cell, "v_block", "q_block", "node", "embedding"]
    both = left.select(*columns, "copies", "error", "codes").unionByName(right.select(*columns), allowMissingColumns=True)
    shared = spark.sparkContext.broadcast(index)
    found = both.groupBy(*cell, "v_block", "q_block").applyInArrow(
        lambda table: compare_cell(table, shared.value, threshold), "node bigint, n bigint, other bigint"
    )
    found = materialise(found, "found")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    labels = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    firsts = distinct.select("node", "first", "copies").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = firsts.groupBy("component").agg(F.min("first").alias("component_id"))
    summary = materialise(
        firsts.join(heads, "component").join(counts, "node", "left").select(
            "node", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")
        ),
        "summary",
    )
    return rows.select("vec_id", "node").join(summary, "node", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    ).select("vec_id", "n_links", "component_id", kept)
