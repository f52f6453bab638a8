"""Exact Jaccard self-join of shingle sets by PartEnum signatures, and its components.

A document's set holds the 64-bit hashes of its distinct five-word shingles.  Two sets of sizes s and t
with Jaccard similarity of at least 3/4 differ in at most min(s, t) / 3 elements.  Sets are put into bands
of size.  For a band, the hash domain is partitioned into parts, each with two halves, and the subsets
of one half per part are enumerated: a half and what the set holds of it is one signature.  Each
differing element spoils one half at most.  So of the halves that are not empty, ordered by any
order that both sets share, the first s / 3 + 1 of each set contain a common signature as long as the set
has more than s / 3 of them.  The order is rarest first, by counts over all documents in a sketch of
fixed size; what many documents share (a passage, a licence) comes last and is seldom emitted.  Sets of
under 128 elements, and bands in which some set has too few halves, are partitioned into single
elements, where the condition always holds; similar sets share 3/4 of the elements of either, so the first s / 4 + 1
contain a common one.  A set near a band's upper end also signs for the next.

The sets of a signature belong to the group of its pivot, the one that a hash puts first; signatures with the same pivot
are one group, which holds a set once.  A task compares the sets of a cell, which has bounded size, and returns
a forest of the similar pairs.  A group that fits is one cell.  A larger one is first dealt out over several cells, each
with the pivot, which joins most near copies in time linear in the group; then every set outside the largest component of the
group meets every set of the group, in cells of a block of either.  A cell is first compared by the parities of hashed
buckets: each differing element flips one, so where more differ than in similar sets, the pair is out.  Only sets left with a
pair are compared exactly, by their texts.

Equal sets are one node.  Nodes and shingles are told apart by 64-bit hashes; two different ones agree
with a chance of 2**-64 per pair.

Defined results: no words (null, empty, white space): n_shingles 0, no links, own id; fewer than
five words: one shingle; equal rows share a component; a null doc_id never becomes a component id
while an id is there, else it is null; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import Window
from pyspark.sql import functions as F

from newsflow.llm import arrow
from newsflow.llm.arrow import mix
from newsflow.llm.components import components
from newsflow.llm.names import unused
from newsflow.session import is_small, materialise, shuffled

WORDS = 5
#: Similarity of at least NUMERATOR / DENOMINATOR.
NUMERATOR, DENOMINATOR = 3, 4
#: Sets from this size on are partitioned into halves that hold ELEMENTS_PER_HALF elements at most on average.
FIRST_BAND = 128
ELEMENTS_PER_HALF = 1.0
#: Cells and blocks of the sketch of signature counts.
CELLS, BLOCKS = 1 << 21, 64
#: A signature counted more often is dealt over several cells of this many sets.
HOT_SETS = 4096
#: Times that a group beyond a cell is dealt out with a pivot before its components are compared in blocks.
PIVOT_ROUNDS = 1
#: Text bytes signed at a time.
SLICE_BYTES = 2 << 20
#: Fewest buckets of the parities by which dissimilar pairs are told apart; larger sets have four times their size or more.
BUCKETS = 2048
#: Sets of a block, and their elements, about; a cell has two blocks at most.
BLOCK, BLOCK_ELEMENTS = 256, 1 << 18
#: Rows and elements of the cells that a call compares, about; pairs and bytes of parities at a time.
CELL_ROWS, CELL_ELEMENTS, PAIRS, COMPARED_BYTES = 512, 1 << 18, 1 << 14, 4 << 20
#: Documents whose keys may be broadcast.
BROADCAST_ROWS = 500_000

_U = np.uint64

CELL_COLUMNS = ["pivot", "i", "j", "side", "node", "comp", "n"]


def shingle_sets(values: pa.Array, width: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, offsets = arrow.split_words(pa.compute.ascii_lower(values))
    flat, filled = arrow.hashed(words), np.asarray(pa.compute.binary_length(words)) > 0
    if not filled.all():
        flat, offsets = flat[filled], np.concatenate([[0], np.cumsum(filled)])[offsets]
    factor = _U(0x9E3779B97F4A7C15)
    rolled = np.zeros(max(0, len(flat) - width + 1), dtype=_U)
    for k in range(width):
        rolled = rolled * factor + flat[k : k + len(rolled)]
    rolled = mix(rolled)
    sets = []
    for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if high - low >= width:
            found = np.sort(rolled[low : high - width + 1])
            sets.append(found[np.concatenate([[True], found[1:] != found[:-1]])])
        elif high > low:
            short = np.full(1, high - low, dtype=_U)
            for value in flat[low:high]:
                short = short * factor + value
            sets.append(mix(short + factor))
        else:
            sets.append(np.zeros(0, dtype=_U))
    return sets


def node_of(elements: np.ndarray) -> int:
    """One number for a set."""
    if not len(elements):
        return 0
    total = mix(elements + _U(len(elements))).sum(keepdims=True)
    return int(mix(total + _U(len(elements))).view(np.int64)[0])


def band_of(size: int) -> int:
    return 0 if size < FIRST_BAND else size.bit_length() - 1


def band_start(band: int) -> int:
    return FIRST_BAND if band <= band_of(FIRST_BAND) else 1 << band


def bands_of(size: int) -> list[int]:
    """The bands a set signs for: its own, and the next if a similar set can lie there."""
    own = band_of(size)
    following = max(own, band_of(FIRST_BAND) - 1) + 1
    return [own, following] if DENOMINATOR * size // NUMERATOR >= band_start(following) else [own]


def tolerance(size: int) -> int:
    """Most elements in which a similar set can differ from one of ``size``."""
    return size * (DENOMINATOR - NUMERATOR) // NUMERATOR


def quota(size: int, single: bool) -> int:
    """Signatures of a set that are enough, in an order shared by all sets."""
    return (size * (DENOMINATOR - NUMERATOR) // DENOMINATOR if single else tolerance(size)) + 1


def signatures(elements: np.ndarray, band: int, single: bool) -> np.ndarray:
    """All signatures of a sorted set in a band; ``single`` partitions into single elements."""
    return signatures_of([elements], [band], frozenset([band]) if single else frozenset())[0]


def signatures_of(sets: list[np.ndarray], bands: list[int], single_bands: frozenset[int]) -> list[np.ndarray]:
    """The signatures of each sorted set in the band beside it."""
    if not sets:
        return []
    flat, lengths = np.concatenate(sets), np.array([len(s) for s in sets], dtype=np.int64)
    salt = np.repeat(mix(np.array(bands, dtype=np.int64) + 1), lengths)
    whole = [band == 0 or band in single_bands for band in bands]
    halves = np.array([0 if one else 2 * int((1 << band) / ELEMENTS_PER_HALF) for one, band in zip(whole, bands)], dtype=_U)
    if all(whole):
        sigs, starts = mix(flat + salt), None
    else:
        part = ((flat >> _U(32)) * np.repeat(halves, lengths)) >> _U(32)
        begins = np.ones(len(flat), dtype=bool)
        begins[1:] = part[1:] != part[:-1]
        begins[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
        begins |= np.repeat(np.array(whole), lengths)
        starts = np.flatnonzero(begins)
        lone = np.repeat(np.array(whole), lengths)[starts]
        # a single element is its own signature
        sums, place = np.add.reduceat(mix(flat), starts), mix(part[starts] + salt[starts])
        sigs = mix(np.where(lone, flat[starts] + salt[starts], sums + place))
    cuts = np.concatenate([[0], np.cumsum(lengths)])
    cuts = (cuts if starts is None else np.searchsorted(starts, cuts)).tolist()
    return [sigs[low:high] for low, high in zip(cuts, cuts[1:])]


def chosen(sigs: np.ndarray, often: np.ndarray, least: int) -> np.ndarray:
    """Places of the ``least`` rarest signatures, and of any that cannot be told from the last of them.

    The order is by count, then by the signature; it depends on these alone, so all sets share it.
    """
    if len(sigs) <= least:
        return np.arange(len(sigs))
    key = (np.minimum(often, (1 << 24) - 1).astype(_U) << _U(40)) | (sigs >> _U(24))
    return np.flatnonzero(key <= np.partition(key, least - 1)[least - 1])


def _jobs(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """(place, band) for each band that a set signs for."""
    return [(k, band) for k, elements in enumerate(sets) if len(elements) for band in bands_of(len(elements))]


def _cell(sigs: np.ndarray) -> np.ndarray:
    return (sigs & _U(CELLS - 1)).astype(np.int64)


def read_sets(docs: DataFrame) -> DataFrame:
    """One stored row per document (``node``, ``n``) and, per task, compressed blocks of signature counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, dtype=np.uint32)
        schema = pa.schema(
            [("doc_id", pa.int64()), ("text_key", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("weak", pa.int32()),
             ("block", pa.int32()), ("task", pa.int32()), ("counts", pa.binary())]
        )
        for batch in arrow.slices(batches, limit=SLICE_BYTES):
            sets = shingle_sets(arrow.texts(batch))
            weak, jobs = [None] * len(sets), _jobs(sets)
            found = signatures_of([sets[k] for k, _ in jobs], [band for _, band in jobs], frozenset())
            for (k, band), sigs in zip(jobs, found):
                if len(sigs) <= tolerance(len(sets[k])):
                    weak[k] = band
            if found:
                np.add.at(counts, _cell(np.concatenate(found)), np.uint32(1))
            rows = len(sets)
            none = pa.nulls(rows, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array([node_of(s) for s in sets], pa.int64()),
                 pa.array([len(s) for s in sets], pa.int32()), pa.array(weak, pa.int32()), none, none, pa.nulls(rows, pa.binary())],
                schema=schema,
            )
        task = TaskContext.get().partitionId()
        for block, part in enumerate(np.split(counts, BLOCKS)):
            if part.any():
                values = [None, None, None, None, None, block, task, zlib.compress(part.astype("<i8").tobytes(), 1)]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)

    kind = "doc_id bigint, text_key bigint, node bigint, n int, weak int, block int, task int, counts binary"
    return materialise(_keyed(docs).mapInArrow(run, kind), "sets")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text")
    )


def sketch(stored: DataFrame) -> np.ndarray:
    """Signature counts of all documents, summed by block: ``CELLS`` numbers whatever the corpus."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(c), dtype="<i8") for c in rows["counts"])
        return pd.DataFrame({"block": rows["block"].iloc[:1], "counts": [zlib.compress(total.tobytes(), 1)]})

    blocks = stored.where("block is not null")
    first = blocks.groupBy("block", F.pmod("task", F.lit(64)).alias("_t")).applyInPandas(add, "block int, counts binary")
    total = np.zeros(CELLS, dtype=np.int64)
    for row in first.groupBy("block").applyInPandas(add, "block int, counts binary").collect():  # BLOCKS rows
        low = row["block"] * (CELLS // BLOCKS)
        total[low : low + CELLS // BLOCKS] = np.frombuffer(zlib.decompress(row["counts"]), dtype="<i8")
    return total


def signed(docs: DataFrame, counts: np.ndarray, single_bands: frozenset[int]) -> DataFrame:
    """The signatures of each set: ``sig``, ``cell`` (more than one for a hot signature), ``hot``, ``node``.

    Copies of a set in one task sign once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(np.minimum(counts, np.iinfo(np.uint32).max).astype(np.uint32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = shared.value, set()
        for batch in arrow.slices(batches, limit=SLICE_BYTES):
            sets, nodes = [], []
            for elements in shingle_sets(arrow.texts(batch)):
                node = node_of(elements)
                if not len(elements) or node in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(node)
                sets.append(elements)
                nodes.append(node)
            jobs, sigs, often, taken = _jobs(sets), [], [], []
            for (k, band), own in zip(jobs, signatures_of([sets[k] for k, _ in jobs], [band for _, band in jobs], single_bands)):
                count = counts[_cell(own)]
                rare = chosen(own, count, quota(len(sets[k]), band == 0 or band in single_bands))
                sigs.append(own[rare])
                often.append(count[rare])
                taken.append(len(rare))
            if sigs:
                node = np.repeat(np.array([nodes[k] for k, _ in jobs], dtype=np.int64), taken)
                spread = 1 + np.concatenate(often) // HOT_SETS
                cell = (node.view(_U) % spread.astype(_U)).astype(np.int32)
                columns = [np.concatenate(sigs).view(np.int64), cell, spread > 1, node]
                del sets, sigs, often
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["sig", "cell", "hot", "node"])

    rows = docs.select(F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "sig bigint, cell int, hot boolean, node bigint")


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets are similar, exactly."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DENOMINATOR * both >= NUMERATOR * (len(a) + len(b) - both)


def parities(elements: np.ndarray) -> bytes:
    """Bits that say whether hashed buckets hold an odd number of elements."""
    buckets = max(BUCKETS, 4 << max(0, len(elements) - 1).bit_length())
    counts = np.bincount((elements & _U(buckets - 1)).astype(np.int64), minlength=buckets)
    return np.packbits((counts & 1).astype(bool)).tobytes()


def halved(bits: bytes) -> bytes:
    """Parities over half as many buckets."""
    return np.bitwise_xor(*np.frombuffer(bits, dtype=np.uint8).reshape(2, -1)).tobytes()


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Rows of parities over fewer buckets, ``size`` bytes each."""
    return np.bitwise_xor.reduce(bits.reshape(len(bits), -1, size), axis=1)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Parities in which rows differ: at most the elements in which the sets do."""
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)).sum(axis=1, dtype=np.int64)


def can_be_similar(apart: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether sets that differ by at least ``apart`` elements can be similar, given the sums of their sizes."""
    return (DENOMINATOR + NUMERATOR) * apart <= (DENOMINATOR - NUMERATOR) * sizes


def likely_forest(group: pa.Table) -> pa.Table:
    """Pairs (``a``, ``b``) between the components of a cell whose parities allow similarity: a forest of them.

    ``side`` says whether a set is of the first block (1), the second (2) or both (3); ``apart`` has the sets that were found
    dissimilar to a set before.  A pair is left out if pairs before it join its components, so a group of near
    copies gives one pair less than its sets.
    """
    _, a, b = likely_forests(group, np.zeros(len(group), dtype=np.int64))
    return pa.table({"a": a, "b": b})


def likely_forests(group: pa.Table, cell: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """The forests of several cells, whose rows stand together: number of the cell and the two sets of each pair."""
    node, apart = np.asarray(group["node"]), [set(told or ()) for told in group["apart"].to_pylist()]
    bits = _Parities([v.as_py() for v in group["buckets"]])
    x, y = forests(
        cell, *(np.asarray(group[c]) for c in ("node", "side", "comp", "n")), bits.apart,
        lambda k, o: int(node[o]) not in apart[k] and int(node[k]) not in apart[o],
    )
    return cell[x], pa.array(np.minimum(node[x], node[y]), pa.int64()), pa.array(np.maximum(node[x], node[y]), pa.int64())


def forests(
    cell: np.ndarray, node: np.ndarray, side: np.ndarray, comp: np.ndarray, size: np.ndarray,
    apart: Callable[[np.ndarray, np.ndarray], np.ndarray], similar: Callable[[int, int], bool],
) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows in the forests of several cells, whose rows stand together.

    ``apart`` bounds from below by how many elements the sets of rows differ; ``similar`` decides on a pair that it allows.
    """
    comp, low, high = comp.copy(), [], []
    begin, end = np.searchsorted(cell, cell), np.searchsorted(cell, cell, side="right")
    for x, y in likely_pairs(cell, node, side, comp, size, apart):
        for k, o in zip(x.tolist(), y.tolist()):
            if comp[k] != comp[o] and similar(k, o):
                low.append(k)
                high.append(o)
                own = comp[begin[k] : end[k]]
                own[own == comp[o]] = comp[k]
    return np.array(low, dtype=np.int64), np.array(high, dtype=np.int64)


def likely_pairs(
    cell: np.ndarray, node: np.ndarray, side: np.ndarray, comp: np.ndarray, size: np.ndarray,
    apart: Callable[[np.ndarray, np.ndarray], np.ndarray],
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows between components of the same cell that ``apart`` and the sizes allow; ``comp`` may change meanwhile."""
    size = size.astype(np.int64)
    # every row with those after it in its cell
    many = np.searchsorted(cell, cell, side="right") - np.arange(len(cell)) - 1
    upto = np.cumsum(many)
    for start in range(0, int(upto[-1]) if len(upto) else 0, PAIRS):
        place = np.arange(start, min(start + PAIRS, int(upto[-1])))
        x = np.searchsorted(upto, place, side="right")
        y = x + 1 + place - (upto[x] - many[x])
        fits = (comp[x] != comp[y]) & (node[x] != node[y]) & (((side[x] & 1) & (side[y] >> 1)) | ((side[x] >> 1) & (side[y] & 1))).astype(bool)
        fits &= DENOMINATOR * np.minimum(size[x], size[y]) >= NUMERATOR * np.maximum(size[x], size[y])
        x, y = x[fits], y[fits]
        likely = can_be_similar(apart(x, y), size[x] + size[y])
        yield x[likely], y[likely]


class _Parities:
    """Parities of sets over different numbers of buckets; pairs of rows are compared over the fewer."""

    def __init__(self, column: list[bytes]):
        rows = [np.frombuffer(v, dtype=np.uint8) for v in column]
        self.width = np.array([len(r) for r in rows], dtype=np.int64)
        self.at, self.bits = np.zeros(len(rows), dtype=np.int64), {}
        for width in np.unique(self.width).tolist():
            own = np.flatnonzero(self.width == width)
            self.at[own] = np.arange(len(own))
            self.bits[width] = np.stack([rows[k] for k in own.tolist()])

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Parities in which the rows differ."""
        found, least = np.zeros(len(x), dtype=np.int64), np.minimum(self.width[x], self.width[y])
        for width in np.unique(least).tolist():
            pairs = np.flatnonzero(least == width)
            for part in np.array_split(pairs, 1 + len(pairs) * width // COMPARED_BYTES):
                found[part] = _apart(self._over(x[part], width), self._over(y[part], width))
        return found

    def _over(self, rows: np.ndarray, width: int) -> np.ndarray:
        bits = np.zeros((len(rows), width), dtype=np.uint8)
        for own in np.unique(self.width[rows]).tolist():
            here = np.flatnonzero(self.width[rows] == own)
            bits[here] = _folded(self.bits[own][self.at[rows[here]]], width)
        return bits


def _in_cells(part: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """The rows in the order of their cells (``pivot``, ``i``, ``j``), and the number of the cell of each."""
    part = part.sort_by([("pivot", "ascending"), ("i", "ascending"), ("j", "ascending"), ("node", "ascending")]).combine_chunks()
    keys = np.stack([np.asarray(part[c]).astype(np.int64) for c in ("pivot", "i", "j")])
    return part, np.concatenate([[0], np.cumsum((keys[:, 1:] != keys[:, :-1]).any(axis=0))])


def likely_rows(part: pa.Table) -> pa.Table:
    """The rows of cells whose ``buckets`` allow that the set is similar to another of its cell."""
    part, cell = _in_cells(part)
    bits, marked = _Parities([v.as_py() for v in part["buckets"]]), np.zeros(len(part), dtype=bool)
    for x, y in likely_pairs(cell, *(np.asarray(part[c]) for c in ("node", "side", "comp", "n")), bits.apart):
        marked[x] = marked[y] = True
    return part.filter(pa.array(marked)).select(CELL_COLUMNS)


def cell_links(part: pa.Table) -> pa.Table:
    """Pairs (``a``, ``b``) of nodes with similar texts: a forest between the components of each cell."""
    part, cell = _in_cells(part)
    node = np.asarray(part["node"])
    _, first, own = np.unique(node, return_index=True, return_inverse=True)
    sets = []
    for batch in arrow.slices(part.select(["text"]).take(pa.array(first)).to_batches(), limit=SLICE_BYTES):
        sets += shingle_sets(arrow.texts(batch))
    bits, known = _Parities([parities(s) for s in sets]), {}

    def similar(k: int, o: int) -> bool:
        pair = (min(own[k], own[o]), max(own[k], own[o]))
        if pair not in known:
            known[pair] = alike(sets[pair[0]], sets[pair[1]])
        return known[pair]

    x, y = forests(cell, *(np.asarray(part[c]) for c in ("node", "side", "comp", "n")), lambda x, y: bits.apart(own[x], own[y]), similar)
    return pa.table({"a": pa.array(node[x], pa.int64()), "b": pa.array(node[y], pa.int64())})


def groups_of(shared: DataFrame, nodes: DataFrame) -> DataFrame:
    """The groups (``pivot``, ``node``, ``n``, ``blocks``) of signatures with two sets or more; a group holds a set once."""
    first = F.min(F.struct(F.xxhash64("node").alias("k"), "node"))
    pivots = shared.groupBy("sig").agg(first.alias("p"), F.max("node").alias("high"), F.min("node").alias("low"))
    pivots = pivots.where("low < high").select("sig", F.col("p.node").alias("pivot"))
    rows = shared.join(shuffled(materialise(pivots, "pivots")), "sig").select("pivot", "node").distinct()
    rows = materialise(rows.join(nodes.select("node", "n"), "node"), "groups")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_ELEMENTS)).cast("int")
    return rows.join(materialise(rows.groupBy("pivot").agg(blocks.alias("blocks")), "blocks"), "pivot")


def _block(blocks: Column, *salt: int) -> Column:
    return F.pmod(F.xxhash64("node", *map(F.lit, salt)), blocks).cast("int")


def dealt(groups: DataFrame, turn: int) -> DataFrame:
    """Cells of blocks, each set in one and the pivot in all: rows linear in the group."""
    own = F.array(_block(F.col("blocks"), turn))
    cells = F.when(F.col("node") == F.col("pivot"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(own)
    return groups.select("pivot", "node", "n", "comp", F.explode(cells).alias("i"), F.lit(0).alias("j"), F.lit(3).alias("side"))


def crossed(groups: DataFrame) -> DataFrame:
    """Cells of a block of the group and one of its sets outside the group's largest component, in which every pair of components meets."""
    sizes = groups.groupBy("pivot", "comp").agg(F.count("*").alias("sets"), F.sum("n").alias("n"))
    outside = F.greatest(
        (F.sum("sets") - F.max("sets")) / BLOCK, (F.sum("n") - F.max_by("n", F.struct("sets", "comp"))) / BLOCK_ELEMENTS
    )
    largest = sizes.groupBy("pivot").agg(F.max_by("comp", F.struct("sets", "comp")).alias("largest"), F.ceil(outside).cast("int").alias("others"))
    rows = groups.join(materialise(largest.where("others > 0"), "largest"), "pivot")
    other = F.col("comp") != F.col("largest")
    first = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda j: F.struct(_block(F.col("blocks")).alias("i"), j.alias("j"), F.lit(1).alias("side")))
    second = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(i.alias("i"), _block(F.col("others"), 1).alias("j"), F.lit(2).alias("side")))
    cells = F.explode(F.when(other, F.concat(first, second)).otherwise(first)).alias("c")
    return rows.select("pivot", "node", "n", "comp", cells).select("pivot", "node", "n", "comp", "c.i", "c.j", "c.side")


def links(cells: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The stored links (a, b) between sets of the cells.  Texts go only to cells where parities leave a pair."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow.slices(batches, limit=SLICE_BYTES):
            buckets = [halved(parities(s)) for s in shingle_sets(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(buckets, pa.binary())], ["node", "buckets"])

    cells = materialise(cells, "cells")
    bits = _texts(docs, cells, nodes).mapInArrow(marked, "node bigint, buckets binary")
    kinds = "pivot bigint, i int, j int, side int, node bigint, comp bigint, n int"
    likely = materialise(_parts(cells, bits).applyInArrow(likely_rows, kinds), "likely")
    return materialise(_parts(likely, _texts(docs, likely, nodes)).applyInArrow(cell_links, "a bigint, b bigint").distinct(), "links")


def _parts(cells: DataFrame, what: DataFrame) -> GroupedData:
    """Whole cells with ``what`` each node has, so many at a time as a call compares."""
    much = cells.agg(F.count("*").alias("rows"), F.sum("n").alias("n")).first()
    part = F.pmod(F.xxhash64("pivot", "i", "j"), F.lit(1 + max(much["rows"] // CELL_ROWS, (much["n"] or 0) // CELL_ELEMENTS)))
    # never broadcast: texts are not small when the table is large
    return shuffled(cells).join(what, "node").withColumn("part", part).groupBy("part")


def linked(docs: DataFrame, stored: DataFrame) -> DataFrame:
    """Components of nodes (``node``, ``component``) over links between similar sets."""
    single = frozenset(r["weak"] for r in stored.where("weak is not null").select("weak").distinct().collect())  # bands
    rows = signed(docs, sketch(stored), single)
    cell = Window.partitionBy("sig", "cell")
    shared = rows.withColumn("_low", F.min("node").over(cell)).withColumn("_high", F.max("node").over(cell))
    shared = materialise(shared.where("_low < _high or hot").select("sig", "node"), "shared")
    nodes = materialise(_first_rows(stored).join(shared.select("node").distinct(), "node", "left_semi"), "nodes")
    groups = materialise(groups_of(shared, nodes).withColumn("comp", F.col("node")), "groups")
    found, labels = docs.sparkSession.createDataFrame([], "a bigint, b bigint"), None
    for turn in range(PIVOT_ROUNDS):
        found = found.unionByName(links(dealt(groups, turn), docs, nodes))
        labels = components(found)
        # a group of one block is done
        groups = materialise(_labelled(groups.where("blocks > 1").drop("comp"), labels), "groups")
        if groups.isEmpty():
            return labels
    more = links(crossed(groups), docs, nodes)
    return components(found.unionByName(more)) if labels is None or not more.isEmpty() else labels


def _labelled(groups: DataFrame, labels: DataFrame) -> DataFrame:
    return groups.join(labels, "node", "left").select(*groups.columns, F.coalesce("component", "node").alias("comp"))


def _first_rows(stored: DataFrame) -> DataFrame:
    """The size of each node's set and the key of its first row; ``copies`` counts its rows."""
    first = F.min(F.struct("doc_id", "text_key")).alias("r")
    nodes = stored.where("n > 0").groupBy("node").agg(first, F.first("n").alias("n"), F.count("*").alias("copies"))
    return nodes.select("node", "n", "copies", F.col("r.doc_id").alias("r_doc"), F.col("r.text_key").alias("text_key"))


def _texts(docs: DataFrame, cells: DataFrame, nodes: DataFrame) -> DataFrame:
    """One text for each node in the cells."""
    wanted = nodes.drop("n").join(cells.select("node").distinct(), "node", "left_semi")
    wanted = materialise(wanted, "wanted")
    if is_small(wanted, BROADCAST_ROWS):
        wanted = F.broadcast(wanted)
    rows = _keyed(docs).join(wanted, "text_key").where(F.col("doc_id").eqNullSafe(F.col("r_doc"))).select("node", "text", "copies")
    # only a node of several rows can have its first row more than once
    once = rows.where("copies = 1").select("node", "text")
    return once.unionByName(rows.where("copies > 1").select("node", "text").dropDuplicates(["node"]))


def _named_rows(docs: DataFrame) -> DataFrame:
    """Every row's key, set size, node and component id."""
    stored = read_sets(docs)
    rows = stored.where("block is null").select("doc_id", "text_key", "node", F.col("n").cast("bigint").alias("n_shingles"))
    first = rows.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("first"))
    labels = linked(docs, stored)
    grouped = first.join(labels, "node").groupBy("component").agg(F.min("first").alias("component_id"))
    named = materialise(
        first.join(labels, "node", "left").join(grouped, "component", "left").select(
            "node", F.coalesce("component", "node").alias("component"), F.coalesce("component_id", "first").alias("component_id")
        ),
        "named",
    )
    return rows.join(named, "node", "left")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row; also ``node``, equal for equal sets."""
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return _named_rows(docs).select("doc_id", "n_shingles", own.alias("component_id"), "node")


def kept(docs: DataFrame) -> DataFrame:
    """One row of each component, with the smallest doc_id (null last); rows without words all stay."""
    rows = materialise(_named_rows(docs).where("n_shingles > 0"), "rows")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    chosen = rows.groupBy("component").agg(F.min(key).alias("k")).select("component", F.col("k.doc_id").alias("kept_doc"), F.col("k.text_key").alias("kept_key"))
    met = rows.join(materialise(chosen, "chosen"), "component")
    is_kept = F.col("doc_id").eqNullSafe(F.col("kept_doc")) & (F.col("text_key") == F.col("kept_key"))
    keys = met.groupBy("doc_id", "text_key").agg(F.max(is_kept).alias("stays"), F.count("*").alias("times"))
    key_name, doc_name, text_name = unused(docs, "_key", "_doc", "_text_key")
    marked = materialise(
        keys.where("not stays or times > 1").select(F.col("doc_id").alias(doc_name), F.col("text_key").alias(text_name), "stays"), "marked"
    )
    keyed = docs.withColumn(key_name, F.xxhash64("text"))

    def side(stays: bool) -> DataFrame:
        part = marked.where("stays" if stays else "not stays").drop("stays")
        return F.broadcast(part) if is_small(part, 2 * BROADCAST_ROWS) else part

    same = (F.col(key_name) == F.col(text_name)) & F.col("doc_id").cast("bigint").eqNullSafe(F.col(doc_name))
    single = keyed.join(side(False), same, "left_anti")
    repeated = side(True)
    once = single.join(repeated, same, "left_anti")
    again = single.join(repeated, same, "left_semi").dropDuplicates(["doc_id", key_name])
    return once.unionByName(again).select(*docs.columns)
