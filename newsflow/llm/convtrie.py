"""Prefix trie of conversations by truncation peeling.

Conversations that share their first turns share their first nodes.  The trie is found from its deep end:
conversations that have ended at a depth are merged with the nodes that survive there, the last turn is
stripped, and what is left is grouped again, until the textless root remains.  Each grouping finds the
nodes of its depth and adds up their subtrees at once, so no node is visited again.

How it scales.  Turns become digests first; texts are never shuffled, and a row holds the digests of its
prefixes.  Equal conversations are one weighted row.  Nothing can merge at a depth where no prefix has
two continuations, so rows are stripped to the next depth where one has, and the nodes passed by are
read off the row.  The rounds are therefore the depths at which different conversations part or end, not the
turns of the longest conversation.  All that is grouped are sums and minima, which are combined before
the shuffle; a first turn that a third of all conversations share moves as one row per task.  The
identifiers of the members that end at a node are sorted over all tasks, joined to pieces there, and
hashed piece by piece, never gathered.

Defined results: turns are in the order of turn (null first), then role, then text digest; a null role or
text is empty; repeated turns stay turns of their own; rows without conv_id belong to no conversation
and are left out; a text of any length is one digest; an empty table has no root and gives no rows;
further columns are ignored.  The digests of one conversation (24 bytes a turn) must fit in one row.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsflow.session import materialise

#: The rebuilding rule: conversations of a block of ``BLOCK`` ids take up to ``HEAD`` turns of its first one.
BLOCK, HEAD = 100, 5
#: Characters of joined identifiers that are hashed at a time.
PIECE = 1 << 16
_ROWS = 500
_ROOT = bytes(16)
_TURNS = "array<struct<digest:binary,chars:bigint>>"


def digested(conversations: DataFrame) -> DataFrame:
    """conv_id and its ``turns`` in order, each a digest of role and text and the characters of its text."""
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    framed = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    digest = F.unhex(F.substring(F.sha2(framed, 256), 1, 32))
    turn = F.struct("turn", "role", digest.alias("digest"), F.length("text").cast("bigint").alias("chars"))
    bare = lambda t: F.struct(t["digest"].alias("digest"), t["chars"].alias("chars"))
    return rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(turn)), bare).alias("turns"))


def rebuilt(digests: DataFrame) -> DataFrame:
    """Conversations that begin with the first turns of the first conversation of their block.

    Conversation c takes the first h turns of conversation c - c % ``BLOCK``, as many as it has, and goes on with its own
    turns after its first h; h is the unsigned CRC-32 of the decimal c, modulo ``HEAD`` + 1.
    """
    h = (F.crc32(F.col("conv_id").cast("string")) % (HEAD + 1)).cast("int")
    heads = digests.where(F.col("conv_id") % BLOCK == 0).select(F.col("conv_id").alias("_block"), F.slice("turns", 1, HEAD).alias("_head"))
    joined = digests.withColumn("_block", F.col("conv_id") - F.col("conv_id") % BLOCK).join(heads, "_block", "left")
    head = F.slice(F.coalesce("_head", F.array().cast(_TURNS)), F.lit(1), h)
    own = F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))
    return joined.select("conv_id", F.concat(head, own).alias("turns"))


def paths(conversations: DataFrame) -> DataFrame:
    """conv_id, the digests of its prefixes (``path``, from the root) and the characters up to each (``cum``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(low, _ROWS)
                path, cum = [], []
                for turns in batch.column("turns").to_pylist():
                    at, chars = _ROOT, 0
                    path.append([at])
                    cum.append([0])
                    for turn in turns:
                        at, chars = hashlib.sha256(at + turn["digest"]).digest()[:16], chars + turn["chars"]
                        path[-1].append(at)
                        cum[-1].append(chars)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("conv_id"), pa.array(path, pa.list_(pa.binary())), pa.array(cum, pa.list_(pa.int64()))], ["conv_id", "path", "cum"]
                )

    return conversations.select("conv_id", "turns").mapInArrow(run, "conv_id bigint, path array<binary>, cum array<bigint>")


def member_hashes(rows: DataFrame) -> DataFrame:
    """Per ``key``: SHA-256 hex of its decimal ``conv_id`` values, ascending, comma-joined."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(ids)])], ["key", "first", "ids"])

        key, first, ids, size = None, None, [], 0
        for batch in batches:
            for k, c in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
                if ids and (k != key or size >= PIECE):
                    yield piece()
                    ids = []
                if not ids:
                    key, first, size = k, c, 0
                ids.append(str(c))
                size += len(ids[-1]) + 1
        if ids:
            yield piece()

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, key, state = ([], []), None, None
        for batch in batches:
            for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
                if state is not None and k == key:
                    state.update(b"," + ids.encode())
                    continue
                if state is not None:
                    done[0].append(key)
                    done[1].append(state.hexdigest())
                key, state = k, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.binary()), pa.array(done[1], pa.string())], ["key", "sha"])
            done = ([], [])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["key", "sha"])

    # ids break up a key that many members share; the pieces of a key meet again, thousands of ids each
    dealt = rows.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").select("key", "conv_id")
    joined = dealt.mapInArrow(pieces, "key binary, first bigint, ids string")
    return joined.repartition("key").sortWithinPartitions("key", "first").mapInArrow(hashes, "key binary, sha string")


def _at(values: str, depth: Column) -> Column:
    """The entry at a depth of ``path`` or ``cum``; depth 0 is the root."""
    return F.element_at(values, depth + 1)


def parting_depths(sequences: DataFrame) -> list[int]:
    """Depths at which a prefix has two continuations, its end counted as one; and the root's.  Deepest first."""
    onward = F.concat(F.slice("path", F.lit(2), F.size("path")), F.slice("path", -1, 1))
    steps = sequences.select(F.posexplode(F.arrays_zip(F.col("path").alias("at"), onward.alias("next"))).alias("depth", "step"))
    spread = steps.groupBy("step.at").agg(F.min("step.next").alias("low"), F.max("step.next").alias("high"), F.first("depth").alias("depth"))
    parting = spread.where("low != high").select("depth").distinct()
    return sorted({0, *(r["depth"] for r in parting.collect())}, reverse=True)


def peeled(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie over ``conv_id`` and ``turns``: see ``trie`` for the columns."""
    members = materialise(paths(conversations), "paths")
    ended = members.groupBy(F.element_at("path", -1).alias("key")).agg(
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv"), F.first(F.struct("path", "cum")).alias("p")
    )
    ended = materialise(ended.select("n", "conv", "p.path", "p.cum", (F.size("p.path") - 1).alias("depth")), "sequences")
    depths = parting_depths(ended)
    leaf = ended.where(~F.col("depth").isin(depths)).select(
        "path", "cum", "depth", "n", "conv", F.lit(True).alias("ends"), F.lit(0).cast("bigint").alias("children"),
        F.lit(1).cast("bigint").alias("leaves"), ((F.col("n") - 1) * (_at("cum", F.col("depth")) - _at("cum", F.col("depth") - 1))).alias("saved"),
    )
    survivors, rounds, above = None, [], None
    for depth in depths:
        d = F.lit(depth)
        rows = leaf.where(F.col("depth") > depth)
        rows = rows if above is None else rows.where(F.col("depth") < above)
        rows = rows if survivors is None else rows.unionByName(survivors)
        # what the children bring, each stripped to this depth
        passed = (F.col("n") - 1) * (_at("cum", F.col("depth") - 1) - _at("cum", d))
        stripped = rows.select(
            _at("path", d).alias("key"), F.slice("path", 1, depth + 1).alias("path"), F.slice("cum", 1, depth + 1).alias("cum"), "n", "conv",
            F.lit(False).alias("ends"), F.lit(1).cast("bigint").alias("children"), "leaves", (F.col("saved") + passed).alias("saved"),
        )
        zero = F.lit(0).cast("bigint")
        ending = ended.where(F.col("depth") == depth).select(
            _at("path", d).alias("key"), "path", "cum", "n", "conv", F.lit(True).alias("ends"),
            zero.alias("children"), zero.alias("leaves"), zero.alias("saved"),
        )
        merged = stripped.unionByName(ending).groupBy("key").agg(
            F.sum("n").alias("n"), F.min("conv").alias("conv"), F.max("ends").alias("ends"), F.sum("children").alias("children"),
            F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.first(F.struct("path", "cum")).alias("p"),
        )
        own = (F.col("n") - 1) * (_at("p.cum", d) - _at("p.cum", F.lit(max(depth - 1, 0))))
        merged = merged.select(
            "p.path", "p.cum", d.alias("depth"), "n", "conv", "ends", "children",
            F.when(F.col("children") == 0, 1).otherwise(F.col("leaves")).cast("bigint").alias("leaves"), (F.col("saved") + own).alias("saved"),
        )
        survivors, above = materialise(merged, "survivors"), depth
        rounds.append(survivors)
    found = functools.reduce(DataFrame.unionByName, rounds)
    return _nodes(leaf.unionByName(found), found, member_hashes(members.select(F.element_at("path", -1).alias("key"), "conv_id")), depths)


def _nodes(rows: DataFrame, parting: DataFrame, hashes: DataFrame, depths: list[int]) -> DataFrame:
    """Every row with the nodes between it and the next parting above, its parent found by digest."""
    above = F.array_max(F.filter(F.array(*(F.lit(d) for d in depths)), lambda d: d < F.col("depth")))
    rows = rows.withColumn("above", above).withColumn("key", _at("path", F.col("depth"))).withColumn("parent", _at("path", F.col("above")))
    parents = parting.select(_at("path", F.col("depth")).alias("parent"), F.col("conv").alias("parent_conv"))
    rows = rows.join(parents, "parent", "left").join(hashes, "key", "left")
    none = hashlib.sha256().hexdigest()
    top, x, deepest = F.coalesce(F.col("above") + 1, F.lit(0)), F.col("x"), F.col("x") == F.col("depth")
    passed = (F.col("n") - 1) * (_at("cum", F.col("depth") - 1) - _at("cum", x - 1))
    return rows.withColumn("top", top).withColumn("x", F.explode(F.sequence("top", "depth"))).select(
        F.col("conv").alias("conv_id"), x.cast("bigint").alias("depth"),
        F.when(x == 0, None).when(x == F.col("top"), F.col("parent_conv")).otherwise(F.col("conv")).cast("bigint").alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(deepest, F.col("children")).otherwise(1).cast("bigint").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.when(deepest, F.col("saved")).otherwise(F.col("saved") + passed).alias("saved_tokens"),
        F.when(deepest & F.col("ends"), F.col("sha")).otherwise(none).alias("ends_sha256"),
    )


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``
    (hash of the members that end there).
    """
    return peeled(rebuilt(materialise(digested(conversations), "turns")))


_EXPECTED_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda s, k: CASE WHEN s % 2 = 1 THEN xor(s // 2, 3988292384) ELSE s // 2 END)), 4294967295)"""

SQL = f"""WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS body,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id AS c FROM turns),
heads AS (SELECT c, {_EXPECTED_CRC} % 6 AS h FROM ids),
taken AS (SELECT c, h, count(p) AS k FROM heads LEFT JOIN turns ON turns.conv_id = c - c % 100 AND p <= h GROUP BY c, h),
placed AS (
  SELECT c, p, role, body FROM taken JOIN turns ON turns.conv_id = c - c % 100 AND p <= h
  UNION ALL SELECT c, k + p - h, role, body FROM taken JOIN turns ON turns.conv_id = c AND p > h),
sequences AS (SELECT c, coalesce(list([role, body] ORDER BY p) FILTER (p IS NOT NULL), []) AS l FROM ids LEFT JOIN placed USING (c) GROUP BY c),
steps AS (SELECT c, l, unnest(range(0, len(l) + 1)) AS d FROM sequences),
prefixes AS (
  SELECT c, d, md5(to_json(l[1:d])::VARCHAR) AS k, CASE WHEN d > 0 THEN md5(to_json(l[1:d - 1])::VARCHAR) END AS pk,
    CASE WHEN d > 0 THEN length(l[d][2]) ELSE 0 END AS chars, len(l) = d AS ended FROM steps),
nodes AS (
  SELECT k, any_value(pk) AS pk, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n, any_value(chars) AS chars,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ended), '')) AS ends_sha256 FROM prefixes GROUP BY k),
children AS (SELECT pk AS k, count(*) AS n_children FROM nodes WHERE pk IS NOT NULL GROUP BY pk),
full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (k)),
sums AS (
  SELECT prefixes.k, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((f.n - 1) * f.chars) AS saved
  FROM full_nodes f JOIN prefixes ON prefixes.c = f.conv_id AND prefixes.d <= f.depth GROUP BY prefixes.k)
SELECT f.conv_id, f.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, f.n AS n_convs, f.n_children::BIGINT AS n_children,
  n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, f.ends_sha256
FROM full_nodes f JOIN sums USING (k) LEFT JOIN nodes up ON up.k = f.pk"""
