import hashlib
import zlib

import duckdb

import helpers
from newsflow.llm import convtrie
from newsflow.llm.queries import ORACLES, QUERIES

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
TRICKY = ["key", "path", "cum", "n", "conv", "turns", "depth", "above", "x"]


def table(spark, rows):
    full = [(*r, *["x"] * len(TRICKY)) for r in rows]
    return spark.createDataFrame(full, "conv_id bigint, turn bigint, role string, text string, " + ", ".join(f"`{c}` string" for c in TRICKY))


def brute(rows):
    by_id = {}
    for c, turn, role, text in rows:
        if c is not None:
            by_id.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    by_id = {c: [t[2:] for t in sorted(v)] for c, v in by_id.items()}
    nodes = {}
    for c, own in by_id.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole = by_id.get(c - c % 100, [])[:h] + own[h:]
        for d in range(len(whole) + 1):
            nodes.setdefault(tuple(whole[:d]), []).append((c, d == len(whole)))
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        out.append((
            min(c for c, _ in members), len(path), min(c for c, _ in nodes[path[:-1]]) if path else None, len(members),
            sum(len(p) == len(path) + 1 for p in below), sum(not any(q != p and q[: len(p)] == p for q in below) for p in below),
            sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in below if p),
            hashlib.sha256(",".join(str(c) for c in sorted(c for c, end in members if end)).encode()).hexdigest(),
        ))
    return sorted(out, key=lambda r: (r[0], r[1]))


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=lambda r: (r[0], r[1]))


def long_head(h_wanted, start):
    return next(c for c in range(start, start + 99) if zlib.crc32(str(c).encode()) % 6 == h_wanted)


def test_small_conversations_against_brute_force(spark):
    rows = [(c, t, ["user", "assistant", None][t % 3], f"turn {t % 2 if c % 3 else c % 5} é😀" if (c + t) % 7 else None) for c in range(40) for t in range(c % 6 + 1)]
    rows += [(7, None, "system", "first of all"), (7, None, "system", "first of all"), (None, 1, "user", "nobody's"), (3, 1, "user", "a tie"), (3, 1, "user", "b tie")]
    rows += [(100 + k, t, "user", "same") for k in range(8) for t in range(3)] + [(250, 0, "user", "no base"), (251, 5, "", "")]
    assert got(convtrie.trie(table(spark, rows))) == brute(rows)


def test_one_conversation_and_turnless_members(spark):
    c = long_head(5, 301)
    rows = [(c, 0, "user", "gone with the head"), (c, 1, "assistant", "too")]
    assert got(convtrie.trie(table(spark, rows))) == brute(rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_nested_and_deep_conversations(spark):
    rows = [(c * 100, t, "user", f"step {t}") for c in range(6) for t in range(3 * c + 1)]
    rows += [(700, t, "user", f"deep {t}") for t in range(300)] + [(800, t, "user", f"deep {t}") for t in range(300)]
    rows += [(900, t, "user", f"deep {t}" if t < 150 else f"other {t}") for t in range(160)]
    assert got(convtrie.trie(table(spark, rows))) == brute(rows)


def test_rounds_do_not_grow_with_length(spark):
    conversations = table(spark, [(100, t, "user", f"deep {t}") for t in range(400)] + [(200, 0, "user", "other")])
    members = convtrie.paths(convtrie.rebuilt(convtrie.digested(conversations)))
    assert convtrie.parting_depths(members) == [0]


def test_many_copies_are_hashed_in_pieces(spark, monkeypatch):
    rows = [(c * 100, 0, "user", "copy") for c in range(3000)] + [(-500, 0, "user", "copy")]
    monkeypatch.setattr(convtrie, "PIECE", 100)
    assert got(convtrie.trie(table(spark, rows))) == brute(rows)


def test_empty_table_and_very_long_text(spark):
    assert convtrie.trie(table(spark, [])).count() == 0
    rows = [(0, 0, "user", "x" * 2_000_000), (1, 0, "user", "x" * 2_000_000)]
    assert got(convtrie.trie(table(spark, rows))) == brute(rows)


def test_query_equals_its_sql(spark, sf):
    want = duckdb.sql(ORACLES["op12_truncation_peeling"].replace("FROM conversations", f"FROM '{sf}/conversations.parquet'"))
    rows = [tuple(r) for r in want.project(", ".join(COLUMNS)).fetchall()]
    assert got(QUERIES["op12_truncation_peeling"](spark, sf)) == sorted(rows, key=lambda r: (r[0], r[1]))
