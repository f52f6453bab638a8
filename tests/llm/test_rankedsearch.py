import math
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import helpers
from newsflow.llm import rankedsearch
from newsflow.llm.queries import ORACLES, QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, length = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    by_id = {}
    for item, text in items:
        by_id.setdefault(item, set()).update(terms(text))
    out = []
    for item, wanted in by_id.items():
        scores = []
        for doc, c in held:
            m = 100 - 50 + (50 * c.total() * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in wanted if c[t])
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, place, doc, -s) for place, (s, _, _, doc) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def items_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "item_id bigint, text string, term string, rank string")


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_terms_of_sliced_arrays():
    texts = ["x", "Héllo_WORLD-9 ÀB", "", None, "\x00a\x7fb{c}[d]`e@f", "日本 ＡＢ z Y", "İI"]
    batch = pa.RecordBatch.from_pydict({"text": texts}).slice(1)
    number, words, ends = rankedsearch.terms(rankedsearch.arrow.texts(batch))
    assert [[words[i] for i in number[a:b]] for a, b in zip(ends, ends[1:])] == [terms(t) for t in texts[1:]]


@pytest.mark.parametrize("seed", range(40))
def test_nra_equals_full_sums(seed):
    """Few distinct impacts, so that many scores tie."""
    random = np.random.default_rng(seed)
    documents, k = int(random.integers(1, 400)), int(random.integers(1, 30))
    found = []
    for _ in range(random.integers(1, 70)):
        docs = random.permutation(documents)[: random.integers(1, documents + 1)].astype(np.int32)
        impacts = np.sort(random.integers(0, 4 if seed % 2 else 1000, len(docs)))[::-1].astype(np.int64)
        found.append((docs, impacts))
    total = np.zeros(documents, dtype=np.int64)
    for docs, impacts in found:
        total[docs] += impacts
    want = sorted((-s, d) for d, s in enumerate(total.tolist()) if s > 0)[:k]
    best, score = rankedsearch.nra(found, documents, k, first_read=1 + seed % 5)
    assert [(-s, d) for d, s in zip(best.tolist(), score.tolist())] == want


def test_nra_stops_before_the_ends_of_the_lists():
    """A clear winner in every list: unread entries are never looked at."""
    docs = np.arange(10_000, dtype=np.int32)
    impacts = np.r_[np.full(64, 1000), np.ones(9936)].astype(np.int64)

    class Watched(np.ndarray):
        deepest = 0

        def __getitem__(self, at):
            if isinstance(at, slice):
                Watched.deepest = max(Watched.deepest, at.stop)
            return super().__getitem__(at)

    best, _ = rankedsearch.nra([(docs, impacts.view(Watched)), (docs, impacts.view(Watched))], 10_000, 5)
    assert best.tolist() == [0, 1, 2, 3, 4] and Watched.deepest < 1000


@pytest.mark.parametrize("shard_docs", [7, 8192])
def test_small_documents_against_brute_force(spark, shard_docs):
    docs = [(i, f"{'common ' * (i % 4)} w{i % 9} W{i % 5} rare{i} Été") for i in range(120)]
    docs += [(200 + k, "the same words w1 w2") for k in range(60)] + helpers.AWKWARD
    items = [(1, "w1 w2 common"), (2, "W3 été w3"), (3, None), (4, "--"), (5, "absent"), (6, helpers.prose(6, 40)), (1, "rare7"), (None, "word two"), (None, "three")]
    out = rankedsearch.ranked(helpers.documents(spark, docs), items_of(spark, items), k=10, shard_docs=shard_docs)
    assert got(out) == brute(docs, items, 10)


def test_blocks_of_items_give_the_same_rows(spark, monkeypatch):
    docs = [(i, helpers.prose(i % 17, 30)) for i in range(100)]
    items = [(i, helpers.prose(i, 12)) for i in range(17)]
    monkeypatch.setattr(rankedsearch, "ITEMS", 5)
    assert got(rankedsearch.ranked(helpers.documents(spark, docs), items_of(spark, items))) == brute(docs, items, 50)


def test_empty_tables(spark):
    some, none = helpers.documents(spark, [(1, "a b")]), helpers.documents(spark, [])
    assert got(rankedsearch.ranked(none, items_of(spark, [(1, "a")]))) == []
    assert got(rankedsearch.ranked(some, items_of(spark, []))) == []
    assert got(rankedsearch.ranked(helpers.documents(spark, [(1, None), (2, "")]), items_of(spark, [(1, "a")]))) == []


def test_query_equals_its_sql(spark, sf):
    sql = ORACLES["op11_nra"].replace("FROM documents", f"FROM '{sf}/documents.parquet'").replace("FROM benchmark", f"FROM '{sf}/benchmark.parquet'")
    assert got(QUERIES["op11_nra"](spark, sf)) == sorted(duckdb.sql(sql).fetchall(), key=str)
