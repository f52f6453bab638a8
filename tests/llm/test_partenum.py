import numpy as np
import pyarrow as pa
from helpers import AWKWARD, components, documents, jaccard_linked, prose, shingles

from newsflow.llm import arrow, partenum
from newsflow.llm.components import components as spark_components


def near(seed, words, changes):
    text = prose(seed, words).split()
    for k in changes:
        text[k] = f"changed{k}x{seed}"
    return " ".join(text)


def cases():
    passage = prose("shared", 60)
    rows = list(AWKWARD)
    rows += [(100 + i, near(1, 300, range(0, i * 6, 6))) for i in range(12)]  # further and further from the first
    rows += [(200 + i, prose(2, 200)) for i in range(30)]  # exact copies
    rows += [(300 + i, prose(f"p{i}", 25 + i) + " " + passage) for i in range(25)]  # a passage in common, else unlike
    rows += [(400 + i, " ".join(prose(3, 7).split()[: 5 + i % 3])) for i in range(6)]  # tiny sets
    rows += [(500 + i, near(4, 100 + i, [])) for i in range(30)]  # a chain of growing texts
    rows += [(600, prose(5, 4000)), (601, near(5, 4000, range(0, 4000, 100))), (602, near(5, 4000, range(0, 4000, 12)))]
    return rows


def test_against_all_pairs(spark):
    rows = cases()
    got = partenum.near_duplicates(documents(spark, rows)).collect()
    sets = {i: shingles(t) for i, t in rows if i is not None}
    want = components(sets, lambda a, b: jaccard_linked(sets[a], sets[b]))
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]]), r
    # the row without an id joins the equal texts of document 7
    assert sorted(r["component_id"] or 0 for r in got if r["doc_id"] is None) == [0, 7]


def test_one_row_kept_of_each_component(spark):
    rows = cases()
    docs = documents(spark, rows)
    left = partenum.kept(docs)
    assert left.columns == docs.columns
    sets = {i: shingles(t) for i, t in rows if i is not None}
    want = components(sets, lambda a, b: jaccard_linked(sets[a], sets[b]))
    kept = sorted(r["doc_id"] for r in left.collect() if r["doc_id"] is not None)
    assert kept == sorted(i for i in sets if want[i] == i)
    assert [r["text"] for r in left.where("doc_id is null").collect()] == [None]


def test_empty_table(spark):
    assert partenum.near_duplicates(documents(spark, [])).count() == 0


def test_similar_sets_share_a_chosen_signature():
    rng = np.random.default_rng(5)
    for size in [1, 2, 3, 4, 7, 20, 95, 96, 127, 128, 140, 190, 255, 256, 400, 1000, 3000]:
        for _ in range(6):
            a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
            away = int(rng.integers(0, partenum.tolerance(size) + 1))
            extra = int(rng.integers(0, away + 1))
            b = np.unique(np.concatenate([a[away - extra :], rng.integers(0, 2**64, extra, dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if not len(b) or 4 * both < 3 * (len(a) + len(b) - both):
                continue
            chosen = []
            for s in (a, b):
                own = set()
                for band in partenum.bands_of(len(s)):
                    sigs = partenum.signatures(s, band, False)
                    assert len(sigs) > partenum.tolerance(len(s)) or band
                    own |= set(np.sort(sigs)[: partenum.tolerance(len(s)) + 1].tolist())
                chosen.append(own)
            assert chosen[0] & chosen[1], size


def test_parities_bound_the_difference():
    rng = np.random.default_rng(6)
    for size, common in ((900, 500), (900, 880), (3000, 2000)):
        a, b = (np.unique(rng.integers(0, 2**64, size, dtype=np.uint64)) for _ in range(2))
        b[:common] = a[:common]
        b = np.unique(b)
        x, y = (np.frombuffer(partenum.parities(s), np.uint8)[None, :] for s in (a, b))
        assert len(x[0]) == len(y[0])
        low, narrow = partenum._apart(x, y)[0], partenum._apart(partenum._folded(x, 64), partenum._folded(y, 64))[0]
        assert narrow <= low <= len(np.setxor1d(a, b)) <= 1.2 * low + 2


def test_components_of_a_chain_a_star_and_a_loop(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 202), (202, 201), (201, 200), (7, 7)]
    got = {r["node"]: r["component"] for r in spark_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200, 202: 200}


def test_fewer_single_elements_are_enough():
    """Sets at the limit of similarity, in any shared order, have a common one among the first quarter and one."""
    rng = np.random.default_rng(8)
    for size in range(1, 127):
        a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
        for kept in range(len(a) + 1):
            b = a[len(a) - kept :]
            if not kept or 4 * kept < 3 * len(a):
                continue
            x, y = (np.sort(s)[: partenum.quota(len(s), True)] for s in (a, b))
            assert set(x.tolist()) & set(y.tolist())


def test_a_cell_gives_a_forest():
    """Two groups of near copies and a stranger: as many links as join each group, whatever the pairs."""
    texts = [near(1, 300, range(0, 2 * i, 2)) for i in range(12)] + [near(2, 300, range(0, 2 * i, 2)) for i in range(9)] + [prose(3, 300)]
    sets = partenum.shingle_sets(pa.array(texts))
    n = len(texts)
    cell = pa.table({
        "node": list(range(n)), "comp": list(range(n)), "n": [len(s) for s in sets], "side": [3] * n,
        "buckets": [partenum.parities(s) for s in sets], "apart": [None] * n,
    })
    pairs = partenum.likely_forest(cell).to_pylist()
    assert len(pairs) == 11 + 8
    whole = components(range(n), lambda a, b: {"a": min(a, b), "b": max(a, b)} in pairs)
    assert whole == components(range(n), lambda a, b: jaccard_linked(shingles(texts[a]), shingles(texts[b])))
    told = cell.set_column(cell.column_names.index("apart"), "apart", pa.array([[p["b"] for p in pairs if p["a"] == i] for i in range(n)], pa.list_(pa.int64())))
    again = partenum.likely_forest(told).to_pylist()
    assert again and not [p for p in again if p in pairs]


def test_last_blocks_find_what_pivots_leave(spark, monkeypatch):
    rows = cases()
    monkeypatch.setattr(partenum, "PIVOT_ROUNDS", 0)
    monkeypatch.setattr(partenum, "BLOCK", 8)
    got = {r["doc_id"]: r["component_id"] for r in partenum.near_duplicates(documents(spark, rows)).collect()}
    sets = {i: shingles(t) for i, t in rows if i is not None}
    want = components(sets, lambda a, b: jaccard_linked(sets[a], sets[b]))
    assert {i: c for i, c in got.items() if i is not None} == want


def test_word_hashes_come_from_the_bytes():
    words = ["", "a", "ab", "a\0", "a\0\0", "abcdefgh", "abcdefghi", "abcdefgh\0", "x" * 16, "x" * 17, "x" * 24, "é"]
    whole = arrow.hashed(pa.array(words))
    assert len(set(whole.tolist())) == len(words)
    assert (arrow.hashed(pa.array(words).slice(3, 5)) == whole[3:8]).all()
    assert len(arrow.hashed(pa.array([], pa.string()))) == 0


def test_rarest_are_chosen_in_an_order_that_sets_share():
    sigs = np.arange(1, 40, dtype=np.uint64) << np.uint64(40)
    often = (np.arange(39) * 7) % 5
    want = sorted(zip(often.tolist(), sigs.tolist()))[:9]
    assert sorted((often[k], sigs[k]) for k in partenum.chosen(sigs, often, 9)) == want
    alike = np.array([5, 6, 7], dtype=np.uint64)  # the order cannot tell these: all are taken
    assert len(partenum.chosen(alike, np.zeros(3, np.int64), 1)) == 3


def test_many_small_cells_in_one_call():
    """The forests are those of each cell alone, though cells share sets and components."""
    texts = [near(1, 300, range(0, 2 * i, 2)) for i in range(6)] + [near(2, 900, range(0, 2 * i, 2)) for i in range(5)]
    sets = partenum.shingle_sets(pa.array(texts))
    members, cell = [0, 1, 2, 0, 1, 6, 7, 3, 8, 9, 10], np.array([0, 0, 0, 1, 1, 1, 1, 2, 3, 3, 3])
    table = pa.table({
        "node": members, "comp": members, "n": [len(sets[k]) for k in members], "side": [3] * len(members),
        "buckets": [partenum.parities(sets[k]) for k in members], "apart": pa.array([None] * len(members), pa.list_(pa.int64())),
    })
    number, a, b = partenum.likely_forests(table, cell)
    got = sorted(zip(number.tolist(), a.to_pylist(), b.to_pylist()))
    alone = []
    for k in range(4):
        part = partenum.likely_forest(table.filter(pa.array(cell == k))).to_pylist()
        alone += [(k, p["a"], p["b"]) for p in part]
    assert got == sorted(alone) and [len([g for g in got if g[0] == k]) for k in range(4)] == [2, 2, 0, 2]


def test_a_cell_of_near_copies_is_joined_at_once(monkeypatch):
    """Once a pair joins components, later pairs between them are not compared: a few per set, not all pairs."""
    sets = [np.arange(1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(600)]
    n, compared = len(sets), []
    whole = partenum._Parities.apart
    monkeypatch.setattr(partenum._Parities, "apart", lambda self, x, y: compared.append(len(x)) or whole(self, x, y))
    table = pa.table({
        "node": list(range(n)), "comp": list(range(n)), "n": [1000] * n, "side": [3] * n,
        "buckets": [partenum.parities(s) for s in sets], "apart": pa.array([None] * n, pa.list_(pa.int64())),
    })
    assert len(partenum.likely_forest(table)) == n - 1
    assert sum(compared) < 40 * n


def test_groups_beyond_a_block_cost_rows_in_proportion(spark, monkeypatch):
    """A group of near copies with a few strangers: rows of cells grow with its size, not with its square, and the links are all pairs'."""
    monkeypatch.setattr(partenum, "BLOCK", 8)
    made = []
    whole = partenum.links
    monkeypatch.setattr(partenum, "links", lambda cells, *more: made.append(cells.count()) or whole(cells, *more))
    rows = [(i, near(1, 120, [60 + i % 20])) for i in range(20)] + [(100 + i, near(1, 120, range(3 + i, 120, 9))) for i in range(3)]
    rows += [(i + 200, near(1, 120, [30 + i % 20, 70 + i % 40])) for i in range(80)]
    got = {r["doc_id"]: r["component_id"] for r in partenum.near_duplicates(documents(spark, rows)).collect()}
    sets = {i: shingles(t) for i, t in rows}
    assert got == components(sets, lambda a, b: jaccard_linked(sets[a], sets[b]))
    assert sum(made) < 12 * len(rows) * 2, made


def test_parities_of_half_the_buckets_bound_the_difference_too():
    rng = np.random.default_rng(9)
    a, b = (np.unique(rng.integers(0, 2**64, 300, dtype=np.uint64)) for _ in range(2))
    b = np.unique(np.concatenate([a[:280], b[280:]]))
    x, y = (np.frombuffer(partenum.halved(partenum.parities(s)), np.uint8)[None, :] for s in (a, b))
    assert 0 < partenum._apart(x, y)[0] <= len(np.setxor1d(a, b))
