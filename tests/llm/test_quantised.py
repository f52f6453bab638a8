import numpy as np
from helpers import components

from newsflow.llm import quantised

INVALID = [None, [], [0.0] * 8, [1.0, None] + [0.0] * 6, [float("nan")] * 8, [float("inf")] + [0.0] * 7]


def cases():
    rng = np.random.default_rng(3)
    rows, key = [], 0
    for label in (0, 1, None):
        for centre in rng.standard_normal((12, 8)):
            for _ in range(25):
                rows.append((key, (centre + 0.12 * rng.standard_normal(8)).tolist(), label))
                key += 1
    rows += [(key + i, rows[0][1], 0) for i in range(5)]  # equal vectors
    rows += [(key + 10 + i, [2.0 * v for v in rows[0][1]], 0) for i in range(2)]  # the same direction
    rows += [(key + 20 + i, v, 0) for i, v in enumerate(INVALID)]
    rows += [(key + 40, [1.0, 2.0], 0), (key + 41, [1.0, 2.0001], 0), (key + 42, [2.0, -1.0], 0)]  # another length
    return rows


def truth(rows, threshold):
    unit = {}
    for i, v, label in rows:
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            unit[i] = (label, np.array(v) / np.linalg.norm(v))
    linked = lambda a, b: a in unit and b in unit and unit[a][0] == unit[b][0] and len(unit[a][1]) == len(unit[b][1]) and unit[a][1] @ unit[b][1] >= threshold
    keys = [i for i, _, _ in rows]
    return {a: sum(linked(a, b) for b in keys if b != a) for a in keys}, components(keys, linked)


def test_against_all_pairs(spark):
    rows = cases()
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<double>, label int, node string")
    got = {r["vec_id"]: r for r in quantised.near_vectors(frame).collect()}
    counts, component = truth(rows, quantised.THRESHOLD)
    assert {i: (r["n_links"], r["component_id"]) for i, r in got.items()} == {i: (counts[i], component[i]) for i in counts}
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    assert sum(counts.values()) > 100


def test_blocks_of_a_large_list(spark, monkeypatch):
    monkeypatch.setattr(quantised, "BLOCK", 20)
    rows = cases()
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    counts, component = truth(rows, quantised.THRESHOLD)
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in quantised.near_vectors(frame).collect()} == {i: (counts[i], component[i]) for i in counts}


def test_nothing_to_compare(spark):
    kind = "vec_id bigint, embedding array<float>, label int"
    assert quantised.near_vectors(spark.createDataFrame([], kind)).count() == 0
    got = quantised.near_vectors(spark.createDataFrame([(1, None, 0), (2, [0.0], 0)], kind)).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_lookups_bound_the_inner_product():
    rng = np.random.default_rng(4)
    points = rng.standard_normal((600, 16))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    index = quantised.fit(points[:300], 6)
    place, _ = quantised._nearest(points, index.centres)
    for centre in range(6):
        mine = points[place == centre]
        residual = mine - index.centres[centre]
        parts = [quantised._nearest(residual[:, a:b], c) for (a, b), c in zip(index.cuts, index.codes)]
        codes, error = np.column_stack([p[0] for p in parts]).astype(np.uint8), np.sqrt(sum(p[1] ** 2 for p in parts))
        assert (quantised._bound(index, centre, points[:50], codes, error) >= points[:50] @ mine.T - 1e-9).all()
