import numpy as np
import pyarrow as pa
from helpers import AWKWARD, documents, prose

from newsflow.llm import severity


def corpus(seed, n):
    """Clean texts, and toxic ones with one to five bad words."""
    bad = ["glimforn", "trobask", "vexolin"]
    rows = []
    for i in range(n):
        words = prose(f"{seed}-{i}", 40).split()
        for k in range(i % 6 if i % 2 else 0):
            words[5 + 6 * k] = bad[(i + k) % 3]
        rows.append((seed * 10_000 + i, " ".join(words), int(any(b in words for b in bad))))
    return rows


def fitted(rows):
    return severity.fit(*severity.features(pa.array([t for _, t, _ in rows])), np.array([y for _, _, y in rows]) == 1)


def test_held_out_accuracy_and_order():
    model = fitted(corpus(1, 400))
    assert (np.diff(model.thresholds) > 0).all()
    rows = corpus(2, 200)
    key, count, _ = severity.features(pa.array([t for _, t, _ in rows]))
    p = severity.scores(model, key, count, len(rows))
    assert (np.diff(p, axis=1) <= 0).all()
    assert ((p[:, 0] >= severity.TOXIC) == np.array([y == 1 for *_, y in rows])).mean() > 0.99
    mean = lambda k: np.mean([p[i].sum() for i in range(len(rows)) if rows[i][2] and i % 6 == k])
    assert mean(5) > mean(1) + 0.5  # more bad words are graded higher


def test_scores_of_a_table(spark):
    rows = corpus(1, 300)
    docs = documents(spark, [(i, t) for i, t, _ in rows] + AWKWARD)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (5, 1, None)], "doc_id bigint, quality int, toxic int")
    model = severity.train(docs, labels)
    out = severity.scored(docs, model)
    assert out.columns == ["doc_id", "p1", "p2", "p3", "severity", "toxic"]
    got = out.collect()
    assert len(got) == len(rows) + len(AWKWARD)
    toxic = {r["doc_id"] for r in got if r["toxic"]}
    assert toxic == {i for i, _, y in rows if y}
    assert all(abs(r["p1"] + r["p2"] + r["p3"] - r["severity"]) < 1e-12 for r in got)
    left = severity.accepted(docs, model)
    assert left.columns == docs.columns and left.count() == len(got) - len(toxic)
    assert left.where("toxic = 'x'").count() == left.count()


def test_given_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    fit_on, held_out = labels.where("doc_id % 3 > 0"), labels.where("doc_id % 3 = 0")
    rows = severity.scored(docs, severity.train(docs, fit_on)).join(held_out.withColumnRenamed("toxic", "truth"), "doc_id").collect()
    assert np.mean([r["toxic"] == (r["truth"] == 1) for r in rows]) > 0.93


def test_without_labels_or_rows(spark):
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    docs = documents(spark, AWKWARD)
    assert severity.train(docs, labels) is None
    assert severity.scored(docs, None).where("toxic").count() == 0
    assert severity.scored(documents(spark, []), None).count() == 0


def test_copies_train_once():
    texts = [prose(1, 30)] * 50 + [prose(2, 30)]
    key, _, words = severity.features(pa.array(texts))
    assert severity.one_of_copies(key, len(words)).sum() == 2


def test_gradient_against_differences():
    random = np.random.default_rng(1)
    rows, features = 30, 6
    r, c, x = random.integers(0, rows, 90), random.integers(0, features, 90), random.random(90) + 1
    grade = random.integers(0, severity.GRADES, rows)
    params = random.normal(size=features + severity.GRADES - 1)
    gradient = severity.loss_and_gradient(params, r, c, x, grade)[1]
    for k in range(len(params)):
        step = np.zeros_like(params)
        step[k] = 1e-6
        slope = (severity.loss_and_gradient(params + step, r, c, x, grade)[0] - severity.loss_and_gradient(params - step, r, c, x, grade)[0]) / 2e-6
        assert abs(slope - gradient[k]) < 1e-6


def test_table_and_texts_at_hand_give_one_model(spark):
    rows = corpus(3, 300)
    docs = documents(spark, [(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    a, b = severity.train(docs, labels), fitted(rows)
    assert a.features.tolist() == b.features.tolist()
    assert np.allclose(a.weights, b.weights) and np.allclose(a.thresholds, b.thresholds)
