import corpus_pipeline
import pytest
from compare import compare, entry
from helpers import base_spans, components, jaccard_linked, shingles

from newsflow.llm import queries
from newsflow.session import materialise


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, sf, name):
    rows, problem = compare(spark, sf, name)
    assert problem == "" and rows > 0


def test_one_query_per_operator():
    names = set(entry.queries())
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf), name)
        assert docs.columns == columns
        seen.append({r["doc_id"]: r for r in docs.collect()})
    toxic, near, clean, private = seen
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert sum(labels.get(i) == 0 for i in toxic) >= 0.98 * sum(v == 0 for v in labels.values())
    sets = {i: shingles(r["text"]) for i, r in toxic.items()}
    want = components(sets, lambda a, b: jaccard_linked(sets[a], sets[b]))
    assert set(near) == {i for i in toxic if want[i] == i}
    assert set(clean) <= set(near)
    assert set(private) == set(clean)
    for i, r in private.items():
        if not base_spans(clean[i]["text"]):
            assert r["text"] == clean[i]["text"]
        else:
            assert r["text"] != clean[i]["text"] and r["n_chars"] == len(r["text"])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r["doc_id"] for r in packed} == set(private)
    assert max(r["offset"] + r["length"] for r in packed) <= 4096
