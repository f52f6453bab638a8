from functools import lru_cache

import pyarrow as pa
from helpers import AWKWARD, documents, prose

from newsflow.llm import decontamination

ITEMS = [(k, prose(f"item{k}", 12 + 9 * k)) for k in range(8)] + [(20, None), (21, " .. "), (22, "short item"), (23, prose("long", 170))]


def cases():
    """Texts and the item each holds."""
    rows, held = [(i, t) for i, t in AWKWARD], set()
    for k, item in [(k, t) for k, t in ITEMS if t and len(t.split()) > 5]:
        words = item.split()
        rows.append((100 + k, f"{prose(k, 200)}. {item.upper()}! {prose(-k, 100)}"))
        swapped = [w if j % 7 else f"other{j}" for j, w in enumerate(words)]  # a paraphrase
        rows.append((200 + k, f"{prose(k + 50, 77)} {' '.join(swapped)} {prose(k + 60, 30)}"))
        rows.append((300 + k, item))
        held |= {(100 + k, k), (200 + k, k), (300 + k, k)}
        rows.append((400 + k, f"{prose(k, 100)} {' '.join(words[: len(words) // 3])} {prose(k + 1, 100)}"))  # too little
        rows.append((500 + k, f"{' '.join(reversed(words))} {prose(k + 9, 40)}"))  # not in order
    rows += [(600 + i, prose(f"clean{i}", 150)) for i in range(60)]
    return rows, held


@lru_cache
def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_leaks(spark):
    rows, held = cases()
    benchmark = spark.createDataFrame([(k, t, "x") for k, t in ITEMS], "item_id bigint, text string, doc_id string")
    docs = documents(spark, rows)
    got = decontamination.leaks(docs, benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == held
    texts, items = dict(rows), dict(ITEMS)
    for r in got:
        item, text = tuple(items[r["item_id"]].split()), tuple(texts[r["doc_id"]].lower().replace("!", "").replace(".", "").split())
        assert r["item_share"] <= subsequence(item, text) / len(item) + 1e-9
    left = decontamination.clean(docs, benchmark)
    assert left.columns == docs.columns
    gone = {i for i, _ in held}
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(str(i) for i, _ in rows if i not in gone)


def test_item_in_a_third_of_all_rows(spark):
    item = prose("shared", 14)
    rows = [(i, f"{prose(i, 60)} {item if i % 3 == 0 else prose(-i, 14)} {prose(i + 900, 40)}") for i in range(1, 151)]
    benchmark = spark.createDataFrame([(1, item), (2, prose("other", 14))], "item_id bigint, text string")
    got = decontamination.leaks(documents(spark, rows), benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(i, 1) for i in range(3, 151, 3)}


def test_short_paraphrases_at_a_large_passage_count(spark, monkeypatch):
    counted = decontamination.frequencies
    monkeypatch.setattr(decontamination, "frequencies", lambda *a: tuple(n * 10**9 for n in counted(*a)))
    items = [(k, prose(f"brief{k}", 12)) for k in range(12)]
    swapped = [" ".join(f"new{j}" if j in (1, 4, 7) else w for j, w in enumerate(t.split())) for _, t in items]
    rows = [(k, f"{prose(k, 150)} {t} {prose(-k - 1, 150)}") for k, t in enumerate(swapped)] + [(100 + i, t) for i in range(30) for _, t in items]
    got = decontamination.leaks(documents(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got if r["doc_id"] < 100} == {(k, k) for k in range(12)}


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "ITEMS_AT_ONCE", 3)
    rows, held = cases()
    benchmark = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(documents(spark, rows), benchmark).collect()} == held


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    one = spark.createDataFrame(ITEMS[:1], "item_id bigint, text string")
    assert decontamination.leaks(documents(spark, AWKWARD), none).count() == 0
    assert decontamination.leaks(documents(spark, []), one).count() == 0
    assert decontamination.clean(documents(spark, AWKWARD), none).count() == len(AWKWARD)


def test_bit_parallel_subsequence():
    import random
    random.seed(2)
    for _ in range(200):
        a, b = ([random.randrange(5) for _ in range(random.randrange(1, 12))] for _ in range(2))
        masks = {}
        for k, w in enumerate(a):
            masks[w] = masks.get(w, 0) | 1 << k
        assert decontamination.common_subsequence(masks, len(a), b) == subsequence(tuple(a), tuple(b))


def test_given_leaks(spark, sf):
    import re
    norm = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    docs, benchmark = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r["item_id"], norm(r["text"])) for r in benchmark.collect()]
    want = {(r["doc_id"], i) for r in docs.collect() for i, t in items if t in norm(r["text"])}
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, benchmark).collect()} == want


def test_edges_go_as_by_the_pattern():
    words = ["«quoted»", "_a_", "...", "'é'", "-ǅ-", "日本。", "²", "½x", "Ⅷ", "×x×", "÷", "x²", "a'", "(plain)", "(it's)", "​q", "áb́"]
    assert decontamination._without_edges(pa.array(words)).to_pylist() == [decontamination._EDGE.sub("", w) for w in words]
    codes, cuts = decontamination.word_codes(pa.array(["(A) a, ... b", "", "b."]))
    assert cuts.tolist() == [0, 3, 3, 4] and codes[0] == codes[1] != codes[2] == codes[3]
