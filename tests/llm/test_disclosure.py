import hashlib

from helpers import AWKWARD, base_spans, documents, prose

from newsflow.llm import disclosure

TEXTS = [
    "a@b.c_d@e.f x@y@z.w.q a..b@c-d.e-.f.", "1.2.3.4.5.6.7.8 300.1.1.1 001.2.3.255 1.2.3 0.0.0.256",
    "4111 1111 1111 1111 4111-1111-1111-1112 12--34 4111111111111111 5 4111111111111111", "4-1 1-1 4111 1111 1111 1111  6011000990139424",
    "+1 (202) 555-0143. +49 30 123456 +1 +12 +1234567 +123456789012345678 +1-2+3 4455667788 ", "\U0001F600 a@b.co é 10.0.0.1\nx +44 20 7946 0958",
    "9" * 4000 + " " + "1." * 3000, "x" * 9000 + "@", "@@@ ... +++ --", "a@b.c,a@b.c,1.1.1.1 4111111111111111 +12345678",
]


def digest(spans):
    return hashlib.sha256(",".join(spans).encode()).hexdigest()


def test_base_spans_against_python(spark, sf):
    rows = AWKWARD + [(100 + i, t) for i, t in enumerate(TEXTS)]
    rows += [(1000 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = disclosure.report(documents(spark, rows)).collect()
    want = sorted((str(i), digest(base_spans(t)), *(sum(s.startswith(k) for s in base_spans(t)) for k in disclosure.KINDS)) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["base_sha256"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in got) == want
    by_id = {r["doc_id"]: r["spans"] for r in got}
    assert all((by_id[i] + ",").startswith(",".join(base_spans(t))) for i, t in rows if i is not None)


def secret_corpus():
    rows = [(i, f"{prose(i, 30)} the falconer wrote to boss@firm.example about number {i} today. {prose(-i, 30)}") for i in range(1, 7)]
    rows += [(10 + i, f"{prose(50 + i, 20)} today we wrote about number {i} and nothing else") for i in range(20)]
    rows += [(40, "a falconer flew")]
    return rows


def test_terms_that_disclose_an_entity(spark):
    rows = secret_corpus()
    docs = documents(spark, rows)
    found = disclosure.protected(docs)
    bits = {(r["entity"], r["term"]): round(r["bits"], 3) for r in disclosure.disclosing(found, docs).collect()}
    # 6 of 7 texts with the word hold the address; the common words are in 26
    assert bits == {("email:boss@firm.example", "falconer"): 0.222}
    spans = {r["doc_id"]: r["spans"] for r in disclosure.report(docs).collect()}
    for i, text in rows[:6]:
        low, mail = text.index("falconer"), text.index("boss@")
        assert spans[i] == f"email:{mail}:{mail + 17},removed:{low}:{low + 8}"
    assert spans[40] == "" and spans[10] == ""


def test_terms_of_an_entity_seen_once(spark):
    rows = [(i, f"{prose(i, 20)} today we wrote about number {i}") for i in range(100, 300)]
    rows += [(50, "today the falconer wrote to solo@firm.example about number one hundred"), (51, "once more a gardener and today +44 20 7946 0958 with number two"), (52, "a gardener flew")]
    docs = documents(spark, rows)
    found = disclosure.protected(docs)
    bits = {(r["entity"], r["term"]): round(r["bits"], 3) for r in disclosure.disclosing(found, docs).collect()}
    assert bits["email:solo@firm.example", "falconer"] == 0 and bits["phone:+44 20 7946 0958", "gardener"] == 1
    assert not {t for _, t in bits} & {"today", "wrote", "about", "number"}
    spans = {r["doc_id"]: r["spans"] for r in disclosure.report(docs).collect()}
    texts = dict(rows)
    assert f"removed:{texts[50].index('falconer')}:" in spans[50] and f"generalised:{texts[51].index('gardener')}:" in spans[51]


def test_terms_anywhere_in_the_text_of_an_entity(spark):
    rows = [(i, f"{prose(i, 20)} today we wrote about number {i}") for i in range(1, 40)]
    rows += [(50 + i, f"solo@firm.example {prose(50 + i, 60)} a falconer" if i else f"the falconer solo@firm.example {prose(50, 60)} falconer") for i in range(3)]
    rows += [(60, rows[-1][1])]  # a copy counts once
    docs = documents(spark, rows)
    found = disclosure.protected(docs)
    bits = {(r["entity"], r["term"]): round(r["bits"], 3) for r in disclosure.disclosing(found, docs).collect()}
    assert bits["email:solo@firm.example", "falconer"] == 0 and not {t for _, t in bits} & {"solo", "firm", "example"}
    texts, spans = dict(rows), {r["doc_id"]: r["spans"].split(",") for r in disclosure.report(docs).collect()}
    for i in (50, 51, 52, 60):
        low = texts[i].rindex("falconer")
        assert f"removed:{low}:{low + 8}" in spans[i]
    assert "removed:4:12" in spans[50]


def test_terms_at_the_edges_and_short_names(spark):
    rows = [(i, f"{prose(i, 20)} today we wrote about number {i}") for i in range(100, 300)]
    rows += [(1, "Ivanova a@b.example"), (2, "+44 20 7946 0958 Petrov"), (3, "we wrote c@d.example to Li about \u674e today")]
    texts, got = dict(rows), {r["doc_id"]: r["spans"] for r in disclosure.report(documents(spark, rows)).collect()}
    for i, term in ((1, "Ivanova"), (2, "Petrov"), (3, "Li"), (3, "\u674e")):
        low = texts[i].index(term)
        assert f"removed:{low}:{low + len(term)}" in got[i]


def test_sanitised_texts(spark):
    rows = secret_corpus() + [(60, "call +12345678901 or 4111 1111 1111 1111, ip 10.0.0.1"), (61, None)]
    docs = documents(spark, rows)
    out = disclosure.sanitised(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert "falconer" not in got[1]["text"] and "[EMAIL]" in got[1]["text"] and "boss" not in got[1]["text"]
    assert got[1]["n_chars"] == len(got[1]["text"])
    assert got[10]["text"] == dict(rows)[10] and got[40]["text"] == dict(rows)[40] and got[61]["text"] is None
    assert got[60]["text"] == "call [PHONE] or [CARD], ip [IP]"
    assert all(r["_marks"] == "x" for r in got.values())


def test_empty_table(spark):
    assert disclosure.report(documents(spark, [])).count() == 0
    assert disclosure.sanitised(documents(spark, [])).count() == 0


def test_plan_is_native(spark):
    plan = disclosure.report(documents(spark, [(1, "x")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
