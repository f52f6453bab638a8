import duckdb
from compare import rows_of, spark_rows
from helpers import AWKWARD, documents

from newsflow.llm import licences

NOTICE = " ".join(s[0] for s in (licences.SENTENCES[k] for k in ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")))
CASES = [
    (100, f"code\n{NOTICE}\nmore"), (101, "Released under the MIT License.\nAll rights reserved."), (102, "Licensed under something else entirely. Yes."),
    (103, "ALL RIGHTS\nRESERVED."), (104, "no such thing here. None at all."), (105, licences.SENTENCES["bsd-grant"][0] + " " + licences.SENTENCES["bsd-source"][0] + "\n" + licences.SENTENCES["bsd-binary"][0]),
    (106, "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0."), (107, "İ All rights reserved.\t\"Licensed under the MIT License.\""),
]


def test_rules(spark):
    got = {r["doc_id"]: r for r in licences.scanned(documents(spark, AWKWARD + CASES)).collect()}
    want = {100: "MIT", 101: "MIT,All-Rights-Reserved", 102: "Unknown", 103: "All-Rights-Reserved", 104: "", 105: "BSD-2-Clause", 106: "CC-BY-NC-4.0", 107: "MIT,All-Rights-Reserved"}
    assert {i: got[i]["licences"] for i in want} == want
    assert got[100]["sentence_ids"] == "mit-grant,mit-notice,mit-warranty,mit-liability" and got[106]["n_sentences"] == 2


def _wrapped(text, width=40, mark="# "):
    lines = []
    for paragraph in text.split("\n\n"):
        line = ""
        for word in paragraph.split():
            if len(line) + len(word) > width:
                lines.append(line)
                line = ""
            line += word + " "
        lines += [line, ""]
    return "\n".join(mark + line for line in lines)


def _joined(sentences):
    return "".join(s + (" " if s[-1] in ".!?;:" else "\n\n") for s in sentences).strip()


FORMS = [(name, _joined(licences.SENTENCES[i][0] for i in ids)) for name, ids in licences.RULES if ids != ["unknown"]]
NOTICES = [(1000 + 3 * k + j, form(text)) for k, (_, text) in enumerate(FORMS) for j, form in enumerate([str, _wrapped, lambda t: "Some heading\n" + _wrapped(t, 60, "") + "\nand code"])]


def test_every_rule_fires_in_one_line_and_wrapped(spark):
    got = {r["doc_id"]: r["licences"] for r in licences.scanned(documents(spark, NOTICES)).collect()}
    for k, (name, text) in enumerate(FORMS):
        assert got[1000 + 3 * k] == got[1001 + 3 * k] == name, (name, text)
        if text.endswith((".", ":", ";")):
            assert got[1002 + 3 * k] == name


def test_no_known_sentence_is_divided_by_the_cut():
    import re

    assert [s for forms in licences.SENTENCES.values() for s in forms if re.search(licences._STOP, s.strip())] == []


def test_header_with_blank_lines(spark):
    header = """Copyright 2020 Someone

   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License."""
    row = licences.scanned(documents(spark, [(1, header)])).first()
    assert (row["sentence_ids"], row["licences"]) == ("apache2-under,apache2-comply,apache2-copy,apache2-basis,apache2-see", "Apache-2.0")


def test_against_sql(spark, tmp_path):
    docs = documents(spark, AWKWARD + CASES + NOTICES + [(900, "line without stop\n" * 3000 + "All rights\nreserved.")])
    docs.coalesce(1).write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents/*.parquet')")
    cursor = con.execute(licences.SQL)
    assert spark_rows(licences.scanned(docs)) == rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert licences.scanned(docs.limit(0)).count() == 0


def test_every_known_sentence_has_a_cue():
    cued = lambda s: any(c in s.lower() for c in licences.CUES)
    assert [s for forms in licences.SENTENCES.values() for s in forms if not cued(s)] == []
    assert any(c in licences.UNKNOWN for c in licences.CUES)
    ids = set(licences.SENTENCES) | {"unknown"}
    assert {i for _, rule in licences.RULES for i in rule} <= ids
