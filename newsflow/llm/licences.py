"""Licence scan by sentence rules, in DataFrame functions.

Texts are cut into sentences at stops before white space and at lines without a letter or digit.  A sentence is normalised (ASCII lower case, runs
of other characters to one space) and may be wrapped over lines, with comment marks; it may also follow other lines without a stop,
such as a heading, so it is looked up from each of its line starts on, the longest first.  A
known normalised sentence has an identifier; what the cut would divide, as at ``software;``, is known in its parts.  The identifiers of a text, in order, are matched against ordered
licence rules, each a sequence of identifiers: the first rule takes all its places before the next one is tried, so
a full notice wins over a line of it.  A sentence that speaks of a licence but is not known is ``unknown``.

Defined results: null and empty texts have no sentences; equal rows give equal results; null ids are kept; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licences and notices by identifier.
SENTENCES = {
    "apache2-under": ["Licensed under the Apache License, Version 2.0.", "This project is licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\");", "This work is licensed under the Apache License, Version 2.0."],
    "apache2-comply": ["you may not use this file except in compliance with the License."],
    "apache2-copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at"],
    "apache2-basis": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "apache2-see": ["See the License for the specific language governing permissions and limitations under the License."],
    "mit-under": ["Released under the MIT License.", "Licensed under the MIT License.", "This work is licensed under the MIT License.", "This project is licensed under the MIT License."],
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "mit-warranty": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."],
    "mit-liability": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd-endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "gpl3-under": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3."],
    "gpl2-under": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2."],
    "gpl-program": ["This program is free software:", "This program is free software;"],
    "gpl3-free": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl2-free": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;"],
    "gpl2-later": ["either version 2 of the License, or (at your option) any later version."],
    "gpl-hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"],
    "gpl-warranty": ["without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "gpl-see": ["See the GNU General Public License for more details."],
    "gpl-copy": ["You should have received a copy of the GNU General Public License along with this program."],
    "lgpl-library": ["This library is free software;", "This library is free software:"],
    "lgpl2-free": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;"],
    "lgpl2-later": ["either version 2.1 of the License, or (at your option) any later version."],
    "lgpl3-free": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "agpl3-free": ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "mpl2-under": ["This Source Code Form is subject to the terms of the Mozilla Public License, v."],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "isc-warranty": ["THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."],
    "bsd-warranty": ["THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."],
    "bsd-style": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Licensed under the BSD License."],
    "epl2-under": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "cc0": ["Licensed under CC0 1.0.", "This work is licensed under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "zlib-warranty": ["This software is provided 'as-is', without any express or implied warranty."],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "boost-under": ["Distributed under the Boost Software License, Version 1.0.", "Licensed under the Boost Software License, Version 1.0."],
    "cc-by-nc-4": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa-4": ["Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-4": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "reserved": ["All rights reserved."],
}
# Licence rules, tried in this order.
RULES = [
    ("Apache-2.0", ["apache2-under", "apache2-comply", "apache2-copy", "apache2-basis", "apache2-see"]),
    ("Apache-2.0", ["apache2-comply", "apache2-copy", "apache2-basis", "apache2-see"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty", "mit-liability"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("GPL-3.0-or-later", ["gpl-program", "gpl3-free", "gpl-hope", "gpl-warranty", "gpl-see"]),
    ("GPL-2.0-or-later", ["gpl-program", "gpl2-free", "gpl2-later", "gpl-hope", "gpl-warranty", "gpl-see"]),
    ("GPL-3.0-or-later", ["gpl-program", "gpl3-free"]),
    ("GPL-2.0-or-later", ["gpl-program", "gpl2-free", "gpl2-later"]),
    ("AGPL-3.0-or-later", ["gpl-program", "agpl3-free"]),
    ("LGPL-2.1-or-later", ["lgpl-library", "lgpl2-free", "lgpl2-later"]),
    ("LGPL-3.0-or-later", ["lgpl-library", "lgpl3-free"]),
    ("ISC", ["isc-grant", "isc-warranty"]),
    ("ISC", ["isc-grant"]),
    ("Zlib", ["zlib-warranty", "zlib-grant"]),
    ("Apache-2.0", ["apache2-under"]),
    ("MIT", ["mit-under"]),
    ("GPL-3.0", ["gpl3-under"]),
    ("GPL-2.0", ["gpl2-under"]),
    ("MPL-2.0", ["mpl2-under"]),
    ("EPL-2.0", ["epl2-under"]),
    ("Unlicense", ["unlicense"]),
    ("BSL-1.0", ["boost-under"]),
    ("BSD", ["bsd-style"]),
    ("CC0-1.0", ["cc0"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4"]),
    ("CC-BY-4.0", ["cc-by-4"]),
    ("All-Rights-Reserved", ["reserved"]),
    ("Unknown", ["unknown"]),
]
#: Each known sentence, and what makes a sentence ``unknown``, holds one of these, single words as a line may end between words; other texts need no closer look.
CUES = ["licen", "copyright", "reserved", "redistribut", "warrant", "permission", "software", "domain"]
UNKNOWN = "licensed under "
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CUT = "\x01"


def normalised(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def known() -> dict[str, str]:
    """Identifier of each normalised sentence."""
    return {normalised(s): name for name, forms in SENTENCES.items() for s in forms}


#: No known sentence has more words, so none is wrapped over more lines that hold a word.
LINES = max(len(s.split()) for s in known())
# Where sentences end.
_STOP, _BLANK = "([.!?;:])[ \\t\\r\\n]+", "\\n[^A-Za-z0-9\\n]*\\n"


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, _UPPER, _LOWER), "[^a-z0-9]+", " "))


def identifiers(text: Column) -> Column:
    """Identifiers of the known and unknown licence sentences, in order."""
    table = F.create_map(*(F.lit(v) for pair in known().items() for v in pair))
    cut = F.regexp_replace(F.regexp_replace(text, _STOP, f"$1{_CUT}"), _BLANK, _CUT)
    lines = F.transform(F.split(cut, _CUT), lambda s: F.filter(F.transform(F.split(s, "\n"), _plain), lambda w: w != ""))
    lines = F.filter(lines, lambda w: F.size(w) > 0)

    def name(line: Column) -> Column:
        last = F.slice(line, F.greatest(F.lit(1), F.size(line) - LINES + 1), F.lit(LINES))
        starts = F.sequence(F.lit(1), F.size(last))
        found = F.transform(starts, lambda k: F.try_element_at(table, F.array_join(F.slice(last, k, F.lit(LINES)), " ")))
        unknown = F.when(F.contains(F.array_join(line, " "), F.lit(UNKNOWN)), F.lit("unknown"))
        return F.coalesce(F.get(F.filter(found, lambda i: i.isNotNull()), F.lit(0)), unknown)

    return F.filter(F.transform(lines, name), lambda n: n.isNotNull())


def scanned(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``sentence_ids`` and ``licences`` (both in order, joined by commas) of every document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    folded = F.translate("_text", _UPPER, _LOWER)
    cued = F.lit(False)
    for cue in CUES:
        cued = cued | F.contains("_folded", F.lit(cue))
    rows = docs.select("doc_id", text.alias("_text")).select("doc_id", "_text", folded.alias("_folded"))
    rows = rows.select("doc_id", F.when(cued, identifiers(F.col("_text"))).otherwise(F.array().cast("array<string>")).alias("ids"))
    rules = F.array(*(F.struct(F.lit(name).alias("name"), F.lit("".join(f"<{i}>" for i in ids)).alias("ids")) for name, ids in RULES))
    begin = F.struct(F.concat(F.lit("<"), F.array_join("ids", "><"), F.lit(">")).alias("left"), F.lit("").alias("found"))

    def take(so_far: Column, rule: Column) -> Column:
        there = F.contains(so_far["left"], rule["ids"])
        return F.struct(
            F.replace(so_far["left"], rule["ids"], F.lit("|")).alias("left"),
            F.when(there, F.concat(so_far["found"], F.lit(","), rule["name"])).otherwise(so_far["found"]).alias("found"),
        )

    found = F.aggregate(rules, begin, take)["found"]
    names = F.array_join(F.array_distinct(F.split(F.substr(found, F.lit(2)), ",")), ",")
    return rows.select(
        "doc_id", F.array_join("ids", ",").alias("sentence_ids"), F.when(F.size("ids") > 0, names).otherwise("").alias("licences"),
        F.size("ids").cast("bigint").alias("n_sentences"),
    )


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    cases = " ".join(f"WHEN {quoted(s)} THEN {quoted(i)}" for s, i in known().items())
    steps, last = [], "r0"
    for k, (name, ids) in enumerate(RULES, 1):
        rule = quoted("".join(f"<{i}>" for i in ids))
        steps.append(
            f"r{k} AS (SELECT doc_id, ids, replace(rest, {rule}, '|') AS rest,"
            f" CASE WHEN contains(rest, {rule}) AND NOT list_contains(names, {quoted(name)}) THEN list_append(names, {quoted(name)}) ELSE names END AS names FROM {last})"
        )
        last = f"r{k}"
    return f"""WITH cut AS (
  SELECT doc_id, string_split(regexp_replace(regexp_replace(coalesce(text, ''), '{_STOP}', '\\1' || chr(1), 'g'), '{_BLANK}', chr(1), 'g'), chr(1)) AS parts FROM documents),
plain AS (SELECT doc_id, list_filter(list_transform(parts, lambda p: list_filter(list_transform(string_split(p, chr(10)),
    lambda w: trim(regexp_replace(translate(w, '{_UPPER}', '{_LOWER}'), '[^a-z0-9]+', ' ', 'g'))), lambda w: w <> '')), lambda p: len(p) > 0) AS parts FROM cut),
named AS (SELECT doc_id, list_filter(list_transform(parts, lambda p: coalesce(
    list_filter(list_transform(range(greatest(1, len(p) - {LINES} + 1), len(p) + 1), lambda k: CASE array_to_string(p[k:], ' ') {cases} END), lambda i: i IS NOT NULL)[1],
    CASE WHEN contains(array_to_string(p, ' '), '{UNKNOWN}') THEN 'unknown' END)), lambda i: i IS NOT NULL) AS ids FROM plain),
r0 AS (SELECT doc_id, ids, '<' || array_to_string(ids, '><') || '>' AS rest, CAST([] AS VARCHAR[]) AS names FROM named),
{", ".join(steps)}
SELECT doc_id, coalesce(array_to_string(ids, ','), '') AS sentence_ids, coalesce(array_to_string(names, ','), '') AS licences, CAST(len(ids) AS BIGINT) AS n_sentences FROM {last}"""


SQL = _sql()
