"""Licences as they stand in real files: unabridged, wrapped over lines, in one line, or behind comment marks."""

import re
import textwrap
import time

import pytest

from strandframe.llm import licenses, queries

MIT = """MIT License

Copyright (c) 2024 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD = """Copyright (c) The Regents of the University of California.
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:
1. Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright
   notice, this list of conditions and the following disclaimer in the
   documentation and/or other materials provided with the distribution.
3. Neither the name of the University nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE REGENTS AND CONTRIBUTORS ``AS IS'' AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED.
"""
BSD_2 = re.sub(r"3\. Neither.*?permission\.\n", "", BSD, flags=re.S)
APACHE = """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License.
"""
GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version {} of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY.
"""
GPL_2 = GPL.format(2).replace("software:", "software;").replace("Foundation,", "Foundation;")
MPL = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/.\n"
ISC = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n"
TEXTS = {"MIT": MIT, "BSD-3-Clause": BSD, "BSD-2-Clause": BSD_2, "Apache-2.0": APACHE, "GPL-3.0": GPL.format(3), "GPL-2.0": GPL_2, "MPL-2.0": MPL, "ISC": ISC}
NOTICES = {
    "This file is licensed under the MIT License.": "MIT",
    "This project is licensed under the terms of the\nApache License, Version 2.0.": "Apache-2.0",
    "// SPDX-License-Identifier: GPL-2.0-or-later\nint main() {}": "GPL-2.0",
    "/* SPDX-License-Identifier: BSD-3-Clause */\r\nint x;": "BSD-3-Clause",
    "Not one of these is released under the MIT License by us.": None,
    "licensed under the\n\nMIT License": None,
    "Released under the MIT License\nas a line of its own": "MIT",
    "This work is licensed under a Creative Commons Attribution 4.0 International License.": "CC-BY-4.0",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.": "CC-BY-SA-3.0",
    "Licensed under CC BY 3.0": "CC-BY-3.0",
    "This library is licensed under the zlib License.": "Zlib",
    "Distributed under the Boost Software License, Version 1.0.": "BSL-1.0",
    "This program is made available under the terms of the Eclipse Public License 2.0": "EPL-2.0",
}


def _lines(text: str, width: int) -> str:
    """Paragraphs wrapped anew."""
    return "\n\n".join(textwrap.fill(" ".join(p.split()), width) for p in text.split("\n\n"))


def _found(spark, texts):
    rows = licenses.recognize_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    return [r.license for r in sorted(rows, key=lambda r: r.doc_id)]


@pytest.mark.parametrize(
    "form",
    [
        lambda t: t,
        lambda t: _lines(t, 10_000),
        lambda t: _lines(t, 38),
        lambda t: " ".join(t.split()),
        lambda t: t.replace("\n", "\r\n"),
        lambda t: "/*\n" + "".join(f" * {x}\n" for x in t.split("\n")) + " */\nint main() { return 0; }\n",
        lambda t: "".join(f"# {x}\n" for x in t.split("\n")) + "import os\n",
    ],
    ids=["as it stands", "unwrapped", "narrow", "one line", "CRLF", "block comment", "line comment"],
)
def test_unabridged_texts(spark, form):
    assert dict(zip(TEXTS, _found(spark, [form(t) for t in TEXTS.values()]), strict=True)) == {x: x for x in TEXTS}


def test_notices(spark):
    assert dict(zip(NOTICES, _found(spark, list(NOTICES)), strict=True)) == NOTICES


def _licences(spark, text):
    return licenses.recognize_licenses(spark.createDataFrame([(1, text)], "doc_id int, text string")).first().licenses


def test_expressions_of_several_licences(spark):
    assert _licences(spark, "SPDX-License-Identifier: MIT OR Apache-2.0") == ["MIT", "Apache-2.0"]
    assert _licences(spark, "SPDX-License-Identifier: (GPL-2.0-or-later WITH Classpath-exception-2.0) AND BSD-3-Clause\nint x;") == ["BSD-3-Clause", "GPL-2.0"]
    assert _licences(spark, "SPDX-License-Identifier: GPL-2.0-or-later") == ["GPL-2.0"]
    assert _licences(spark, "Licensed under either of Apache License, Version 2.0\nor MIT license\nat your option.") == ["MIT", "Apache-2.0"]


def test_rules_that_say_less_yield(spark):
    assert _licences(spark, BSD) == ["BSD-3-Clause"] and _licences(spark, BSD_2) == ["BSD-2-Clause"]
    assert _licences(spark, "Copyright 2020 Some One.\nAll rights reserved.") == ["Proprietary"]


def test_many_notices_in_one_file_take_linear_time(spark):
    """Five megabytes of the same notices, none of which ends a rule."""
    notice = "Copyright (c) Some One.\nAll rights reserved.\n\n" + BSD_2.split("are met:\n")[1].split("THIS SOFTWARE")[0]
    seconds = []
    for n in (1, 10_000):
        began = time.time()
        assert _licences(spark, notice * n) == ["BSD-2-Clause"]
        seconds.append(time.time() - began)
    assert len(notice) * 10_000 > 3.8e6 and seconds[1] < seconds[0] + 40


def plain_licences(text):
    """sentence_ids and licences by a plain program: the same cuts, looked up in a dictionary."""
    plain = lambda t: re.sub("[^a-z0-9]+", " ", t).strip()
    openings = {tuple(s.split()[: licenses.OPENING]) for s in licenses.ALL_SENTENCES if len(s.split()) >= licenses.LONG}

    def unit(words):
        s = " ".join(words)
        if s in licenses.ALL_SENTENCES:
            return [licenses.ALL_SENTENCES[s]]
        m = re.match(licenses.NOTICE, s)
        if not m:
            return []
        rest = re.sub("^ ?(the )?", "", s[m.end() :]).removesuffix(" at your option").strip()
        return [licenses.NOTICE_NAMES[p] for p in re.split(licenses.JOINED, rest) if p in licenses.NOTICE_NAMES]

    def cut(piece):
        words = plain(piece).split()
        cuts = [0, *[i for i in range(1, len(words)) if tuple(words[i : i + licenses.OPENING]) in openings and i + licenses.OPENING < len(words)], len(words)]
        return [i for a, b in zip(cuts, cuts[1:]) for i in unit(words[a:b])]

    whole = lambda piece: unit(plain(piece).split())
    by_line = lambda of, sentence: [i for line in sentence.split("\n") for i in of(line)] if "\n" in sentence else []

    ids = []
    for paragraph in re.split(r"\n(?:[^a-z0-9\n]*\n)+", re.sub("\r\n?", "\n", (text or "").lower())):
        for sentence in re.split(licenses.SENTENCE_END, paragraph):
            ids += max(whole(sentence) or cut(sentence), max(by_line(whole, sentence), by_line(cut, sentence), key=len), key=len)
    found = []
    for name, wanted, _ in licenses.ALL_RULES:
        at = iter(ids)
        if name not in found and all(w in at for w in wanted):
            found.append(name)
    return ids, [n for n in found if not licenses.YIELDS.get(n, set()) & set(found)]


def test_names_of_notices_are_not_cut():
    assert [n for n in licenses.NOTICE_NAMES if len(re.split(licenses.JOINED, n)) > 1] == []


def test_whole_table_and_wrapped_texts_against_a_plain_program(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()}
    mixed = [_lines(x + "\n\n" + y, w) for x in TEXTS.values() for y in NOTICES for w in (30, 72)]
    docs |= {10**6 + i: t for i, t in enumerate([*TEXTS.values(), *NOTICES, *mixed])}
    rows = licenses.recognize_licenses(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.sentence_ids, r.licenses) for r in rows} == {i: plain_licences(t) for i, t in docs.items()}


def test_same_as_sql_where_lines_are_not_wrapped(spark):
    import duckdb

    con, folder = duckdb.connect(), "/root/testdata/sf0.01"
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = con.execute(queries.ORACLE_SQL["op6_license_sentences"]).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in queries.op6_license_sentences(spark, folder).collect())
