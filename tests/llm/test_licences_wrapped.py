"""Licence texts as files have them: wrapped, commented, with one-line notices between."""

import textwrap

import duckdb
import pytest

from quillspark.llm import queries
from quillspark.llm.licenses import scan_licenses

MIT = [
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
]
APACHE = [
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "http://www.apache.org/licenses/LICENSE-2.0",
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
]
GPL = [
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details.",
]
BSD = [
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
]
LGPL = [
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU Lesser General Public License for more details.",
]
AGPL = [
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU Affero General Public License for more details.",
]
ZLIB = [
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
]
CC0 = [
    "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
]
EPL = ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at", "https://www.eclipse.org/legal/epl-2.0/"]
ISC = ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."]


@pytest.mark.parametrize("width", [50, 72, 78, 5000])
def test_wrapped_and_commented(spark, width):
    texts = {"MIT-text": MIT, "Apache-2.0-header": APACHE, "GPL-3.0-or-later-header": GPL, "BSD-2-Clause-text": BSD, "ISC": ISC}
    texts |= {"LGPL-2.1-or-later-header": LGPL, "AGPL-3.0-or-later-header": AGPL, "Zlib-text": ZLIB, "CC0-1.0-header": CC0, "EPL-2.0": EPL}
    rows = []
    for name, paragraphs in texts.items():
        lines = ["Copyright (c) 2020 A. Body", ""]
        for p in paragraphs:
            lines += [*textwrap.wrap(p, width), ""]
        for mark in ("", "// ", "# ", " * ", "-- ", ";; ", "! "):
            rows += [(name, end.join(f"{mark}{x}" for x in lines)) for end in ("\n", "\r\n")]
    got = scan_licenses(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert [(r.doc_id, r.licenses) for r in got] == [(n, n) for n, _ in rows]
    assert sorted(map(tuple, got)) == sql(rows)


def sql(rows):
    """The query's SQL over the same rows."""
    con = duckdb.connect()
    con.execute("create table documents(doc_id varchar, text varchar)")
    con.executemany("insert into documents values (?, ?)", [(str(i), t) for i, t in rows])
    names = "doc_id, n_sentences, sentence_ids, licenses, categories"
    return sorted(con.sql(f"select {names} from ({queries.ORACLE_SQL['op2_license_scan']})").fetchall())


def test_lines_stay_lines(spark):
    rows = [
        (1, "A heading\nReleased under the MIT License\nAll rights reserved\nand more", "mit-notice,all-rights"),
        (2, "This project is\nlicensed under the MIT License, they say", ""),
        (3, "licensed under the MIT.\n\nLicense", ""),
        (4, "licensed under the MIT\n\nLicense", ""),
        (5, "one. Licensed under the\nMIT License. two", "mit-notice"),
        (6, "é" * 100000 + "!" * 100000 + "; " * 50000 + " \n" * 50000 + "Licensed under the MIT license", "mit-notice"),
    ]
    got = scan_licenses(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.sentence_ids) for r in got] == [(a, c) for a, _, c in rows]
    assert sorted((str(r[0]), *r[1:]) for r in got) == sql([r[:2] for r in rows])
