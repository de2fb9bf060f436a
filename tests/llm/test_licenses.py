"""Licence sentences and rules."""

import textwrap

from tidefold.llm import licenses

MIT = """MIT License

Copyright (c) 2020 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""

CASES = {
    1: ("Some prose. Licensed under the Apache License,  Version 2.0!", ["Apache-2.0"], 0),
    2: (MIT, ["MIT"], 0),
    3: ("Licensed under CC BY-NC 4.0.\nAll rights reserved.", ["CC-BY-NC-4.0", "all-rights-reserved"], 0),
    4: ("The licence was granted. We talked about copyright and reserved seats.", None, 0),
    5: ("", None, 0),
    6: (None, None, 0),
    7: ("x " * 200_000 + "\nReleased under the MIT License.\n" + "y " * 200_000, ["MIT"], 0),
    8: ("© 2021\nCopyright 2021 Somebody\nnothing else", [], 1),
    9: ("RELEASED UNDER THE MIT LICENSE. released under the mit license.", ["MIT"], 0),
}


def test_cases(spark):
    df = spark.createDataFrame([(k, v[0], "x", 1) for k, v in CASES.items()] + [(None, CASES[1][0], "x", 1)], "doc_id long, text string, licenses string, sentence_ids int")
    got = {r.doc_id: (r.licenses, r.n_unmatched) for r in licenses.scan(df).collect()}
    want = {k: (v[1], v[2]) for k, v in CASES.items() if v[1] is not None}
    assert got == want | {None: (["Apache-2.0"], 0)}


def test_known_sentences_find_themselves(spark):
    df = spark.createDataFrame([(k, t) for k, (_, ts) in enumerate(licenses.SENTENCES.items()) for t in ts], "doc_id long, text string")
    names = list(licenses.SENTENCES)
    for r in licenses.scan(df).collect():
        assert names[r.doc_id] in r.sentence_ids
    assert licenses.scan(df.limit(0)).count() == 0


def test_wrapped(spark):
    """Licence texts in their usual form: wrapped, as comments, with list marks."""
    said = {name: texts[0] for name, texts in licenses.SENTENCES.items()}

    def wrap(names, width, prefix="", between="\n\n", marks=None):
        parts = [textwrap.fill((marks[k] if marks else "") + said[n], width) for k, n in enumerate(names)]
        return "\n".join(prefix + line for line in between.join(parts).split("\n"))

    mit, bsd = ("mit-grant", "mit-condition", "as-is"), ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")
    head = "Copyright (c) 2020, Jane Doe\n"
    cases = [
        ("MIT License\n\n" + head + "\n" + wrap(mit, 72), ["MIT"], 0),
        (head + wrap(mit, 78, " * "), ["MIT"], 1),
        (head + "All rights reserved.\n\n" + wrap(bsd, 75, "# ", marks=("", "1. ", "2. ", "3. ")), ["BSD-3-Clause", "all-rights-reserved"], 0),
        (head + wrap(bsd[:3], 70, "// ", "\n", ("", "* ", "* ")), ["BSD-2-Clause"], 1),
        (wrap(bsd[:3], 70, "", "\n", ("", "(a) ", "b) ")), ["BSD-2-Clause"], 0),
        (head + "\r\n" + wrap(("isc-grant", "as-is"), 70).replace("\n", "\r\n"), ["ISC"], 0),
        (wrap(("gpl-free",), 60), ["GPL-3.0-or-later"], 0),
        ("This is free and unencumbered software released into the public\ndomain.", ["Unlicense"], 0),
        ("# SPDX-License-Identifier: MIT\nimport this\nAll rights reserved.", ["MIT", "all-rights-reserved"], 0),
    ]
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: (r.licenses, r.n_unmatched) for r in licenses.scan(df).collect()}
    assert got == {k: c[1:] for k, c in enumerate(cases)}


def test_bodies_and_lines_above(spark):
    apache = """   Copyright 2020 Some One

   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License."""
    gpl2 = """ * frobnicate - does things
 * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; either version 2 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details."""
    gpl3 = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.

                            Preamble

  The GNU General Public License is a free, copyleft license for
software and other kinds of works."""
    hidden = "My fine project, by me\nPermission is hereby granted, free of charge, to any person obtaining a copy\n" + """of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
    mpl = "Mozilla Public License Version 2.0\n==================================\n\n2.1. Grants\n\nEach Contributor hereby grants You a world-wide, royalty-free,\nnon-exclusive license:\n"
    plain = "No licence here.\n" + "just words without an end\n" * 3000 + "The MIT Licence is not meant."
    texts = {"apache": apache, "gpl2": gpl2, "gpl3": gpl3, "hidden": hidden, "mpl": mpl, "plain": plain}
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id string, text string")).collect()}
    assert {k: r.licenses for k, r in got.items()} == {"apache": ["Apache-2.0"], "gpl2": ["GPL-2.0-or-later"], "gpl3": ["GPL-3.0"], "hidden": ["MIT"], "mpl": ["MPL-2.0"]}
    assert "apache-see" in got["apache"].sentence_ids and "gpl-details" in got["gpl2"].sentence_ids
