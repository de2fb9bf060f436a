"""Licence recognition by sentences and rules, with DataFrame functions only.

1. A text is split into sentences: at line ends, and after ``.``, ``!``, ``?`` or ``;`` before white space. A line end inside a
   wrapped sentence does not count: lines that are no known sentence by themselves are joined up to the next known line, line
   without a letter or digit, list mark, ``:`` at a line's end, or end of a sentence. What marks a line as a comment is no letter or
   digit and goes in step 2. Where lines joined in this way are no known sentence, the last of them may be: leading lines drop out
   one by one, so that a line of other words above a wrapped sentence does not hide it. No known sentence has more lines than words.
2. A sentence is normalised: lower case, everything but letters and digits to one space, trimmed; a sentence that begins with
   ``copyright`` and a year, or with ``copyright c``, becomes ``copyright holder``.
3. Known sentences map to identifiers; the others drop out.
4. The document's identifier sequence is held against the rules in order. A rule is a run of identifiers; where it
   matches, it is consumed, so that a later, shorter rule does not find the same sentences again.

A text without any ANCHOR cannot hold a known sentence (the constructor checks that each holds one) and skips the split.
Null and empty texts find nothing. Repeated rows stay. Sentences of any length are compared whole. Only the two named columns of the
input are read: others do not matter, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import plain

#: Sentences of public licences and notices, by identifier.
SENTENCES: dict[str, tuple[str, ...]] = {
    "copyright": ("Copyright holder",),
    "reserved": ("All rights reserved.",),
    "mit-title": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "mit-notice": ("Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "SPDX-License-Identifier: MIT"),
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    "mit-condition": ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",),
    "as-is": (
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ),
    "isc-grant": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "isc-notice": ("Licensed under the ISC License.", "SPDX-License-Identifier: ISC"),
    "apache-notice": (
        "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\");", "Released under the Apache License, Version 2.0.",
        "This project is licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0",
    ),
    "apache-comply": ("you may not use this file except in compliance with the License.",),
    "apache-copy": ("You may obtain a copy of the License at",),
    "bsd-grant": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",),
    "bsd-source": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",),
    "bsd-binary": ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",),
    "bsd-endorse": ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",),
    "bsd2-notice": ("SPDX-License-Identifier: BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    "bsd3-notice": ("SPDX-License-Identifier: BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    "gpl-free": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "gpl3-notice": (
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "Released under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "gpl2-notice": ("This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"),
    "lgpl3-notice": ("This work is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only"),
    "agpl3-notice": ("This work is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"),
    "mpl-notice": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "cc0-notice": ("Licensed under CC0 1.0.", "This work is dedicated to the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"),
    "cc-by-notice": ("Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-sa-notice": ("Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc-by-nc-notice": ("Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by-nd-notice": ("Licensed under CC BY-ND 4.0.", "This work is licensed under CC BY-ND 4.0."),
    "cc-by-nc-sa-notice": ("Licensed under CC BY-NC-SA 4.0.", "This work is licensed under CC BY-NC-SA 4.0."),
    "cc-by-nc-nd-notice": ("Licensed under CC BY-NC-ND 4.0.", "This work is licensed under CC BY-NC-ND 4.0."),
    "unlicense": ("This is free and unencumbered software released into the public domain.",),
    "unlicense-dedicate": ("In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",),
    "bsd-as-is": (
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ),
    "apache-title": ("Apache License",),
    "apache-as-is": ("Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",),
    "apache-see": ("See the License for the specific language governing permissions and limitations under the License.",),
    "apache-copyright": (
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    ),
    "gpl-copy": ("Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",),
    "gpl-title": ("GNU GENERAL PUBLIC LICENSE",),
    "gpl3-body": ("The GNU General Public License is a free, copyleft license for software and other kinds of works.",),
    "gpl2-body": ("The licenses for most software are designed to take away your freedom to share and change it.",),
    "gpl-redistribute": ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;",),
    "gpl2-or-later": ("either version 2 of the License, or (at your option) any later version.",),
    "gpl-without": ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",),
    "gpl-implied": ("without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",),
    "gpl-details": ("See the GNU General Public License for more details.",),
    "gpl-received": ("You should have received a copy of the GNU General Public License along with this program.",),
    "lgpl-title": ("GNU LESSER GENERAL PUBLIC LICENSE",),
    "lgpl3-body": ("This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",),
    "lgpl3-free": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "lgpl-redistribute": ("you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;",),
    "lgpl21-or-later": ("either version 2.1 of the License, or (at your option) any later version.",),
    "agpl-title": ("GNU AFFERO GENERAL PUBLIC LICENSE",),
    "agpl3-body": ("The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",),
    "agpl3-free": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "mpl-title": ("Mozilla Public License Version 2.0",),
    "mpl-grant": ("Each Contributor hereby grants You a world-wide, royalty-free, non-exclusive license:",),
    "cc0-rights": ("A Work made available under CC0 may be protected by copyright and related or neighboring rights (\"Copyright and Related Rights\").",),
    "cc0-deed": (
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law.",
    ),
}

#: Rules in order: a licence and the run of sentences that shows it; longer runs first.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", ("mit-title", "copyright", "reserved", "mit-grant", "mit-condition", "as-is")),
    ("MIT", ("mit-title", "copyright", "mit-grant", "mit-condition", "as-is")),
    ("MIT", ("mit-grant", "mit-condition", "as-is")),
    ("ISC", ("copyright", "isc-grant", "as-is")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache-notice", "apache-comply", "apache-copy", "apache-as-is", "apache-see")),
    ("Apache-2.0", ("apache-notice", "apache-comply", "apache-copy")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-without", "gpl-implied", "gpl-details", "gpl-received")),
    ("GPL-2.0-or-later", ("gpl-redistribute", "gpl2-or-later", "gpl-without", "gpl-implied", "gpl-details", "gpl-received")), ("GPL-2.0-or-later", ("gpl-redistribute", "gpl2-or-later")),
    ("LGPL-2.1-or-later", ("lgpl-redistribute", "lgpl21-or-later")), ("LGPL-3.0-or-later", ("lgpl3-free",)), ("AGPL-3.0-or-later", ("agpl3-free",)),
    ("GPL-3.0", ("gpl-title", "gpl-copy", "gpl3-body")), ("GPL-2.0", ("gpl-title", "gpl-copy", "gpl2-body")), ("LGPL-3.0", ("lgpl-title", "gpl-copy", "lgpl3-body")), ("AGPL-3.0", ("agpl-title", "gpl-copy", "agpl3-body")),
    ("Apache-2.0", ("apache-title", "apache-copyright")), ("MPL-2.0", ("mpl-title", "mpl-grant")), ("Unlicense", ("unlicense", "unlicense-dedicate")),
    ("GPL-3.0", ("gpl3-body",)), ("LGPL-3.0", ("lgpl3-body",)), ("AGPL-3.0", ("agpl3-body",)), ("Apache-2.0", ("apache-copyright",)), ("MPL-2.0", ("mpl-grant",)), ("CC0-1.0", ("cc0-rights",)), ("CC0-1.0", ("cc0-deed",)),
    ("MIT", ("mit-grant",)), ("ISC", ("isc-grant",)), ("Apache-2.0", ("apache-notice",)), ("MIT", ("mit-notice",)), ("MIT", ("mit-title",)), ("ISC", ("isc-notice",)),
    ("BSD-2-Clause", ("bsd2-notice",)), ("BSD-3-Clause", ("bsd3-notice",)),
    ("GPL-3.0-or-later", ("gpl-free",)), ("GPL-3.0", ("gpl3-notice",)), ("GPL-2.0", ("gpl2-notice",)), ("LGPL-3.0", ("lgpl3-notice",)), ("AGPL-3.0", ("agpl3-notice",)),
    ("MPL-2.0", ("mpl-notice",)), ("CC0-1.0", ("cc0-notice",)), ("CC-BY-4.0", ("cc-by-notice",)), ("CC-BY-SA-4.0", ("cc-by-sa-notice",)), ("CC-BY-NC-4.0", ("cc-by-nc-notice",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-notice",)), ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-notice",)), ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd-notice",)), ("Unlicense", ("unlicense",)),
    ("all-rights-reserved", ("copyright", "reserved")), ("all-rights-reserved", ("reserved",)),
)

ANCHORS = ("licen", "copyright", "reserved", "permission", "redistribution", "warranty", "public domain")

SPLIT = r"\n|(?<=[.!?;])\s+"
OTHER = r"[^\p{L}\p{N}]+"
#: List marks with a bracket (``1.`` ends a sentence anyway), and ends that no wrapped sentence goes across.
MARK = r"(?m)^[^\p{L}\p{N}\n]*(?:\d{1,2}|\p{L}|[ivx]{2,4})\)\s+"
END = r"(?<=[.!?;])\s+|(?<=:)[^\S\n]*\n"
HOLDER = r"^copyright (c |\d{4})"


def normal(sentence: str) -> str:
    """The normalised form of a sentence, as ``_normal`` makes it of columns."""
    text = re.sub(r"[\W_]+", " ", sentence.lower()).strip()
    return "copyright holder" if re.match(HOLDER, text) else text


def _normal(sentence: Column) -> Column:
    return _held(F.trim(F.regexp_replace(F.lower(sentence), OTHER, " ")))


def _held(text: Column) -> Column:
    return F.when(text.rlike(HOLDER), F.lit("copyright holder")).otherwise(text)


@dataclass(frozen=True)
class Rulebook:
    sentences: tuple[tuple[str, tuple[str, ...]], ...] = tuple(SENTENCES.items())
    rules: tuple[tuple[str, tuple[str, ...]], ...] = RULES
    anchors: tuple[str, ...] = ANCHORS

    def __post_init__(self) -> None:
        for text in self.known:
            if not any(a in text for a in self.anchors):
                raise ValueError(f"no anchor in {text!r}")

    @property
    def known(self) -> dict[str, str]:
        return {normal(part): name for name, texts in self.sentences for text in texts for part in re.split(SPLIT, text) if any(a in normal(part) for a in self.anchors) or part == text}


def sequence(text: Column, book: Rulebook = Rulebook()) -> Column:
    """The identifiers of a text's known sentences, in order."""
    ids = F.create_map(*(F.lit(x) for pair in book.known.items() for x in pair))
    lines = F.transform(F.split(F.regexp_replace(F.regexp_replace(text, MARK, "\n\n"), END, "\n\n"), "\n"), _normal)
    apart = F.transform(lines, lambda s: F.when((s == "") | F.try_element_at(ids, s).isNotNull(), F.concat(F.lit("\n"), s, F.lit("\n"))).otherwise(s))
    most = max(text.count(" ") + 1 for text in book.known)

    def sentence(joined: Column) -> Column:
        """The identifier of lines joined by a mark, or of the most of the last of them that are known."""
        text = F.trim(joined, F.lit("\x1f"))
        parts = F.split(text, "\x1f")
        n = F.size(parts)
        last = F.transform(F.sequence(F.greatest(F.lit(2), n - most + 1), n), lambda k: F.try_element_at(ids, _held(F.array_join(F.slice(parts, k, n), " "))))
        rest = F.when((n > 1) & text.rlike(some), F.try_element_at(F.filter(last, lambda x: x.isNotNull()), F.lit(1)))
        return F.coalesce(F.try_element_at(ids, _held(F.replace(text, F.lit("\x1f"), F.lit(" ")))), rest)

    some = "|".join(a.replace(" ", "[ \x1f]") for a in book.anchors)
    found = F.filter(F.transform(F.split(F.array_join(apart, "\x1f"), "\n"), sentence), lambda x: x.isNotNull())
    empty = F.array().cast("array<string>")
    anchors = "|".join(a.replace(" ", OTHER) for a in book.anchors)
    return F.when(F.lower(text).rlike(anchors), found).otherwise(empty)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", book: Rulebook = Rulebook()) -> DataFrame:
    """One row for each document with a known licence sentence: the id, ``sentence_ids`` in order, ``licenses`` (of the rules
    that matched, in the order of the rules, each once) and ``n_unmatched`` (known sentences that no rule took)."""
    seen = df.select(F.col(plain(id_col)), sequence(F.col(plain(text_col)), book).alias("sentence_ids")).filter(F.size("sentence_ids") > 0)
    # identifiers are written as "(id)"; a matched run becomes "-"
    steps = seen.withColumn("__left", F.concat(F.lit("("), F.array_join("sentence_ids", ")("), F.lit(")"))).withColumn("__found", F.array().cast("array<string>"))
    left, found = F.col("__left"), F.col("__found")
    pairs = F.struct(left.alias("left"), found.alias("found"))
    rules = F.array(*(F.struct(F.lit(name).alias("name"), F.lit("".join(f"({i})" for i in run)).alias("run")) for name, run in book.rules))
    done = F.aggregate(
        rules, pairs,
        lambda acc, rule: F.struct(
            F.replace(acc["left"], rule["run"], F.lit("-")).alias("left"),
            F.when(F.contains(acc["left"], rule["run"]), F.array_append(acc["found"], rule["name"])).otherwise(acc["found"]).alias("found"),
        ),
    )
    return steps.select(plain(id_col), "sentence_ids", done.alias("__done")).select(
        plain(id_col), "sentence_ids", F.array_distinct("__done.found").alias("licenses"), F.regexp_count("__done.left", F.lit(r"\(")).cast("long").alias("n_unmatched")
    )
