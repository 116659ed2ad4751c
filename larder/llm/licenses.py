"""License scans by canonical digests.

Method: a text is brought to a canonical form (lower case, no copyright lines, no punctuation, one blank between words,
equivalent spellings made one), the form's digest is looked up among the digests of known licences by a hash join.  What is looked up
are entire texts: the document as a whole, each of its lines as a text by itself, and runs of lines that are whole blank-line-separated
blocks and have as many words as a known text, however it is wrapped (line_no is then the first line; a titled text and the text under its title are both hits).

A known text opens with one of a few words, so the full form is made only of units whose first two canonical words are
those of a known text.

The known texts are a parameter (name to texts); the default has MIT, ISC, BSD, zlib, Boost, Unlicense, Apache, CC0, the GPL, LGPL, MPL, GFDL and Artistic licences in full, and notices of others.
Their table has a fixed size and is broadcast; it is made where the driver runs.  Each row of the result is one hit, so nothing is grouped and no source or licence can be hot.

Defined cases: null and empty texts, and texts with no word left, match nothing; a text of any length is looked up whole; a form of two known
licences (a tie) is reported under the first name; a line that begins with the word copyright counts as a copyright line, also where a sentence was wrapped there; repeated rows give repeated hits; an empty table gives an empty table; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

# Spellings that count as equal, as words of the canonical form.
EQUIVALENT = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "authorisation": "authorization",
    "authorised": "authorized",
    "behaviour": "behavior",
    "cancelled": "canceled",
    "catalogue": "catalog",
    "centre": "center",
    "colour": "color",
    "favour": "favor",
    "fulfil": "fulfill",
    "initialise": "initialize",
    "licence": "license",
    "licences": "licenses",
    "licenced": "licensed",
    "merchantibility": "merchantability",
    "noncommercial": "non commercial",
    "organisation": "organization",
    "practise": "practice",
    "programme": "program",
    "recognise": "recognize",
    "sublicence": "sublicense",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
}

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\t\r \u00a0\u2018\u2019\u201c\u201d\u2013\u2014\u2022"

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n'
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n" + _AS_IS
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n"
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
)

_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
_BSD_CONDITIONS = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n",
)
_BSD = {n: [_BSD_HEAD + "".join(mark.format(i) + c for i, c in enumerate(_BSD_CONDITIONS[:n], 1)) + _WARRANTY for mark in ("{}. ", "* ")] for n in (2, 3)}
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n"
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n"
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n"
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n"
    "3. This notice may not be removed or altered from any source distribution."
)
_BOOST = (
    'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n'
    "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain.\n"
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n"
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n"
    + _AS_IS.replace("THE AUTHORS OR COPYRIGHT HOLDERS", "THE AUTHORS")
)
_APACHE_HEADER = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n'
    "http{}://www.apache.org/licenses/LICENSE-2.0\n"
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
)
_GPL_HEADER = (
    "This program is free software{}you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation{}either version {} of the License, or (at your option) any later version.\n"
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
)
_MPL_HEADER = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http{}://mozilla.org/MPL/2.0/."

# Known licence texts and notices, by SPDX-like name.
KNOWN = {
    "Apache-2.0": [
        _APACHE_HEADER.format(""),
        _APACHE_HEADER.format("s"),
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [_MIT, "MIT License\n" + _MIT, "The MIT License (MIT)\n" + _MIT, "Released under the MIT License.", "Licensed under the MIT License.", "This work is licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "ISC": [_ISC, "ISC License\n" + _ISC, "Licensed under the ISC License.", "SPDX-License-Identifier: ISC"],
    "BSD-2-Clause": [*_BSD[2], *("BSD 2-Clause License\n" + t for t in _BSD[2]), "SPDX-License-Identifier: BSD-2-Clause"],
    "Zlib": [_ZLIB, "zlib License\n" + _ZLIB, "SPDX-License-Identifier: Zlib"],
    "BSL-1.0": [_BOOST, "Boost Software License - Version 1.0 - August 17th, 2003\n" + _BOOST, "SPDX-License-Identifier: BSL-1.0"],
    "Unlicense": [_UNLICENSE, _UNLICENSE + "\nFor more information, please refer to <https://unlicense.org>", _UNLICENSE + "\nFor more information, please refer to <http://unlicense.org/>", "SPDX-License-Identifier: Unlicense"],
    "MPL-2.0": [_MPL_HEADER.format(""), _MPL_HEADER.format("s"), "SPDX-License-Identifier: MPL-2.0"],
    "BSD-3-Clause": [*_BSD[3], *("BSD 3-Clause License\n" + t for t in _BSD[3]), "Licensed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "SPDX-License-Identifier: BSD-3-Clause"],
    "GPL-3.0": [
        _GPL_HEADER.format(": ", ", ", 3),
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
        "Released under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-only",
    ],
    "GPL-2.0": [_GPL_HEADER.format("; ", "; ", 2), "This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0.", "This work has been dedicated to the public domain."],
    "All-Rights-Reserved": ["All rights reserved."],
}

# Licences whose whole texts are files beside this module, named as they are reported.
FILES = {
    "Apache-2.0": "Apache-2.0",
    "Artistic": "Artistic-1.0-Perl",
    "CC0-1.0": "CC0-1.0",
    "GFDL-1.2": "GFDL-1.2",
    "GFDL-1.3": "GFDL-1.3",
    "GPL-1": "GPL-1.0",
    "GPL-2": "GPL-2.0",
    "GPL-3": "GPL-3.0",
    "LGPL-2": "LGPL-2.0",
    "LGPL-2.1": "LGPL-2.1",
    "LGPL-3": "LGPL-3.0",
    "MPL-1.1": "MPL-1.1",
    "MPL-2.0": "MPL-2.0",
}
for _file, _name in FILES.items():
    KNOWN.setdefault(_name, []).append(files(__package__).joinpath("license_texts", f"{_file}.txt").read_text(encoding="utf-8"))

_CLASS = "".join("\\" + c if c in "\\]^-[&" else c for c in PUNCTUATION + "\n")
_COPYRIGHT_LINE = "^[ \\t]*(copyright|\\(c\\)|©)[ \\t\\r].*"


#: Words of the canonical form that a word becomes, where they are more than one.
_MORE_WORDS = {british: len(american.split()) for british, american in EQUIVALENT.items() if " " in american}


def _body(text: Column) -> Column:
    """Lower case, without copyright lines."""
    lines = F.filter(F.split(F.lower(text), "\n"), lambda x: ~F.rlike(x, F.lit(_COPYRIGHT_LINE)))
    return F.array_join(lines, "\n")


def _words(body: Column) -> Column:
    # two blanks between words, so that no replacement takes the blank that its neighbour needs
    spaced = F.concat(F.lit(" "), F.trim(F.regexp_replace(body, f"[{_CLASS}]+", "  ")), F.lit(" "))
    for british, american in EQUIVALENT.items():
        spaced = F.replace(spaced, F.lit(f" {british} "), F.lit(f" {american} "))
    return F.trim(F.replace(spaced, F.lit("  "), F.lit(" ")))


def canonical(text: Column) -> Column:
    """The canonical form, by built-in functions."""
    return _words(_body(text))


def opening(body: Column) -> Column:
    """The first one or two words of a body in canonical spelling: enough to rule out nearly every text at little cost."""
    return _words(F.regexp_extract(body, f"^[{_CLASS}]*([^{_CLASS}]+([{_CLASS}]+[^{_CLASS}]+)?)", 1))


def digest(canonical_text: Column) -> Column:
    return F.coalesce(F.sha2(canonical_text.cast("binary"), 256), F.lit(""))


def scan(df: DataFrame, known: dict[str, list[str]] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line_no (null: the whole text), license of every hit. The whole text of one line isn't reported again as a line."""
    spark = df.sparkSession
    known = KNOWN if known is None else known
    texts = spark.createDataFrame([(name, t) for name, texts in sorted(known.items()) for t in texts], "license string, text string")
    texts = texts.select("license", canonical(F.col("text")).alias("text")).where("text != ''")
    table = F.broadcast(texts.groupBy(digest(F.col("text")).alias("digest")).agg(F.min("license").alias("license")))
    openings = [r[0] for r in texts.select(opening(F.col("text"))).distinct().collect()]
    lengths = sorted(r[0] for r in texts.select(F.size(F.split("text", " "))).distinct().collect())
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    lines = rows.where(F.contains("text", F.lit("\n"))).select("key", F.posexplode(F.split("text", "\n")).alias("line_no", "unit"))
    units = rows.select("key", F.lit(None).cast("int").alias("line_no"), F.col("text").alias("unit")).unionByName(lines)
    likely = units.where(opening(_body(F.col("unit"))).isin(openings))
    own = likely.withColumn("digest", digest(canonical(F.col("unit")))).join(table, "digest").select("key", "line_no", "license")
    ran = _runs(rows, openings, lengths).withColumn("digest", digest(canonical(F.col("unit")))).join(table, "digest").where(F.col("whole") != F.col("digest"))
    return own.unionByName(ran.select("key", "line_no", "license")).select(F.col("key").alias(key), "line_no", "license")


def words_in_line(line: str) -> int:
    """How many words a line brings to the canonical form."""
    low = line.lower()
    if re.match(_COPYRIGHT_LINE, low):
        return 0
    return sum(_MORE_WORDS.get(w, 1) for w in re.findall(f"[^{_CLASS}]+", low))


def _runs(rows: DataFrame, openings: list[str], lengths: list[int]) -> DataFrame:
    """key, whole, line_no, unit: runs of two lines and more that start a block (or follow a copyright line) with known words, end where a block ends, and have as many words as a known text.

    whole: digest of the text that the run is in.  Only texts with such a start are looked into.
    """
    blank = lambda x: F.trim(F.translate(x, "\r\t", "  ")) == ""
    line = lambda i: F.coalesce(F.get("parts", i), F.lit(""))
    split = rows.where(F.contains("text", F.lit("\n"))).withColumn("parts", F.split("text", "\n"))

    def starts(x: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit("")).otherwise(line(i - 1))
        return ~blank(x) & ~F.rlike(F.lower(x), F.lit(_COPYRIGHT_LINE)) & (blank(before) | F.rlike(F.lower(before), F.lit(_COPYRIGHT_LINE))) & opening(_body(F.concat(x, F.lit("\n"), line(i + 1)))).isin(openings)

    numbered = F.transform("parts", lambda x, i: F.struct(i.cast("int").alias("i"), x.alias("x")))
    at = split.withColumn("at", F.transform(F.filter(numbered, lambda s: starts(s["x"], s["i"])), lambda s: s["i"])).where(F.size("at") > 0)
    found = at.select("key", digest(canonical(F.col("text"))).alias("whole"), "text", "at")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            keys, out = [], []
            for k, (whole, text, begins) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
                parts = text.split("\n")
                total = np.concatenate([[0], np.cumsum([words_in_line(x) for x in parts])])
                empty = np.array([not x.strip(" \r\t") for x in [*parts, ""]])
                for i in begins:
                    for n in lengths:
                        low, high = np.searchsorted(total, total[i] + n, "left"), np.searchsorted(total, total[i] + n, "right")
                        # further lines without words don't change the form: the first end of a block counts
                        for j in range(max(int(low), i + 2), int(high)):
                            if not empty[j - 1] and empty[j]:
                                keys.append(k)
                                out.append((whole, i, "\n".join(parts[i:j])))
                                break
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), *(pa.array([r[c] for r in out], t) for c, t in enumerate((pa.string(), pa.int32(), pa.large_string())))], names=["key", "whole", "line_no", "unit"])

    return found.mapInArrow(cut, f"key {rows.schema['key'].dataType.simpleString()}, whole string, line_no int, unit string")


def sql() -> str:
    """The same scan of ``documents`` in DuckDB's SQL, by full canonical forms."""
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    spaced = f"' ' || trim(regexp_replace(body, {quote('[' + _CLASS + ']+')}, '  ', 'g')) || ' '"
    for british, american in EQUIVALENT.items():
        spaced = f"replace({spaced}, ' {british} ', ' {american} ')"
    spaced = f"replace({spaced}, '  ', ' ')"
    body = f"array_to_string(list_filter(string_split(lower(t), chr(10)), lambda x: NOT regexp_matches(x, {quote(_COPYRIGHT_LINE)})), chr(10))"
    known = ", ".join(f"({quote(name)}, {quote(t)})" for name, texts in sorted(KNOWN.items()) for t in texts)
    return f"""
WITH k AS (SELECT c, min(license) AS license FROM (SELECT license, trim({spaced}) AS c FROM (SELECT license, {body} AS body FROM (VALUES {known}) AS v(license, t))) WHERE c <> '' GROUP BY c),
u AS (
  SELECT doc_id, NULL::INTEGER AS line_no, text AS t FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT doc_id, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INTEGER AS line_no, unnest(string_split(text, chr(10))) AS t FROM documents WHERE contains(text, chr(10))
)
SELECT doc_id, line_no, license FROM (SELECT doc_id, line_no, trim({spaced}) AS c FROM (SELECT doc_id, line_no, {body} AS body FROM u)) JOIN k USING (c)
"""
