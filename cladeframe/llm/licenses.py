"""License scans: passages and word windows compared to licence templates by Dice coefficient over word bigrams; native.

Every document is one row from scan to result: no shuffle, no Python. A text without one of the few
bigrams that any match must have is done after one look at its words. In what is left lines and paragraphs are compared
as a whole, template by template within its own size bounds. Then the words of the whole text, without line breaks
and comment marks, are searched for windows that match, so that notices beside other words are found too.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.llm.common import lower_ascii

THRESHOLD = 0.8

# Licence notices by SPDX identifier, in their usual public wording.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

# Titles, notices, whole texts of short licences and the openings of long ones. Apart from TEMPLATES, which the SQL is made of.
_DISCLAIMER = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD_2 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_PERMISSION = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: '
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS'
MORE_TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("Apache-2.0", "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. \"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document."),
    ("BSD-2-Clause", f"{_BSD_2} {_DISCLAIMER}"),
    ("BSD-3-Clause", f"{_BSD_2}{_BSD_3} {_DISCLAIMER}"),
    ("CC0-1.0", "The laws of most jurisdictions throughout the world automatically confer exclusive Copyright and Related Rights (defined below) upon the creator and subsequent owner(s) (each and all, an \"owner\") of an original work of authorship and/or a database (each, a \"Work\")."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    ("MIT", "MIT License"),
    ("MIT", f"{_PERMISSION}The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS} OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", f"This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. {_AS_IS} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
]


def template_bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a template, normalised as :func:`normalised` does; in order of first occurrence."""
    w = re.findall("[a-z0-9]+", text.lower())
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:])))


def size_bounds(size: int, threshold: float) -> tuple[int, int]:
    """Least and most bigrams of a passage that can reach the threshold: with at most min(a, b) in common, 2 * min / (a + b) >= t."""
    return math.ceil(size * threshold / (2 - threshold) - 1e-9), math.floor(size * (2 - threshold) / threshold + 1e-9)


def needed_bigrams(templates: list[tuple[str, str]], threshold: float) -> list[str]:
    """Bigrams of which every match has one. A match shares at least `low` of a template's n bigrams, so it has one
    of any n - low + 1 of them; those with the longest words are taken, as they are rarely found elsewhere."""
    out: set[str] = set()
    for _, text in templates:
        grams = template_bigrams(text)
        low, _ = size_bounds(len(grams), threshold)
        out.update(sorted(grams, key=lambda g: (-len(g), g))[: len(grams) - low + 1])
    return sorted(out)


def normalised(text: Column) -> Column:
    """Lower case (A-Z), runs of anything but a-z and 0-9 as one space, none at the ends."""
    return F.trim(F.regexp_replace(lower_ascii(text), "[^a-z0-9]+", " "))


def pieces(text: Column) -> tuple[Column, Column]:
    """A text's lines, and its paragraphs (between blank lines); as they are. Both hold all words in order."""
    return F.split(text, "\n"), F.split(text, "\n[ \t\r]*\n")


def bigrams(passage: Column) -> Column:
    """Distinct word bigrams of a normalised passage; none if it has one word."""
    w = F.split(passage, " ")
    return F.when(F.size(w) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))))


def bound(x: Column, f) -> Column:
    """f(x) with x worked out once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def constant(items: list[str]) -> Column:
    return F.split(F.lit("|".join(items)), "\\|")


def windows(grams: Column, known: Column, threshold: float) -> Column:
    """Matching windows of a text's word bigrams (all, in order): array of (less, first, last, license, dice), positions from 0.

    A bigram that the template has never lowers a window's coefficient, so the best windows start and end with runs of
    such bigrams, and only those are compared: all that hold a window of at most ``reach`` bigrams.
    """

    def of(t: Column) -> Column:
        hits = F.filter(F.transform(grams, lambda g, i: F.when(F.array_contains(t["grams"], g), i)), lambda i: i.isNotNull())
        n = F.size(t["grams"])

        def compared(s: Column, e: Column) -> Column:
            return bound(F.slice(grams, s + 1, e - s + 1), lambda x: bound(F.size(F.array_intersect(x, t["grams"])), lambda both: bound(2.0 * both / (F.size(F.array_distinct(x)) + n), lambda dice: F.struct((-both * dice).alias("less"), s.alias("first"), e.alias("last"), t["license"].alias("license"), dice.alias("dice")))))

        def pairs(h: Column) -> Column:
            # Each run with its first and last place and the numbers of the hits there.
            numbered = F.transform(h, lambda v, k: F.struct(v.alias("at"), k.alias("k")))
            starts = F.transform(F.filter(numbered, lambda v: F.coalesce(F.get(h, v["k"] - 1) != v["at"] - 1, F.lit(True))), lambda v: F.struct(v["at"].alias("s"), v["k"].alias("from")))
            ends = F.transform(F.filter(numbered, lambda v: F.coalesce(F.get(h, v["k"] + 1) != v["at"] + 1, F.lit(True))), lambda v: F.struct(v["at"].alias("e"), v["k"].alias("to")))
            runs = F.zip_with(starts, ends, lambda x, y: F.struct(x["s"].alias("s"), y["e"].alias("e"), x["from"].alias("from"), y["to"].alias("to")))
            # Runs are in order and apart, so of those that follow one no more than ``reach`` begin within its reach: the work grows with the text, not with its
            # square. A match has ``low`` hits at least.
            near = lambda r, x, i: F.filter(F.slice(r, i + 1, t["reach"] + 2), lambda y: (y["s"] - x["e"] <= t["reach"]) & (y["to"] - x["from"] + 1 >= t["low"]))
            return bound(runs, lambda r: F.flatten(F.transform(r, lambda x, i: F.transform(near(r, x, i), lambda y: compared(x["s"], y["e"])))))

        return F.when(F.size(F.array_intersect(grams, t["grams"])) >= t["low"], F.filter(bound(hits, pairs), lambda c: c["dice"] >= threshold)).otherwise(F.array().cast("array<struct<less:double,first:int,last:int,license:string,dice:double>>"))

    return F.flatten(F.transform(known, of))


def placed(parts: Column, more: bool = False) -> Column:
    """Normalised pieces of two words at least with the place of their first word: array of (passage, first, words). ``more``: only those of
    more than one line."""
    sized = F.transform(parts, lambda p: bound(normalised(p), lambda x: F.struct(x.alias("passage"), F.when(x == "", 0).otherwise(F.size(F.split(x, " "))).alias("words"), (p.contains("\n") if more else F.lit(True)).alias("kept"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<passage:string,first:int,words:int>>").alias("out"))
    step = lambda a, x: F.struct((a["at"] + x["words"]).alias("at"), F.when((x["words"] < 2) | ~x["kept"], a["out"]).otherwise(F.concat(a["out"], F.array(F.struct(x["passage"].alias("passage"), a["at"].alias("first"), x["words"].alias("words"))))).alias("out"))
    return F.aggregate(sized, start, step, lambda a: a["out"])


def scan(docs: DataFrame, text_col: str = "text", templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``license_matches``: array of (passage, license, dice), passages in their order, then windows in theirs.

    A passage is a line, or a paragraph of more than one line. It
    matches the template of the highest Dice coefficient of distinct word bigrams, if that is at
    least ``threshold``; ties go to the smaller identifier. Windows are runs of words of the whole text, also across lines,
    of at most (2 - threshold) / threshold times a template's bigrams, as no larger one could reach the threshold without repeated
    bigrams; runs of a template's own bigrams aren't cut. Of windows that overlap the one with the most common bigrams, times its
    coefficient, is taken, and none that overlaps a passage of the same licence. Templates with fewer than two words match nothing.
    A null or empty text has an empty array; repeated rows stay. A column named license_matches is replaced, all
    others are kept. An empty table gives an empty table.
    """
    known = [(i, t) for i, t in (TEMPLATES + MORE_TEMPLATES if templates is None else templates) if template_bigrams(t)]
    none = F.array().cast("array<struct<passage:string,license:string,dice:double>>")
    if not known:
        return docs.withColumn("license_matches", none)
    bounds = [size_bounds(len(template_bigrams(t)), threshold) for _, t in known]
    least, most = min(a for a, _ in bounds), max(b for _, b in bounds)
    needed = needed_bigrams(known, threshold)
    must = constant(needed)
    # The longer word of every needed bigram: a text without any of them is done before its bigrams are made.
    words_needed = constant(sorted({max(g.split(" "), key=lambda w: (len(w), w)) for g in needed}))
    reach = lambda t: size_bounds(len(re.findall("[a-z0-9]+", t.lower())) - 1, threshold)[1]
    rows = F.array(*(F.struct(F.lit(i).alias("license"), constant(template_bigrams(t)).alias("grams"), F.lit(low).alias("low"), F.lit(high).alias("high"), F.lit(reach(t)).alias("reach")) for (i, t), (low, high) in zip(known, bounds)))

    def best(x: Column) -> Column:
        size = F.size(x["grams"])
        found = F.transform(rows, lambda t: F.struct((-F.when(size.between(t["low"], t["high"]), 2.0 * F.size(F.array_intersect(x["grams"], t["grams"])) / (size + F.size(t["grams"]))).otherwise(F.lit(0.0))).alias("less"), t["license"].alias("license")))
        return bound(F.array_min(found), lambda top: F.struct(x["passage"].alias("passage"), x["first"].alias("first"), (x["first"] + x["words"] - 1).alias("last"), top["license"].alias("license"), (-top["less"]).alias("dice")))

    def whole(parts: Column) -> Column:
        long_enough = F.filter(parts, lambda p: p["words"] > least)
        sized = F.filter(F.transform(long_enough, lambda p: F.struct(p["passage"].alias("passage"), p["first"].alias("first"), p["words"].alias("words"), bigrams(p["passage"]).alias("grams"))), lambda x: F.size(x["grams"]).between(least, most) & F.arrays_overlap(x["grams"], must))
        return F.filter(F.transform(sized, best), lambda x: x["dice"] >= threshold)

    def apart(x: Column, y: Column) -> Column:
        return (x["last"] < y["first"]) | (y["last"] < x["first"])

    text = F.col(text_col)
    lines, paragraphs = pieces(text)

    def found(w: Column, grams: Column) -> Column:
        passages = F.concat(whole(placed(lines)), whole(placed(paragraphs, more=True)))
        chosen = F.aggregate(F.array_sort(windows(grams, rows, threshold)), F.array().cast("array<struct<less:double,first:int,last:int,license:string,dice:double>>"), lambda a, c: F.when(F.exists(a, lambda y: ~apart(c, y)), a).otherwise(F.concat(a, F.array(c))))
        return bound(passages, lambda ps: F.concat(
            F.transform(ps, lambda x: F.struct(x["passage"], x["license"], x["dice"])),
            F.transform(
                F.array_sort(F.transform(F.filter(chosen, lambda c: ~F.exists(ps, lambda y: (y["license"] == c["license"]) & ~apart(c.withField("last", c["last"] + 1), y))), lambda c: F.struct(c["first"], c["last"], c["license"], c["dice"]))),
                lambda c: F.struct(F.array_join(F.slice(w, c["first"] + 1, c["last"] - c["first"] + 2), " ").alias("passage"), c["license"].alias("license"), c["dice"].alias("dice")),
            ),
        ))

    def looked(w: Column) -> Column:
        made = F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))
        return F.when(F.arrays_overlap(w, words_needed) & (F.size(w) > 1), bound(made, lambda g: F.when(F.arrays_overlap(g, must), found(w, g)).otherwise(none))).otherwise(none)

    return docs.withColumn("license_matches", F.coalesce(bound(F.split(normalised(F.coalesce(text, F.lit(""))), " "), looked), none))


ORACLE_SQL = """
WITH p AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
lines AS (
  SELECT r, doc_id, unnest(list_concat(string_split(t, chr(10)), list_filter(regexp_split_to_array(t, '\\n[ \\t\\r]*\\n'), lambda x: contains(x, chr(10))))) AS raw FROM p),
norm AS (
  SELECT r, doc_id, row_number() OVER () AS q, string_split(trim(regexp_replace(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM lines),
grams AS (
  SELECT r, doc_id, q, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM norm WHERE len(w) > 1),
templates AS (SELECT * FROM (VALUES {templates}) AS v(license, g)),
dice AS (
  SELECT r, q, license, 2.0 * len(list_intersect(x.g, t.g)) / (len(x.g) + len(t.g)) AS dice
  FROM grams x JOIN templates t ON len(x.g) * 3 >= len(t.g) AND len(t.g) * 3 >= len(x.g)),
best AS (
  SELECT r, q, max(dice) AS dice, min_by(license, (-dice, license)) AS license FROM dice WHERE dice >= {threshold} GROUP BY r, q),
m AS (
  SELECT r, count(*) AS n, min_by(license, (-dice, license)) AS license, max(dice) AS dice, array_to_string(list_sort(list_distinct(list(license))), ' ') AS licenses FROM best GROUP BY r)
SELECT p.doc_id, coalesce(n, 0)::BIGINT AS n_matches, license, dice::DOUBLE AS dice, coalesce(licenses, '') AS licenses FROM p LEFT JOIN m USING (r)
"""


def oracle_sql(threshold: float = THRESHOLD) -> str:
    rows = ", ".join("(" + f"'{i}', [" + ", ".join(f"'{g}'" for g in template_bigrams(t)) + "])" for i, t in TEMPLATES)
    return ORACLE_SQL.format(templates=rows, threshold=threshold)
