"""Operator 3 [native]: licence scan by the Dice coefficient over word bigrams.

A text is cut into units: its lines, its paragraphs (between blank lines), the sentences of both and
itself.  A sentence ends at a full stop, exclamation mark, question mark or semicolon before a blank.  Units and
templates are normalised alike (lower case, words of letters and digits) and compared as sets of word
bigrams; a unit matches a template at a Dice coefficient of ``threshold`` or more.  Since two sets of
sizes m and n have at most 2 min(m, n) / (m + n), a template can only match units whose number of
bigrams lies between n t / (2 - t) and n (2 - t) / t: units outside the bounds of all templates are
dropped by a count of blanks before any word is cut, and each other unit meets only the templates
whose bounds hold it.  Before that, texts and units go that lack all of the words of which a match
must have one.

What is not found: a notice inside a longer sentence, unless a template is worded like that, and whole
licences of more than 265 bigrams, which are known by their paragraphs; ``templates`` takes others.

Plan: column functions only and no Python; templates are literals; one scan, in which nearly all
units go; what is left is a grouped maximum, partial in each task.

Defined results: null and empty texts match nothing; rows that repeat a doc_id (null ids too)
are one document; ties between units are one best value; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents

_MIT = [
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
]
_BSD = [
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
]
#: Fixed values, with SPDX names: short notices by which works state their licence, standard paragraphs
#: that only that licence (or its family) has, and the full texts of MIT and BSD.  A template has under 266
#: bigrams: then no unit of more than 400 distinct words, so of 400 bigrams or more, can reach 0.8 with it,
#: which lets the SQL leave such units out.  Longer licences go by their paragraphs.
_NOTICES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "2. Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
        *_MIT,
        " ".join(_MIT),
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        _BSD[3],
        " ".join(_BSD),
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Released into the public domain under CC0 1.0.", "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work."],
    "Proprietary": ["All rights reserved."],
}
#: Names of licences as sentences give them, and tags of the SPDX list.
_NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "MIT": ["MIT License"],
    "GPL-3.0": ["GNU General Public License v3.0", "GNU General Public License, version 3", "GPLv3 License"],
    "BSD-3-Clause": ["BSD 3-Clause License"],
    "MPL-2.0": ["Mozilla Public License, v. 2.0", "Mozilla Public License 2.0"],
    "CC0-1.0": ["CC0 1.0 Universal License"],
}
_TAGS = {
    "Apache-2.0": ["Apache-2.0"],
    "MIT": ["MIT"],
    "GPL-3.0": ["GPL-3.0-only", "GPL-3.0-or-later"],
    "BSD-3-Clause": ["BSD-3-Clause"],
    "MPL-2.0": ["MPL-2.0"],
    "CC-BY-4.0": ["CC-BY-4.0"],
    "CC-BY-NC-4.0": ["CC-BY-NC-4.0"],
    "CC-BY-SA-4.0": ["CC-BY-SA-4.0"],
    "CC0-1.0": ["CC0-1.0"],
}
_FRAMES = ["This project is licensed under the {}.", "This software is released under the {}.", "This project is licensed under the terms of the {}.", "This project is licensed under the {} - see the LICENSE file for details."]
TEMPLATES = {name: [*notices, *(frame.format(n) for n in _NAMES.get(name, ()) for frame in _FRAMES), *(f"SPDX-License-Identifier: {t}" for t in _TAGS.get(name, ()))] for name, notices in _NOTICES.items()}
THRESHOLD = 0.8
#: Marks the end of a sentence.
END = "\x01"


def words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def bigrams(text: str) -> list[str]:
    w = words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:])))


def template_sets(templates: dict[str, list[str]]) -> list[tuple[str, list[str]]]:
    return [(name, g) for name, texts in templates.items() for t in texts if (g := bigrams(t))]


def telling_words(sets: list[tuple[str, list[str]]], threshold: float) -> list[str]:
    """Words of which any matching unit has one.

    A match misses at most a share 1 - t / (2 - t) of its template's bigrams, so it has one of any
    larger part of them.  Long words that many templates share are taken, one by one, until of each
    template such a part holds one of them.
    """
    left = [set(g) for _, g in sets]
    need = [int(len(g) * (1 - threshold / (2 - threshold)) + 1e-9) + 1 for _, g in sets]
    out: set[str] = set()
    while any(n > 0 for n in need):
        gain: dict[str, float] = {}
        for g, n in zip(left, need):
            found: dict[str, int] = {}
            for x in g if n > 0 else ():
                for w in set(x.split()):
                    found[w] = found.get(w, 0) + 1
            for w, k in found.items():
                gain[w] = gain.get(w, 0.0) + min(k, n) * max(len(w) - 3, 0.01 * len(w))
        word = max(gain, key=lambda w: (gain[w], w))
        out.add(word)
        for i, g in enumerate(left):
            gone = {x for x in g if word in x.split()}
            need[i] -= len(gone)
            g -= gone
    return sorted(out)


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, license, dice): the best coefficient."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    sets = template_sets(TEMPLATES if templates is None else templates)
    if not sets:
        return docs.sparkSession.createDataFrame([], "doc_id long, license string, dice double")
    ratio = (2 - threshold) / threshold * (1 + 1e-9)  # never below by rounding
    least, most = min(len(g) for _, g in sets) / ratio, max(len(g) for _, g in sets) * ratio
    literal = F.array(*[F.struct(F.lit(n).alias("name"), F.array(*map(F.lit, g)).alias("grams"), F.lit(len(g)).alias("n")) for n, g in sets])
    # ends of sentences are marked, and all but words, marks and \n becomes single blanks
    marked = F.regexp_replace(F.concat(F.lower(F.col("text").cast("string")), F.lit(" ")), "[.!?;]+[\"')\\]]*([ \t\r\n])", END + "$1")
    clean = F.regexp_replace(marked, "[^a-z0-9\n\x01]+", " ")
    plain = lambda u: F.translate(u, "\n" + END, "  ")
    several = lambda u: u.contains("\n")
    lines = F.transform(F.filter(F.split("clean", "\n"), lambda u: u.contains(END)), plain)
    paragraphs = F.filter(F.split("clean", "\n *\n"), several)
    sentences = F.flatten(F.transform(paragraphs, lambda u: F.split(F.translate(u, "\n", " "), END)))
    whole = F.when(several(F.col("clean")), F.array(plain("clean"))).otherwise(F.array())
    units = F.concat(F.split("clean", "[\n\x01]"), lines, F.transform(paragraphs, plain), sentences, whole)
    # outer: else Catalyst adds a filter on the array's size and cuts each text twice
    tell = telling_words(sets, threshold)
    low = F.lower(F.col("text").cast("string"))
    held = [low.contains(w) if len(w) > 3 else low.rlike(f"(^|[^a-z0-9]){w}([^a-z0-9]|$)") for w in tell]
    rows = docs.filter(reduce(or_, held)).select(F.col("doc_id").cast("long").alias("doc_id"), clean.alias("clean"))
    rows = rows.select("doc_id", F.explode_outer(units).alias("unit")).withColumn("unit", F.trim("unit"))
    # blanks between words are single but where a line or sentence ends: an upper bound on the number of bigrams
    rows = rows.filter(F.length("unit") - F.length(F.replace("unit", F.lit(" "), F.lit(""))) >= least)
    rows = rows.filter(F.arrays_overlap(F.split("unit", " "), F.array(*map(F.lit, tell))))
    # a long unit has too many bigrams unless it repeats itself: the distinct words at its head, less
    # one and less a word that may be cut, are a lower bound on its distinct bigrams
    rows = rows.filter(F.size(F.array_distinct(F.split(F.substring("unit", 1, 6000), " "))) - 2 <= most)
    rows = rows.select("doc_id", F.filter(F.split("unit", " "), lambda w: w != "").alias("w"))
    grams = F.array_distinct(F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)))
    rows = rows.select("doc_id", grams.alias("g"))
    fit = F.filter(literal, lambda t: (F.size("g") * ratio >= t["n"]) & (F.size("g") <= t["n"] * ratio))
    dice = F.transform(fit, lambda t: F.struct(t["name"].alias("license"), (2.0 * F.size(F.array_intersect(t["grams"], F.col("g"))) / (t["n"] + F.size("g"))).alias("dice")))
    hits = rows.select("doc_id", F.explode_outer(dice).alias("b")).filter(F.col("b.dice") >= threshold)
    return hits.groupBy("doc_id", "b.license").agg(F.bround(F.max("b.dice"), 6).alias("dice"))


def op3_licenses(spark, sf_dir):
    return scan(documents(spark, sf_dir))


def op3_sql(templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> str:
    """The same over DuckDB, without pruning: of the bounds only the 400 words that no match can have."""
    rows = ", ".join(f"({i}, '{n}', [{', '.join(repr(x) for x in g)}])" for i, (n, g) in enumerate(template_sets(TEMPLATES if templates is None else templates)))
    return f"""
with t(tid, license, grams) as (values {rows}),
d as (select row_number() over () as rid, doc_id, regexp_replace(regexp_replace(lower(text) || ' ', '[.!?;]+["'')\\]]*([ \t\r\n])', chr(1) || '\\1', 'g'), '[^a-z0-9\n\x01]+', ' ', 'g') as c from documents where text is not null),
p as (select rid, doc_id, p from (select rid, doc_id, unnest(regexp_split_to_array(c, '\n *\n')) as p from d) where contains(p, chr(10))),
u as (select distinct rid, doc_id, trim(replace(unit, chr(1), ' ')) as unit from (
  select rid, doc_id, unnest(string_split(c, chr(10))) as unit from d
  union all select rid, doc_id, unnest(string_split(replace(c, chr(10), chr(1)), chr(1))) from d
  union all select rid, doc_id, replace(p, chr(10), ' ') from p
  union all select rid, doc_id, unnest(string_split(replace(p, chr(10), ' '), chr(1))) from p
  union all select rid, doc_id, replace(c, chr(10), ' ') from d where contains(c, chr(10)))),
w as (select rid, doc_id, unit, list_filter(string_split(unit, ' '), lambda x: x <> '') as w from u),
g as (select rid, doc_id, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as g from w where len(w) > 1 and len(list_distinct(w)) <= 400),
m as (select rid, doc_id, license, 2.0 * len(list_intersect(g, grams)) / (len(g) + len(grams)) as dice from g, t)
select doc_id, license, cast(round_even(max(dice), 6) as double) as dice
from m where dice >= {threshold} group by doc_id, license
"""
