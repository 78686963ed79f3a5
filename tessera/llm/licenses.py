"""Licence scan: Dice coefficient over word bigrams against licence templates.

Texts, each of their lines and runs of consecutive words anywhere in them are
normalised to lower-case words and compared with templates that their size
allows: with a coefficient of ``t`` or more, the smaller of two bigram sets has
at least t / (2 - t) times the larger one's size. All steps are DataFrame
expressions.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Full texts of licences, a file for each SPDX id.
TEXTS = Path(__file__).with_name("license_texts")
#: Identifiers of the `SPDX-License-Identifier:` line.
SPDX_IDS = "MIT ISC Zlib Unlicense BSL-1.0 Apache-2.0 BSD-2-Clause BSD-3-Clause MPL-2.0 EPL-2.0 CC0-1.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later".split()
CC_PARTS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
CC_VERSIONS = {"2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}


def creative_commons() -> dict[str, str]:
    """Notices of the CC licences: the short and the long name and the SPDX line."""
    out = {}
    for part, name in CC_PARTS.items():
        for version, port in CC_VERSIONS.items():
            key = f"CC-{part}-{version}"
            out[f"{key}/short"] = f"Licensed under CC {part} {version}."
            out[f"{key}/notice"] = f"This work is licensed under a Creative Commons {name} {version} {port} License."
            out[f"{key}/spdx"] = f"SPDX-License-Identifier: {key}"
    return out


def gnu(name: str, key: str, version: str) -> dict[str, str]:
    """Header and short notice of a GNU licence."""
    return {
        f"{key}/notice": f"This program is licensed under the GNU {name} version {version}.",
        f"{key}/header": (
            f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. "
            f"This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. "
            f"You should have received a copy of the GNU {name} along with this program. If not, see <https://www.gnu.org/licenses/>."
        ),
    }


#: Notices, headers and full texts of public licences, by SPDX id.
TEMPLATES = {
    "MIT/notice": "Released under the MIT License.",
    "MIT/licensed": "This project is licensed under the terms of the MIT license.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "Apache-2.0/notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0/notice": "This program is licensed under the GNU General Public License version 3.",
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "BSD-3-Clause/notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "MPL-2.0/notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0/notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0/notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "reserved": "All rights reserved.",
    "BSD-2-Clause/notice": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause/licensed": "Licensed under the BSD 3-Clause License.",
    "ISC/notice": "Released under the ISC License.",
    "Zlib/notice": "Released under the zlib License.",
    "Unlicense/notice": "Released under the Unlicense into the public domain.",
    "BSL-1.0/notice": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    "EPL-2.0/notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
}
TEMPLATES |= {k: v for k, v in creative_commons().items() if k not in TEMPLATES}
for _name, _key, _version in (("General Public License", "GPL-2.0", "2"), ("Lesser General Public License", "LGPL-2.1", "2.1"), ("Lesser General Public License", "LGPL-3.0", "3"), ("Affero General Public License", "AGPL-3.0", "3")):
    TEMPLATES |= gnu(_name, _key, _version)
TEMPLATES |= {f"{k}/spdx": f"SPDX-License-Identifier: {k}" for k in SPDX_IDS}
TEMPLATES |= {f"{f.stem}/text": f.read_text(encoding="utf-8") for f in sorted(TEXTS.glob("*.txt"))}
THRESHOLD = 0.8


def template_words(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def template_bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a template, normalised as texts are."""
    words = template_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def anchors(own: list[str], need: int, spread: dict[str, int]) -> list[str]:
    """Bigrams of which any match has one: it lacks fewer than these. Those with
    long words are taken, as they are rare in other texts, and of equals those that
    more templates share (``spread``), so that few different ones are looked for."""
    rare = sorted(own, key=lambda g: (-max(map(len, g.split())), -spread[g], -len(g), g))
    return rare[: len(own) - need + 1]


def dealt(own: list[str]) -> list[list[str]]:
    """Bigrams by CRC-32, to look one up without a search."""
    out: list[list[str]] = [[] for _ in own]
    for g in own:
        out[zlib.crc32(g.encode()) % len(own)].append(g)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def bigrams(words: Column) -> Column:
    """Word bigrams of an array of words, in order, with repeats."""
    most = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), most), F.slice(words, F.lit(2), most), lambda a, b: F.concat(a, F.lit(" "), b))


def lowered(parts: Column) -> Column:
    """Words of a text that was split: nothing but ASCII letters and digits."""
    return F.transform(F.filter(parts, lambda w: w != ""), F.lower)


def dice(grams: Column, form: Column) -> Column:
    """Coefficient of a set of bigrams with a template."""
    return 2.0 * F.size(F.array_intersect(grams, form["own"])) / (F.size(grams) + form["size"])


def placed(all_grams: Column) -> Column:
    """Each bigram with its place and the last place before where it stood, -1 for
    none, in the order of places."""
    ordered = F.sort_array(F.transform(all_grams, lambda g, i: F.struct(g.alias("g"), i.alias("at"))))
    prev = lambda rows, x, k: F.when((k > 0) & (F.get(rows, k - 1)["g"] == x["g"]), F.get(rows, k - 1)["at"]).otherwise(-1)
    return let(ordered, lambda rows: F.sort_array(F.transform(rows, lambda x, k: F.struct(x["at"].alias("at"), prev(rows, x, k).alias("prev"), x["g"].alias("g")))))


def best_run(seq: Column, form: Column, low: float) -> Column:
    """Best coefficient of a run of words with a template; ``seq`` is ``placed``.

    A bigram of the template before a run never lowers its coefficient and any
    other at its start never raises it, so the best run starts where a stretch of
    the template's bigrams does. From all these starts, all runs of up to ``most``
    bigrams are scored: more are too many for a match unless they repeat. A bigram
    counts in a run if its last place before (``prev``) is not in the run."""
    hit = lambda g: F.array_contains(F.get(form["dealt"], F.pmod(F.crc32(g.cast("binary")), F.size(form["dealt"])).cast("int")), g)
    marked = F.transform(seq, lambda x: F.struct(x["at"].alias("at"), x["prev"].alias("prev"), hit(x["g"]).cast("int").alias("hit")))

    def step(acc: Column, x: Column, start: Column) -> Column:
        new = F.when(x["prev"] < start, 1).otherwise(0)
        return let(F.struct((acc["n"] + new).alias("n"), (acc["both"] + new * x["hit"]).alias("both")), lambda y: F.struct(y["n"].alias("n"), y["both"].alias("both"), F.greatest(acc["best"], 2.0 * y["both"] / (y["n"] + form["size"])).alias("best")))

    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("both"), F.lit(0.0).alias("best"))
    best = lambda rows, start: F.aggregate(F.slice(rows, start + 1, form["most"]), zero, lambda acc, x: step(acc, x, start), lambda acc: acc["best"])
    starts = lambda rows: F.filter(rows, lambda x, k: (x["hit"] == 1) & ((k == 0) | (F.get(rows, k - 1)["hit"] == 0)) & (F.size(rows) - k >= form["need"]))
    return let(marked, lambda rows: F.array_max(F.transform(starts(rows), lambda x: best(rows, x["at"]))))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, template, dice, n_found for each row of ``docs``.

    ``template`` is the best match of the whole text, one of its lines or a run of
    its words, which may cross lines, with a coefficient of at least ``threshold``
    (ties: the first by name), null without one; ``n_found`` is the number of
    templates matched. Normalisation: ASCII letters lowered, everything but letters
    and digits of ASCII as one space. Null, empty and one-word texts match nothing.
    Repeated rows stay; other columns are ignored. Templates are a parameter; they
    go to all tasks as one value.

    Each row is judged by itself, nothing is shuffled or joined. A text is split
    into words once; only texts with a word that some match must have are looked at
    further, and templates are tried when the text has a bigram that any match of
    theirs must have and as many of their bigrams as a match needs.
    """
    spark = docs.sparkSession
    grams = {n: g for n, t in templates.items() if (g := template_bigrams(t))}
    low = threshold / (2 - threshold) * (1 - 1e-9)  # the coefficient decides ties
    needs = {n: math.ceil(low * len(g)) for n, g in grams.items()}
    spread = Counter(g for own in grams.values() for g in own)
    marks = {n: anchors(g, needs[n], spread) for n, g in grams.items()}
    forms = [(n, len(g), needs[n], math.ceil(len(template_words(templates[n])) / low), g, marks[n], dealt(g)) for n, g in grams.items()]
    shape = "template string, size int, need int, most int, own array<string>, marks array<string>, dealt array<array<string>>"
    held = spark.createDataFrame(forms, shape).select(F.collect_list(F.struct("*")).alias("forms"))
    every, rare = sorted(set().union(*grams.values())), sorted({max(g.split(), key=lambda w: (len(w), w)) for x in marks.values() for g in x})
    in_set = lambda x, values: F.coalesce(x.isin(*values), F.lit(False)) if values else F.lit(False)
    split = lambda text: F.split(text, r"\P{Alnum}+")  # noqa: E731  letters and digits of ASCII

    rows = docs.select("doc_id", "text", split(F.col("text")).alias("parts"))
    rows = rows.select("doc_id", "text", F.when(F.exists("parts", lambda w: in_set(F.lower(w), rare)), F.col("parts")).alias("parts"))
    rows = rows.select("doc_id", "text", bigrams(lowered(F.col("parts"))).alias("all"))
    rows = rows.select("*", F.array_distinct(F.filter("all", lambda g: in_set(g, every))).alias("hits"))
    rows = rows.select("doc_id", "text", "all", "hits", F.when(F.size("hits") > 0, held.scalar()).alias("forms"))
    enough = lambda f: (F.size("hits") >= f["need"]) & F.arrays_overlap(f["marks"], F.col("hits")) & (F.size(F.array_intersect("hits", f["own"])) >= f["need"])
    rows = rows.select("doc_id", "text", "all", F.filter("forms", enough).alias("near"))
    some = F.size("near") > 0
    lines = F.filter(F.transform(F.split("text", "\n"), lambda line: F.array_distinct(bigrams(lowered(split(line))))), lambda g: F.size(g) > 0)
    rows = rows.select("doc_id", "near", F.when(some, placed(F.col("all"))).alias("seq"), F.when(some, F.concat(F.array(F.array_distinct("all")), lines)).alias("units"))
    best = lambda f: F.greatest(F.array_max(F.transform("units", lambda u: dice(u, f))), best_run(F.col("seq"), f, low))
    scored = F.transform("near", lambda f: F.struct((-best(f)).alias("d"), f["template"].alias("template")))
    rows = rows.select("doc_id", F.when(some, F.filter(scored, lambda x: x["d"] <= -threshold)).alias("found"))
    first = F.array_min("found")
    return rows.select("doc_id", first["template"].alias("template"), F.round(-first["d"], 9).alias("dice"), F.coalesce(F.size("found"), F.lit(0)).cast("long").alias("n_found"))


def _sql() -> str:
    """Whole texts, lines, and runs of up to as many bigrams as a match can have
    without repeats, from each place where a stretch of a template's bigrams begins."""
    grams = {n: template_bigrams(t) for n, t in TEMPLATES.items()}
    low = THRESHOLD / (2 - THRESHOLD) * (1 - 1e-9)
    rows = ", ".join(f"('{n}', {len(g)}, {math.ceil(len(template_words(TEMPLATES[n])) / low)}, '{x}')" for n, g in grams.items() for x in g)
    return rf"""
WITH known(template, size, most, gram) AS (VALUES {rows}),
d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r, coalesce(text, '') AS text FROM documents),
u AS (SELECT r, unnest(list_prepend(text, string_split(text, chr(10)))) AS line, generate_subscripts(list_prepend(text, string_split(text, chr(10))), 1) AS unit FROM d),
w AS (SELECT r, unit, list_filter(string_split(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM u),
p AS (SELECT r, unit, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram, unnest(range(1, len(w))) AS pos FROM w WHERE len(w) > 1),
c AS (SELECT r, unit, count(DISTINCT gram) AS n FROM p GROUP BY r, unit),
m AS (SELECT r, unit, template, size, most, count(DISTINCT gram) AS k FROM p JOIN known USING (gram) GROUP BY r, unit, template, size, most),
units AS (SELECT r, template, 2.0::DOUBLE * k / (n + size) AS dice FROM m JOIN c USING (r, unit)),
near AS (SELECT r, template, size, most FROM m WHERE unit = 1 AND k >= size * {low}::DOUBLE),
q AS (SELECT r, pos, gram, coalesce(lag(pos) OVER (PARTITION BY r, gram ORDER BY pos), 0) AS prev FROM p WHERE unit = 1 AND r IN (SELECT r FROM near)),
h AS (SELECT q.r, q.pos, q.prev, n.template, n.size, n.most, k.gram IS NOT NULL AS hit FROM q JOIN near n USING (r) LEFT JOIN known k ON k.template = n.template AND k.gram = q.gram),
s AS (SELECT * FROM (SELECT r, template, pos AS start, hit, lag(hit) OVER (PARTITION BY r, template ORDER BY pos) AS before FROM h) WHERE hit AND NOT coalesce(before, false)),
runs AS (SELECT h.r, h.template, 2.0::DOUBLE * sum(CASE WHEN prev < start AND h.hit THEN 1 ELSE 0 END) OVER x / (sum(CASE WHEN prev < start THEN 1 ELSE 0 END) OVER x + size) AS dice
  FROM h JOIN s ON h.r = s.r AND h.template = s.template AND h.pos >= s.start AND h.pos < s.start + h.most WINDOW x AS (PARTITION BY h.r, h.template, s.start ORDER BY h.pos)),
a AS (SELECT r, template, max(dice) AS dice FROM (SELECT * FROM units UNION ALL SELECT * FROM runs) GROUP BY r, template),
b AS (SELECT r, min({{'d': -dice, 't': template}}) AS b, count(*) AS n_found FROM a WHERE dice >= {THRESHOLD}::DOUBLE GROUP BY r)
SELECT d.doc_id, b.b.t AS template, round(-b.b.d, 9) AS dice, CAST(coalesce(b.n_found, 0) AS BIGINT) AS n_found FROM d LEFT JOIN b ON d.r = b.r
"""


SQL = _sql()


def op6_license_scan(spark, sf_dir):
    """Every whole text of documents against all templates."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
