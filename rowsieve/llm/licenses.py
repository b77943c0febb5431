"""License scans: Dice coefficient over word bigrams against licence templates.

Units of a text are its lines, its paragraphs (parted by lines without a letter or digit) and the whole; equal units of a text count
once. Words are runs of ASCII letters and digits in lower case. A unit is compared with a template only if their
numbers of words allow it: with a threshold t and b bigrams in the template, a unit reaches t only with between
t / (2 - t) b and (2 - t) / t b distinct bigrams, and must share t / (2 - t) b of the template's, so texts and units
without any of a few marking words are passed over. Of the templates at or above the threshold the unit takes the
best one, ties to the smaller identifier.

DataFrame functions only: the templates are constants of the plan, units are made and dropped within a scan of the texts, and
only the units that match are summed by document.

Nulls and edge cases: null and empty texts, and units of one word, match nothing; a text of any length is read whole; rows of
one doc_id are one document if their texts are equal; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsieve.llm._common import read_table

THRESHOLD = 0.8

#: Public licence notices and short licence texts, by SPDX identifier.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either '
        "express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along "
        "with this program. If not, see https://www.gnu.org/licenses/.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL "
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
        "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
        "SOFTWARE.",
    ),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License - see the LICENSE file for details."),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def template_bigrams(text: str) -> list[str]:
    words = re.findall("[a-z0-9]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def _groups(templates: tuple[tuple[str, str], ...]) -> list[tuple[str, list[str]]]:
    return [(name, template_bigrams(text)) for name, text in templates]


#: Words that prose is full of: as marks they would rule nothing out.
COMMON = frozenset("a all an and any as at be by can for from in is it its may not of on or see that the this to under use with work you".split())


def marks(groups: list[tuple[str, list[str]]], threshold: float) -> list[str]:
    """Words of which every unit that reaches the threshold with some template has one.

    Such a unit shares at least t / (2 - t) b of the template's b bigrams. Words are chosen, those in most bigrams first,
    until fewer bigrams than that are free of them in every template."""
    left = {i: set(g) for i, (_, g) in enumerate(groups)}
    needed = {i: math.ceil(len(g) * threshold / (2 - threshold) - 1e-9) for i, (_, g) in enumerate(groups)}
    chosen: list[str] = []
    while open_ := [i for i in left if len(left[i]) >= needed[i]]:
        counts = Counter(w for i in open_ for g in left[i] for w in set(g.split()))
        word = min(counts, key=lambda w: (w in COMMON, -counts[w], w))
        chosen.append(word)
        left = {i: {g for g in gs if word not in g.split()} for i, gs in left.items()}
    return sorted(chosen)


def units(text: Column) -> Column:
    """Distinct lines, paragraphs and the whole, as words in lower case with single blanks between."""
    plain = F.lower(F.regexp_replace(text, r"[^A-Za-z0-9\n]+", " "))
    whole = F.array(F.regexp_replace(plain, r"\n", " "))
    paragraphs = F.transform(F.split(plain, r"\n ?\n"), lambda p: F.regexp_replace(p, r"\n", " "))
    parts = F.concat(F.split(plain, r"\n"), paragraphs, whole)
    return F.array_distinct(F.transform(parts, lambda u: F.regexp_replace(F.trim(u), " +", " ")))


def match_units(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each unit that matches: doc_id, text_hash, unit, license_id, score."""
    groups = [(name, grams) for name, grams in _groups(templates) if grams]
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    # No unit of a text without a mark can match, nor can a unit without one.
    mark = rf"(?i)(?<![A-Za-z0-9])(?:{'|'.join(marks(groups, threshold))})(?![A-Za-z0-9])"
    rows = docs.where(F.col(text).rlike(mark))
    rows = rows.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.explode(units(F.col(text))).alias("unit")).where(F.col("unit").rlike(mark))
    # Words bound distinct bigrams from above only; repeats can make fewer. So this bound is on the low side alone.
    n_words = F.length("unit") - F.length(F.replace("unit", F.lit(" "), F.lit(""))) + 1
    rows = rows.where(n_words - 1 >= min(len(g) for _, g in groups) * low)
    words = F.split("unit", " ")
    grams = F.array_distinct(F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b)))
    rows = rows.withColumn("grams", grams)
    size = F.size("grams")
    # The size bounds choose the candidates; only those are intersected.
    rows = rows.where(size.between(min(len(g) for _, g in groups) * low, max(len(g) for _, g in groups) * high))
    scored = []
    for name, g in groups:
        dice = F.lit(2.0) * F.size(F.array_intersect("grams", F.array(*map(F.lit, g)))) / (size + len(g))
        scored.append(F.when(size.between(len(g) * low, len(g) * high), F.struct((-dice).alias("minus"), F.lit(name).alias("name"))))
    best = F.array_min(F.array(*scored)) if len(scored) == 1 else F.least(*scored)
    rows = rows.withColumn("best", best).where(F.col("best.minus") <= -threshold)
    return rows.select("doc_id", "text_hash", "unit", F.col("best.name").alias("license_id"), (-F.col("best.minus")).alias("score"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_units (that match), licenses (sorted, comma-joined), best_license, best_score."""
    found = match_units(docs, key, text).groupBy("doc_id", "text_hash")
    top = F.min(F.struct((-F.col("score")).alias("minus"), F.col("license_id").alias("name")))
    found = found.agg(F.countDistinct("unit").alias("n_units"), F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("licenses"), top.alias("top"))
    found = found.withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"})
    rows = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("text_hash"))
    rows = rows.join(found, rows["doc_id"].eqNullSafe(found["__id"]) & (rows["text_hash"] == found["__hash"]), "left")
    return rows.select("doc_id", F.coalesce("n_units", F.lit(0)).alias("n_units"), F.coalesce("licenses", F.lit("")).alias("licenses"), F.col("top.name").alias("best_license"), F.round(-F.col("top.minus"), 6).alias("best_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))


def oracle() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(n)}, [{', '.join(map(quoted, g))}])" for n, g in _groups(TEMPLATES))
    return f"""
WITH templates(name, grams) AS (VALUES {rows}),
docs AS (SELECT row_number() OVER () AS row, doc_id, lower(regexp_replace(text, '[^A-Za-z0-9\\n]+', ' ', 'g')) AS plain FROM documents),
parts AS (
    SELECT row, unnest(string_split(plain, chr(10))) AS part FROM docs
    UNION ALL SELECT row, unnest(regexp_split_to_array(plain, '\\n ?\\n')) FROM docs
    UNION ALL SELECT row, plain FROM docs
),
units AS (SELECT DISTINCT row, trim(regexp_replace(part, '[ \\n]+', ' ', 'g')) AS unit FROM parts),
worded AS (SELECT row, unit, string_split(unit, ' ') AS words FROM units WHERE unit <> ''),
grams AS (
    SELECT row, unit, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS grams FROM worded WHERE len(words) > 1
),
scored AS (
    SELECT row, unit, name, 2.0::DOUBLE * len(list_intersect(g.grams, t.grams)) / (len(g.grams) + len(t.grams)) AS score
    FROM grams g JOIN templates t ON len(g.grams) BETWEEN len(t.grams) * {THRESHOLD / (2 - THRESHOLD)!r} AND len(t.grams) * {(2 - THRESHOLD) / THRESHOLD!r}
),
best AS (
    SELECT row, unit, name, score, row_number() OVER (PARTITION BY row, unit ORDER BY score DESC, name) AS place FROM scored WHERE score >= {THRESHOLD!r}
),
found AS (
    SELECT row, count(*) AS n_units, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses, first(name ORDER BY score DESC, name) AS best_license, max(score) AS best_score
    FROM best WHERE place = 1 GROUP BY row
)
SELECT doc_id, coalesce(n_units, 0)::BIGINT AS n_units, coalesce(licenses, '') AS licenses, best_license, round(best_score, 6) AS best_score
FROM docs LEFT JOIN found USING (row)
"""


ORACLE = oracle()
