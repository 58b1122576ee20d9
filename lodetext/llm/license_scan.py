"""Licence scans with DataFrame functions alone: Dice coefficients of word bigrams against licence templates.

Text is normalised to lower-case words of letters and digits. Units are a document's lines and the document as a whole. A unit matches a template if the Dice coefficient of their sets of bigrams,
2 c / (a + b), is at least THRESHOLD. Since c is no larger than a or b, only units with a between b t / (2 - t) and b (2 - t) / t are compared (size bounds). Before that, documents are read for anchor
words: a unit that lacks all of a template's anchors lacks so many of its bigrams that it can't reach t / (2 - t) of them, so documents without any anchor are passed over.

A licence within a longer document is neither a line nor the document: for templates of WINDOWED words or more, windows of the template's length at every STEPS-th part of it are units as well, and of each document
(by doc_id) and template the best window is given, the first of equal ones. A whole copy is at most a sixteenth out of step with a window.

Defined cases: null and empty texts match nothing; a null doc_id gives rows like any other; repeated rows give repeated rows, but one best window together; a document of one line gives a row for the line and one for the document; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodetext.functions.tokenizer import computed_once
from lodetext.llm import shared

THRESHOLD = 0.8
#: Templates of so many words are also looked for within documents, by windows of their length that begin at every STEPS-th part of it.
WINDOWED, STEPS = 30, 8

#: Licence, and a text of it: notices, and short licences whole.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES.'),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]


def _words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def _bigrams(text: str) -> list[str]:
    w = _words(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


def anchors(text: str, threshold: float) -> list[str]:
    """Words, longest first, without which fewer than t / (2 - t) of the template's bigrams are left."""
    left = set(_bigrams(text))
    least, out = len(left) * threshold / (2 - threshold), []
    for w in sorted(set(_words(text)), key=lambda w: (-len(w), w)):
        if len(left) < least:
            break
        out.append(w)
        left = {b for b in left if w not in b.split()}
    return out


def _window(unit, size: int):
    return lambda s: unit(size, s, F.slice("w", s + 1, F.lit(size)))  # a second parameter would be taken for the index


def _pairs(w: F.Column) -> F.Column:
    return F.array_distinct(F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b)))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each match: doc_id, unit ("line", "document" or "window"), line (from 0; -1 for documents; of windows the first word), license, template (from 0), dice."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    low = computed_once(text, {"low": F.lower("text")})
    any_anchor = F.lit(False)
    for w in sorted({w for _, text in templates for w in anchors(text, threshold)}):
        any_anchor = any_anchor | F.contains("low", F.lit(w))
    clean = F.trim(F.regexp_replace(F.regexp_replace("low", r"[^\p{L}\p{N}\n]+", " "), r" *\n *", "\n"))
    cleaned = computed_once(low.where(any_anchor).select("doc_id", "low"), {"clean": clean})
    split = lambda x: F.filter(F.split(x, " "), lambda w: w != "")
    docs_words = computed_once(cleaned, {"w": split(F.regexp_replace("clean", "\n+", " "))})

    # all units of a document at once: the whole, its lines, and for each length of long templates that may be in it the windows (size: that length)
    unit = lambda size, line, w: F.struct(F.lit(size).alias("size"), F.lit(line).cast("int").alias("line"), w.alias("w"))
    units = [F.array(unit(0, -1, F.col("w"))), F.transform(F.split("clean", "\n"), lambda x, i: unit(0, i, split(x)))]
    sizes = sorted({len(_words(text)) for _, text in templates if len(_words(text)) >= WINDOWED})
    for size in sizes:
        may_hold = F.arrays_overlap("w", F.lit(sorted({w for _, text in templates if len(_words(text)) == size for w in anchors(text, threshold)})))
        starts = F.sequence(F.lit(0), F.size("w") - 1, F.lit(size // STEPS))
        windows = F.transform(starts, _window(unit, size))
        units.append(F.when((F.size("w") > size) & may_hold, windows).otherwise(F.slice(units[0], F.lit(1), F.lit(0))))
    each = docs_words.select("doc_id", F.explode(F.concat(*units)).alias("u")).where(F.size("u.w") > 1)
    sized = computed_once(each, {"a": _pairs(F.col("u.w"))}).select("doc_id", F.col("u.size").alias("size"), F.col("u.line").cast("long").alias("line"), "a")

    known = F.array(*[F.struct(F.lit(k).alias("template"), F.lit(name).alias("license"), F.lit(len(_words(text))).alias("size"), F.lit(_bigrams(text)).alias("bigrams")) for k, (name, text) in enumerate(templates)])
    share = threshold / (2 - threshold)
    near = F.filter(known, lambda t: ((F.col("size") == 0) | (F.col("size") == t["size"])) & (F.size("a") >= F.size(t["bigrams"]) * share) & (F.size("a") * share <= F.size(t["bigrams"])))
    both = sized.select("doc_id", "size", "line", "a", F.explode(near).alias("t"))
    kind = F.when(F.col("size") > 0, "window").when(F.col("line") < 0, "document").otherwise("line")
    dice = 2.0 * F.size(F.array_intersect("a", "t.bigrams")) / (F.size("a") + F.size("t.bigrams"))
    found = both.select("doc_id", kind.alias("unit"), "line", F.col("t.license").alias("license"), F.col("t.template").cast("long").alias("template"), dice.alias("dice")).where(F.col("dice") >= threshold)
    place = F.row_number().over(Window.partitionBy("doc_id", "unit", "template").orderBy(F.desc("dice"), "line"))  # only matches are moved
    return found.withColumn("place", place).where("unit <> 'window' or place = 1").drop("place")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(shared.table(spark, sf_dir, "documents"))


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ORACLE = rf"""
WITH t(template, license, x) AS (VALUES {", ".join(f"({k}, {_sql(name)}, {_sql(text)})" for k, (name, text) in enumerate(TEMPLATES))}),
tw AS (SELECT template, license, list_filter(string_split_regex(lower(x), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS w FROM t),
tb AS (SELECT template, license, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM tw),
u AS (
  SELECT doc_id, -1 AS line, text AS x FROM documents UNION ALL
  SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS x FROM documents),
uw AS (SELECT doc_id, line, list_filter(string_split_regex(lower(x), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS w FROM u),
ub AS (SELECT doc_id, line, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS a FROM uw WHERE len(w) > 1),
d AS (SELECT doc_id, line, license, template, 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) AS dice
      FROM ub JOIN tb ON len(a) >= len(b) * {THRESHOLD / (2 - THRESHOLD)} AND len(a) * {THRESHOLD / (2 - THRESHOLD)} <= len(b))
SELECT doc_id, CASE WHEN line < 0 THEN 'document' ELSE 'line' END AS unit, line::BIGINT AS line, license, template::BIGINT AS template, dice::DOUBLE AS dice FROM d WHERE dice >= {THRESHOLD}
UNION ALL
SELECT doc_id, 'window' AS unit, arg_min(line, (-dice, line))::BIGINT AS line, license, template::BIGINT AS template, max(dice)::DOUBLE AS dice
FROM (SELECT doc_id, line, license, template, 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) AS dice
      FROM (SELECT doc_id, line, license, template, list_distinct(list_transform(range(1, len(x)), lambda i: x[i] || ' ' || x[i + 1])) AS a, b
            FROM (SELECT doc_id, license, template, b, s AS line, w[s + 1 : s + size] AS x
                  FROM (SELECT doc_id, tw.license, tw.template, uw.w, len(tw.w) AS size, b, unnest(range(0, len(uw.w), len(tw.w) // {STEPS})) AS s
                        FROM uw JOIN tw ON line = -1 AND len(tw.w) >= {WINDOWED} AND len(uw.w) > len(tw.w) JOIN tb ON tb.template = tw.template
                        WHERE list_has_any(uw.w, ['license', 'licensed', 'software', 'permission', 'warranty', 'mozilla', 'redistribution'])))
            WHERE len(x) > 1))
WHERE dice >= {THRESHOLD} GROUP BY doc_id, license, template
"""
