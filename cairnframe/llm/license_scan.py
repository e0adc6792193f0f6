"""Licence scans: normalised text held against licence templates by the Dice coefficient over word bigrams.

Units are a document as a whole, its paragraphs, its lines, its sentences, which may go on over line breaks, and its
passages, runs of adjacent sentences as many as the longest template has, so that a notice is found
inside other text however that is wrapped. Two bounds leave few units to compare, neither of which loses a match. A
Dice coefficient of t needs sizes within a factor of t / (2 - t) of one another, and at least
that share of the template's bigrams; so of any of them that are one more than may be missed, a text that matches
holds one.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 0.8
#: Licence and text, of notices and headers as they are commonly written, and of short licences whole. The last withholds a licence.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("all-rights-reserved", "All rights reserved."),
]
_SEPARATOR = r"[^\p{L}\p{N}]+"
#: What parts the units of each kind; none: the whole text.
UNITS: dict[str, str | None] = {"document": None, "paragraph": r"\n[ \t\r]*\n", "line": r"\n", "sentence": r"\n[ \t\r]*\n|[.!?][ \t\r\n]+"}
#: The kind of units that are several sentences.
PASSAGE = "passage"


def words(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


def bigrams(text: str) -> list[str]:
    w = words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:])))  # noqa: B905


def longest_passage(templates: list[tuple[str, str]]) -> int:
    """Sentences of the template that has most."""
    return max(len(re.split(UNITS["sentence"], text)) for _, text in templates)


def fewest(size: int, least: float) -> int:
    """Bigrams of a template of ``size`` that a match of ``least`` holds at least."""
    return math.ceil(size * least / (2 - least) - 1e-9)


def anchors(templates: list[tuple[str, str]], least: float) -> list[str]:
    """Bigrams of which every match of every template holds one: of each template one more than a match may miss, those that serve several templates first, and long ones before short."""
    need = [(b := bigrams(text), len(b) - fewest(len(b), least) + 1) for _, text in templates]
    found: list[str] = []
    while True:
        gains: dict[str, int] = {}
        for b, n in need:
            if sum(x in found for x in b) < n:
                for x in b:
                    if x not in found:
                        gains[x] = gains.get(x, 0) + 1
        if not gains:
            return sorted(found)
        found.append(max(sorted(gains), key=lambda x: (len(x) > 8, gains[x], len(x))))


def may_match(text: Column, templates: list[tuple[str, str]], least: float) -> Column:
    """Whether an anchor occurs in the normalised text; false for null."""

    def any_of(plain: Column) -> Column:
        met = F.lit(False)
        for x in anchors(templates, least):
            met = met | plain.contains(x)
        return met

    # In a lambda the normalised text is a variable, which all conditions share.
    return F.coalesce(F.transform(F.array(F.regexp_replace(F.lower(text), _SEPARATOR, " ")), any_of)[0], F.lit(False))


def _bigrams(unit: Column) -> Column:
    """Distinct word bigrams of a text, as strings."""
    w = F.filter(F.split(F.lower(unit), _SEPARATOR), lambda x: x != "")
    pairs = F.zip_with(w, F.slice(w, 2, F.greatest(F.lit(0), F.size(w) - 1)), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.filter(pairs, lambda x: x.isNotNull()))


def scan(docs: DataFrame, text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """A row per row of docs and licence found in it, a unit holding the licence of its best template (several if equal): the other columns as a struct ``row``, license, score (the best Dice coefficient), units (how many matched) and kind (that of the best; ties to the first of UNITS, passages last).

    Null and empty texts hold no licence; a text of one word has no bigrams. Repeated rows are scanned one by one.
    """
    kept = [c for c in docs.columns if c != text]
    rows = docs.select(F.struct(*kept).alias("row"), F.col(text).alias("text")).where(may_match(F.col(text), templates, least))
    sets = [(name, bigrams(t)) for name, t in templates]
    bound = lambda n: (fewest(n, least), math.floor(n * (2 - least) / least + 1e-9))
    low, high = min(bound(len(b))[0] for _, b in sets), max(bound(len(b))[1] for _, b in sets)
    named = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("unit"))
    units = F.concat(*[F.transform(F.array(F.col("text")) if parts is None else F.split("text", parts, -1), named(kind)) for kind, parts in UNITS.items()])
    # Sentences i to i + n - 1 of the text, for all n up to the longest template's, if two neighbours among them hold an anchor.
    most = F.lit(longest_passage(templates))
    ends = lambda s, i: F.sequence(F.lit(2), F.least(most, F.size(s) - i + 1))
    near = lambda s: F.transform(F.sequence(F.lit(1), F.size(s) - 1), lambda i: may_match(F.concat(F.element_at(s, i), F.lit(" "), F.element_at(s, i + 1)), templates, least))
    runs = lambda s, f: F.flatten(F.transform(F.sequence(F.lit(1), F.size(s) - 1), lambda i: F.transform(F.filter(ends(s, i), lambda n: F.exists(F.slice(f, i, n - 1), lambda x: x)), lambda n: F.array_join(F.slice(s, i, n), " "))))
    run = lambda s: F.flatten(F.transform(F.array(near(s)), lambda f: runs(s, f)))
    passages = F.flatten(F.transform(F.array(F.split("text", UNITS["sentence"], -1)), lambda s: F.when(F.size(s) > 1, run(s)).otherwise(F.array().cast("array<string>"))))
    units = F.concat(units, F.transform(passages, named(PASSAGE)))
    # A unit without an anchor goes before its bigrams are formed.
    split = rows.withColumn("place", F.monotonically_increasing_id()).select("row", "place", F.inline(units)).where((F.col("kind") == PASSAGE) | may_match(F.col("unit"), templates, least))
    grams = split.select("row", "place", "kind", _bigrams(F.col("unit")).alias("grams")).where(F.size("grams").between(low, high))

    def scored(b: list[str]) -> Column:
        lo, hi = bound(len(b))
        shared = F.size(F.array_intersect("grams", F.array(*map(F.lit, b))))
        return F.when(F.size("grams").between(lo, hi), 2.0 * shared / (F.size("grams") + len(b))).otherwise(0.0)

    scores = grams.withColumn("scores", F.array(*[F.struct(F.lit(name).alias("license"), scored(b).alias("score")) for name, b in sets])).withColumn("top", F.array_max(F.transform("scores", lambda x: x["score"])))
    scores = scores.where(F.col("top") >= least - 1e-12)
    hits = F.filter("scores", lambda x: x["score"] == F.col("top"))
    order = F.struct("score", *[(-F.array_position(F.array(*map(F.lit, [*UNITS, PASSAGE])), F.col("kind"))).alias("first")])
    found = scores.select("row", "place", "kind", F.inline(F.array_distinct(hits)))
    best = found.groupBy("place", "license").agg(F.first("row").alias("row"), F.max("score").alias("score"), F.count_if(F.col("score") >= least - 1e-12).alias("units"), F.max_by("kind", order).alias("kind"))
    return best.select("row", "license", "score", "units", "kind")


def query(docs: DataFrame) -> DataFrame:
    return scan(docs.select("doc_id", "text")).select("row.doc_id", "license", "score", "units", "kind")


def oracle_sql(templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    sets = ", ".join(f"({i}, {quoted(name)}, [{', '.join(map(quoted, bigrams(t)))}])" for i, (name, t) in enumerate(templates))
    units = " UNION ALL ".join(
        f"SELECT place, doc_id, {i} AS k, {quoted(kind)} AS kind, unnest({'[text]' if parts is None else f'regexp_split_to_array(text, {quoted(parts)})'}) AS unit FROM d" for i, (kind, parts) in enumerate(UNITS.items())
    )
    most = max(math.floor(len(bigrams(t)) * (2 - least) / least) for _, t in templates)  # more bigrams than any match can have
    return f"""
WITH d AS (SELECT row_number() OVER () AS place, doc_id, text FROM documents WHERE text IS NOT NULL),
t(i, license, grams) AS (VALUES {sets}),
n AS (SELECT place, doc_id, regexp_split_to_array(text, {quoted(UNITS['sentence'])}) AS s FROM d), i AS (SELECT *, unnest(range(1, len(s))) AS i FROM n),
u AS ({units} UNION ALL SELECT place, doc_id, {len(UNITS)} AS k, {quoted(PASSAGE)} AS kind, array_to_string(s[i : i + m - 1], ' ') AS unit FROM i, range(2, {longest_passage(templates) + 1}) AS r(m) WHERE i + m - 1 <= len(s)),
w AS (SELECT place, doc_id, k, kind, list_filter(regexp_split_to_array(lower(unit), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM u),
g AS (SELECT place, doc_id, k, kind, list_distinct(list_transform(list_zip(w[:-2], w[2:]), lambda x: x[1] || ' ' || x[2])) AS grams FROM w WHERE len(w) > 1),
r AS (SELECT *, row_number() OVER () AS unit_id, len(grams) AS n FROM g WHERE len(grams) BETWEEN 1 AND {most}),
shared AS (SELECT unit_id, i, count(*) AS shared FROM (SELECT unit_id, unnest(grams) AS b FROM r) JOIN (SELECT i, unnest(grams) AS b FROM t) USING (b) GROUP BY ALL),
s AS (SELECT DISTINCT place, doc_id, k, kind, unit_id, license, score FROM (
  SELECT r.place, r.doc_id, r.k, r.kind, r.unit_id, t.license, 2.0::DOUBLE * shared / (r.n + len(t.grams)) AS score FROM shared JOIN r USING (unit_id) JOIN t USING (i))
  WHERE score >= {least} - 1e-12 QUALIFY score = max(score) OVER (PARTITION BY unit_id))
SELECT doc_id, license, max(score) AS score, count(*) AS units, arg_max(kind, (score, -k)) AS kind FROM s GROUP BY place, doc_id, license
"""


ORACLE_SQL = oracle_sql()
