"""Licence scans: normalised text against licence templates by Dice coefficient over word bigrams.

Units of a document are its whole text, its paragraphs, lines and sentences, and runs of consecutive pieces (pieces end at
a newline or a sentence's end), so a notice of several paragraphs or a wrapped sentence inside a longer text is found. A
run that is held against a template has at most twice as many words as the largest size that this template admits. A unit
and a template are sets of word bigrams of lower-case text without signs; a unit matches if ``2 |A n B| / (|A| + |B|) >=
threshold``.

Pruning loses nothing:

* Size bounds. Dice of at least t needs ``t / (2 - t) <= |A| / |B| <= (2 - t) / t``. Each template lists the sizes it
  admits, so candidate templates of a unit are an equi-join on its number of bigrams (the list is as bounded as the
  templates are, and is broadcast).
* Shared bigrams. Dice of at least t also needs ``|A n B| >= t / (2 - t) |B|``. Every unit's bigrams are among those of the
  whole text, so a document goes on only with the templates of which its whole text holds that share.
* Key words. Each template has key words that touch more than the remaining share of its bigrams, so a text without any
  of them cannot match; this is looked up first, as it is cheap.
* Dense places. A run without a template's bigram in its first piece is no better than the run after this piece, so runs
  start only where a template's bigrams begin, and only where as many as it needs follow within its bound on words.

Everything is DataFrame expressions; what passes the whole-text test is written once and read by units and runs.

Edge cases: null and empty texts match nothing, nor do units of one word; a document's equal units count once, and overlapping
runs as one unit of a licence that no other unit matches; ties
between templates of one licence give one row; a very long text costs time in proportion to its length and to the dense
places in it; repeated rows give their result once an id; other columns, whatever their names, aren't looked at; an empty
table gives an empty one.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemara.llm.common import materialise, table

THRESHOLD = 0.8

#: Notices and short texts of public licences, by SPDX identifier.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

NOT_WORD = r"[^\p{L}\p{N}]+"


def template_bigrams(text: str) -> list[str]:
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def size_bounds(n: int, threshold: float) -> tuple[int, int]:
    return math.ceil(n * threshold / (2 - threshold) - 1e-9), math.floor(n * (2 - threshold) / threshold + 1e-9)


#: Words too common in prose to tell a licence by; used as key words only where nothing else is left.
COMMON = frozenset("a all and any are as at be by for from in is it may not of on or other out that the this to under use with without work you your".split())


def key_words(bigrams: list[str], threshold: float) -> list[str]:
    """Words that touch so many bigrams that no matching unit is without all of them: few and uncommon ones."""
    spare = len(bigrams) * (1 - threshold / (2 - threshold))
    touches = {}
    for b in bigrams:
        for w in b.split():
            touches.setdefault(w, set()).add(b)
    hit, keys = set(), []
    while len(hit) <= spare + 1e-9 and touches:
        w = max(touches, key=lambda w: (w not in COMMON, len(touches[w] - hit) * min(len(w), 8), w))
        if gained := touches.pop(w) - hit:
            keys.append(w)
            hit |= gained
    return keys


def normalise(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), NOT_WORD, " "))


def units(text: Column) -> Column:
    sentences = F.regexp_replace(text, r"([.!?])\s+", "$1\n")
    return F.concat(F.array(text), F.split(text, r"\n[ \t\r]*\n"), F.split(text, r"\n"), F.split(sentences, r"\n"))


END = "\n"


def tokens(text: Column) -> Column:
    """The normalised words of a text, with ``END`` after every piece."""
    ended = F.regexp_replace(F.regexp_replace(F.lower(text), r"([.!?])\s+", "$1\n"), r"[^\p{L}\p{N}\n]+", " ")
    return F.split(F.concat(F.btrim(F.regexp_replace(ended, r" ?(?:\n ?)+", " \n "), F.lit(" \n")), F.lit(" \n")), " ")


def bigram_set(words: Column) -> Column:
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.lit(0), F.size(words) - 1)), F.slice(words, 2, F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(pairs)


def template_table(spark: SparkSession, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``size, license, t_bigrams``: each template once for every size it admits."""
    def row(name: str, grams: list[str]) -> Column:
        low, high = size_bounds(len(grams), threshold)
        return F.struct(
            F.lit(name).alias("license"), F.lit(low).alias("low"), F.lit(high).alias("high"), F.array(*[F.lit(g) for g in grams]).alias("t_bigrams")
        )

    values = F.array(*[row(name, template_bigrams(text)) for name, text in templates])
    return (
        spark.range(1)
        .select(F.explode(values).alias("t"))
        .select(F.explode(F.sequence("t.low", "t.high")).alias("size"), "t.license", "t.t_bigrams")
    )


def _held(grams: Column, templates: Column) -> Column:
    """The ``templates`` of which the distinct bigrams of a text hold as many as a match needs."""
    enough = F.transform(F.array(grams), lambda g: F.filter(templates, lambda t: F.size(F.array_intersect(g, t["grams"])) >= t["need"]))
    return F.flatten(enough)


def survivors(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, text, held``: texts that can match, with the templates (``license, need, cap, grams``) that they can match."""
    grams = [template_bigrams(t) for _, t in templates]
    keys = sorted({w for g in grams for w in key_words(g, threshold)})
    known = F.array(*[F.struct(
        F.lit(name).alias("license"), F.lit(size_bounds(len(g), threshold)[0]).alias("need"), F.lit(2 * (size_bounds(len(g), threshold)[1] + 1)).alias("cap"), F.array(*map(F.lit, g)).alias("grams")
    ) for (name, _), g in zip(templates, grams, strict=True)])
    every = F.array(*map(F.lit, sorted({x for g in grams for x in g})))
    words = F.split(normalise(F.col("text")), " ")
    return (
        docs.select("doc_id", "text")
        .where(F.col("text").isNotNull() & F.arrays_overlap(words, F.array(*map(F.lit, keys))))
        .withColumn("held", _held(F.array_intersect(bigram_set(words), every), known))
        .where(F.size("held") > 0)
    )


def run_scores(held: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, license, dice`` of the runs of two or more pieces that reach the threshold, from what ``survivors`` gives.

    Each step ends in an explode, so what is computed once isn't computed again by the next.
    """
    def next_word(i: Column) -> Column:
        follows = F.get("w", i + 1)
        return F.when(follows == END, F.get("w", i + 2)).otherwise(follows)

    grams = F.transform("w", lambda x, i: F.when(x != END, F.concat(x, F.lit(" "), next_word(i))))
    read = held.select("doc_id", "held", F.explode(F.array(tokens(F.col("text")))).alias("w"))
    each = read.select("doc_id", "held", "w", F.explode(F.array(grams)).alias("grams")).select("doc_id", "w", "grams", F.explode("held").alias("t"))
    own = F.transform("grams", lambda x, i: F.when(F.array_contains("t.grams", x), i))
    hits = each.select("doc_id", "t", "w", F.explode(F.array(F.filter(own, lambda i: i.isNotNull()))).alias("hits"))
    # Places of the template's bigrams after which as many as it needs follow within its bound (a word has at most one END).
    dense = F.filter("hits", lambda p, k: F.get("hits", k + F.col("t.need") - 1) - p <= 2 * F.col("t.cap"))
    anchors = hits.select("doc_id", "t", "w", F.explode(F.array(dense)).alias("dense")).where(F.size("dense") > 0)

    def start_before(p: Column) -> Column:
        """Where the piece around a place begins, null if this is farther back than a run reaches."""
        low = F.greatest(F.lit(0), p - 2 * F.col("t.cap"))
        back = F.array_position(F.reverse(F.slice("w", low + 1, p - low)), END)
        return F.when(back > 0, p - back.cast("int") + 1).when(low == 0, 0)

    starts = F.filter(F.array_distinct(F.transform("dense", start_before)), lambda s: s.isNotNull())
    placed = anchors.select("doc_id", "t", "w", F.explode(F.array(starts)).alias("starts"))
    windows = placed.select("doc_id", "t", F.explode(F.transform("starts", lambda s: F.slice("w", s + 1, 2 * F.col("t.cap")))).alias("w"))
    ends = F.filter(F.transform("w", lambda x, i: F.when(x == END, i)), lambda i: i.isNotNull())
    runs = windows.select("doc_id", "t", "w", F.explode(ends).alias("end")).select("doc_id", "t", "end", F.slice("w", 1, F.col("end")).alias("w"))
    words = runs.where(F.array_contains("w", END)).select("doc_id", "t", F.explode(F.array(F.filter("w", lambda x: x != END))).alias("words"))
    sized = words.where(F.size("words") <= F.col("t.cap")).select("doc_id", "t", F.explode(F.array(bigram_set(F.col("words")))).alias("bigrams"))
    dice = 2 * F.size(F.array_intersect("bigrams", "t.grams")) / (F.size("bigrams") + F.size("t.grams"))
    return sized.select("doc_id", "t.license", dice.alias("dice")).where(F.col("dice") >= threshold)


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, license, dice, n_units``: the licences of each document, with the best match and how many different units match."""
    keys = F.array(*map(F.lit, sorted({w for _, t in templates for w in key_words(template_bigrams(t), threshold)})))
    held = materialise(survivors(docs, templates, threshold), "licensed")
    u = (
        held.select("doc_id", F.explode(F.array_distinct(F.transform(units(F.col("text")), normalise))).alias("unit"))
        .select("doc_id", "unit", F.explode(F.array(F.split("unit", " "))).alias("words"))
        .where(F.arrays_overlap("words", keys))
        .select("doc_id", "unit", F.explode(F.array(bigram_set(F.col("words")))).alias("bigrams"))
        .withColumn("size", F.size("bigrams"))
    )
    dice = 2 * F.size(F.array_intersect("bigrams", "t_bigrams")) / (F.col("size") + F.size("t_bigrams"))
    of_units = (
        u.join(F.broadcast(template_table(docs.sparkSession, templates, threshold)), "size")
        .select("doc_id", "license", dice.alias("dice"), "unit")
        .where(F.col("dice") >= threshold)
    )
    return (
        of_units.unionByName(run_scores(held, threshold).withColumn("unit", F.lit(None).cast("string")))
        .groupBy("doc_id", "license")
        .agg(F.round(F.max("dice"), 6).alias("dice"), F.greatest(F.lit(1), F.countDistinct("unit")).cast("long").alias("n_units"))
    )


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql_templates() -> str:
    values = ", ".join(f"('{n}', {template_bigrams(t)!r})" for n, t in TEMPLATES)
    return f"(VALUES {values}) AS t(license, t_bigrams)"


OP4_SQL = f"""
WITH u0 AS (
  SELECT doc_id, unnest(list_concat(list_concat([text], string_split_regex(text, '\\n[ \\t\\r]*\\n')),
    list_concat(string_split(text, chr(10)), string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10))))) AS raw
  FROM documents WHERE text IS NOT NULL
), u1 AS (
  SELECT DISTINCT doc_id, trim(regexp_replace(lower(raw), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS unit FROM u0
), u2 AS (SELECT doc_id, unit, string_split(unit, ' ') AS w FROM u1
), u3 AS (
  SELECT doc_id, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM u2 WHERE len(w) >= 2
), m AS (
  SELECT doc_id, license, unit, 2 * len(list_intersect(b, t_bigrams))::DOUBLE / (len(b) + len(t_bigrams)) AS dice
  FROM u3 JOIN {_sql_templates()} ON len(b) BETWEEN len(t_bigrams) / 2 AND len(t_bigrams) * 2
)
SELECT doc_id, license, round(max(dice), 6) AS dice, count(DISTINCT unit)::BIGINT AS n_units FROM m WHERE dice >= {THRESHOLD} GROUP BY doc_id, license
"""
