"""Licence scan: TF-IDF cosine of headers and licence files to templates, inherited along directories.

Everything is DataFrame expressions, joins and aggregates.  A text is compared in units: every line,
every two lines that follow each other (headers are wrapped) and every paragraph, which ends at a line
without letters or digits.  A unit's vector holds all its words, so unrelated words lower its score;
document frequencies are counted over all texts.  Units without an anchor word are left out first: the
words that are no anchors carry less than the threshold's share of each template's length, so by the
Cauchy-Schwarz inequality such a unit cannot reach the threshold.  Equal units, as copies have them,
are scored once.

A file's own licence is that of its best unit.  A file of whose words at least half lie in matched
lines, or in matched paragraphs, and are words of the matched template, is a licence file: it also
licenses its directory.  A file without a licence of its own takes that of the nearest ancestor
directory that has one; of several licence files in one directory the best match counts, then the
first path.

Defined results: a null or empty text has no unit; equal scores go to the licence that sorts first; a
null path inherits nothing; rows with one path are one file with several texts, and each row gets
the file's result; columns of other names are not read or pass through, and columns with a result's
name are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import cut_lineage

THRESHOLD = 0.7
#: A unit shares at least so many different words with its template.
LEAST_SHARED = 2
#: Scores are compared and returned with this many digits.
DIGITS = 4
#: A paragraph ends at a line without letters or digits.
PARAGRAPH_END = "\n[^a-zA-Z0-9\n]*\n"

_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
# Licence names, and the sentences, titles, headers and paragraphs by which files declare them.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "MIT License"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", _WARRANTY),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.0", "GNU Library General Public License Version 2, June 1991"),
    ("LGPL-2.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("Artistic-1.0", "The \"Artistic License\""),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD-3-Clause", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
]
LINE, PAIR, PARAGRAPH = range(3)


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits a-z, 0-9."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def units_of(text: Column) -> Column:
    """The lines, neighbouring lines and paragraphs of a text, as an array of (kind, place, content)."""

    def placed(kind: int, contents: Column) -> Column:
        return F.transform(contents, lambda content, place: F.struct(F.lit(kind).alias("kind"), place.alias("place"), content.alias("content")))

    lines = F.split(text, "\n")
    starts = F.when(F.size(lines) > 1, F.sequence(F.lit(0), F.size(lines) - 2)).otherwise(F.array().cast("array<int>"))
    pairs = F.transform(starts, lambda i: F.concat(F.get(lines, i), F.lit(" "), F.get(lines, i + 1)))
    return F.concat(placed(LINE, lines), placed(PAIR, pairs), placed(PARAGRAPH, F.split(text, PARAGRAPH_END)))


def inverse_frequency(total: int, df: Column) -> Column:
    return F.log((1 + F.lit(total)) / (1 + F.coalesce(df, F.lit(0)))) + 1


def document_frequencies(files: DataFrame, text: str) -> DataFrame:
    """(token, df) of every token over all files."""
    return files.select(F.explode(F.array_distinct(words_of(F.col(text)))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def template_weights(spark: SparkSession, files: DataFrame, text: str, templates: list[tuple[str, str]], total: int) -> DataFrame:
    """(template, licence, token, idf, tf, length): the templates' vectors with document frequencies from all files."""
    table = spark.createDataFrame([(i, *row) for i, row in enumerate(templates)], "template int, licence string, sentence string")
    terms = table.select("template", "licence", F.explode(words_of(F.col("sentence"))).alias("token")).groupBy("template", "licence", "token").agg(F.count("*").alias("tf"))
    vocabulary = F.array(*(F.lit(t) for t in sorted({t for _, s in templates for t in "".join(c if c.isalnum() else " " for c in s.lower()).split()})))
    held = files.select(F.explode(F.array_intersect(words_of(F.col(text)), vocabulary)).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    # The templates' words are a fixed list.
    rows = terms.join(F.broadcast(held), "token", "left").withColumn("idf", inverse_frequency(total, F.col("df")))
    length = F.sqrt(F.sum(F.pow(F.col("tf") * F.col("idf"), 2)).over(Window.partitionBy("template")))
    return rows.select("template", "licence", "token", "tf", "idf", length.alias("length"))


def anchors(weights: list, threshold: float) -> list[str]:
    """Words of which every unit that reaches the threshold with some template has at least one.

    For each template the most frequent words whose weights stay below the threshold's share are no anchors.
    """
    found: set[str] = set()
    for template in {row.template for row in weights}:
        own = sorted((row for row in weights if row.template == template), key=lambda row: (row.idf, row.token))
        most = (threshold - 10.0**-DIGITS) ** 2 * own[0].length ** 2
        light = 0.0
        for row in own:
            light += (row.tf * row.idf) ** 2
            if light >= most:
                found.add(row.token)
    return sorted(found)


def scan(files: DataFrame, *, path: str = "path", text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(path, licence, score, licence_file) of every file that declares a licence."""
    spark = files.sparkSession
    rows = files.select(F.col(path).alias("path"), F.col(text).cast("string").alias("text"))
    total = rows.count()
    # The templates' vectors are as small as the templates: they are worked out once and sent to all tasks.
    weights = template_weights(spark, rows, "text", templates, total).collect()
    literal = [(r.template, r.licence, r.token, int(r.tf), float(r.length)) for r in weights]
    table = F.broadcast(spark.createDataFrame(literal, "template int, licence string, token string, ttf int, length double"))
    marks = F.array(*(F.lit(t) for t in anchors(weights, threshold)))
    touched = rows.where(F.arrays_overlap(words_of(F.col("text")), marks) & F.col("path").isNotNull())
    units = touched.select("path", F.size(words_of(F.col("text"))).alias("size"), F.explode(units_of(F.col("text"))).alias("u")).select("path", "size", "u.kind", "u.place", words_of(F.col("u.content")).alias("words"))
    prints = [F.xxhash64(F.array_join("words", " "), F.lit(k)).alias(f"k{k}") for k in (1, 2)]
    units = cut_lineage(units.where(F.arrays_overlap("words", marks)).select("*", *prints))
    key = ["k1", "k2"]
    different = units.groupBy(*key).agg(F.first("words").alias("words"))
    terms = different.select(*key, F.explode("words").alias("token")).groupBy(*key, "token").agg(F.count("*").alias("tf"))
    terms = terms.join(document_frequencies(rows, "text"), "token", "left").withColumn("idf", inverse_frequency(total, F.col("df")))
    # Few and short after the anchors: every word counts in a unit's length, a template's words in its product.
    terms = cut_lineage(terms.select(*key, "token", "tf", "idf"))
    own = terms.groupBy(*key).agg(F.sqrt(F.sum(F.pow(F.col("tf") * F.col("idf"), 2))).alias("own"))
    dots = terms.join(table, "token").groupBy(*key, "template", "licence", "length").agg(
        F.sum(F.col("tf") * F.col("ttf") * F.col("idf") * F.col("idf")).alias("dot"), F.sum("tf").alias("long"), F.count("*").alias("shared")
    )
    score = F.round(F.col("dot") / (F.col("own") * F.col("length")), DIGITS)
    matched = dots.join(own, key).withColumn("score", score).where((F.col("score") >= threshold) & (F.col("shared") >= LEAST_SHARED))
    best = matched.groupBy(*key).agg(F.min(F.struct((-F.col("score")).alias("minus"), "licence", (-F.col("long")).alias("short"))).alias("b"))
    found = units.select("path", "size", "kind", *key).join(best, key)
    # Of a text's licences the one that covers most words, as lines, neighbouring lines or paragraphs: a stray line never beats a text.
    covered = [F.coalesce(F.sum(F.when(F.col("kind") == kind, -F.col("b.short"))), F.lit(0)).alias(name) for kind, name in ((LINE, "lines"), (PAIR, "pairs"), (PARAGRAPH, "paragraphs"))]
    claims = found.groupBy("path", "size", "b.licence").agg(*covered, F.min("b.minus").alias("minus"))
    claim = F.struct((-F.greatest("lines", "pairs", "paragraphs")).alias("less"), "minus", "licence")
    texts = claims.groupBy("path", "size").agg(F.min(claim).alias("b"), F.greatest(F.sum("lines"), F.sum("paragraphs")).alias("covered"))
    whole = F.max((2 * F.col("covered") >= F.col("size")).cast("int"))
    named = texts.groupBy("path").agg(F.min("b").alias("b"), whole.alias("whole"))
    return named.select("path", F.col("b.licence").alias("licence"), (-F.col("b.minus")).alias("score"), (F.col("whole") == 1).alias("licence_file"))


def parent(path: Column) -> Column:
    """The directory of a path: everything before the last slash."""
    return F.regexp_replace(path, "/[^/]*$", "")


def inherit(files: DataFrame, found: DataFrame, *, path: str = "path") -> DataFrame:
    """All columns of ``files`` with licence, score, origin (header, inherited, none) and licence_path."""
    files = files.drop("licence", "score", "origin", "licence_path")
    # A row's own columns ride along as one, so their names cannot clash with those used here.
    rows = files.select(F.struct(*(F.col(f"`{c}`") for c in files.columns)).alias("row"), F.col(path).alias("path"), parent(F.col(path)).alias("folder"))
    holders = found.where("licence_file").groupBy(parent(F.col("path")).alias("holder")).agg(F.min(F.struct((-F.col("score")).alias("minus"), "path", "licence")).alias("h"))
    folders = rows.where(F.col("path").isNotNull()).select("folder").distinct()
    steps = F.split("folder", "/")
    above = folders.select("folder", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))).alias("holder"))
    # Of the ancestors that hold a licence the longest is the nearest.
    near = above.join(holders, "holder").groupBy("folder").agg(F.max_by("h", F.length("holder")).alias("h"))
    named = found.select("path", F.col("licence").alias("own_licence"), F.col("score").alias("own_score"))
    joined = rows.join(named, "path", "left").join(near, "folder", "left")
    header = F.col("own_licence").isNotNull()
    return joined.select(
        *(F.col(f"row.`{c}`").alias(c) for c in files.columns),
        F.coalesce("own_licence", "h.licence").alias("licence"),
        F.when(header, F.col("own_score")).otherwise(-F.col("h.minus")).alias("score"),
        F.when(header, "header").when(F.col("h").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(header, F.col("path")).otherwise(F.col("h.path")).alias("licence_path"),
    )
