"""Language ID, toxicity, quality and licences: held-out accuracy, hand-made cases and odd tables."""

import itertools
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import language_id, licenses, quality, toxicity
from tallyspark.llm.common import remainder

SF1 = "/root/testdata/sf0.1"


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF1}/documents.parquet").where("doc_id < 3000")
    test = remainder("doc_id", 4) == 2
    model = language_id.LanguageMixture.fit(docs.where(~test))
    right = model.transform(docs.where(test).select("doc_id", "text", "lang")).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98


def test_language_mixture(docs):
    model = language_id.LanguageMixture.fit(docs)
    text = lambda lang: " ".join(r.text for r in docs.where(F.col("lang") == lang).limit(4).collect())[:1500]
    data = (text("de") + " " + text("fr")).encode()
    share = model.proportions(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0]
    assert 0.3 < share[model.languages.index("de")] < 0.7 and 0.3 < share[model.languages.index("fr")] < 0.7


def brute_language(texts, learned):
    """(prediction, score) of each text by plain counting and plain EM, one word at a time."""
    fold = {**{chr(c): chr(c + 32) for c in range(65, 91)}, **{chr(c): chr(c + 32) for c in range(0xC0, 0xDF) if c != 0xD7}}

    def words(text):
        raw = "".join(fold.get(c, c) for c in text).encode()
        return re.findall(rb"[A-Za-z\x80-\xff]+", raw)

    def grams(word):
        padded = b" " * (language_id.ORDER - 1) + word
        values = [int.from_bytes(padded[i : i + language_id.ORDER], "big") for i in range(len(word))]
        return [(v * 2654435761 % 2**32) >> (32 - language_id.BUCKET_BITS) for v in values]

    counts = {}
    for text, lang in learned:
        own = counts.setdefault(lang, Counter())
        own.update(g for w in words(text or "") for g in grams(w))
    kinds, buckets = sorted(counts), 1 << language_id.BUCKET_BITS
    logs = {k: (lambda c, total: lambda g: math.log((c[g] + 0.5) / total))(counts[k], sum(counts[k].values()) + 0.5 * buckets) for k in kinds}

    def em(likely, share, rounds):
        for _ in range(rounds):
            new = [0.0] * len(kinds)
            for row in likely:
                joint = [p * s for p, s in zip(row, share, strict=True)]
                for k, j in enumerate(joint):
                    new[k] += j / sum(joint) / len(likely)
            share = new
        return share, sum(math.log(max(sum(p * s for p, s in zip(row, share, strict=True)), 1e-300)) for row in likely)

    out = []
    for text in texts:
        scores = [[sum(logs[k](g) for g in grams(w)) for k in kinds] for w in words(text or "")]
        if not scores or not any(c.isalpha() for c in text):
            out.append(("und", 0.0))
            continue
        likely = [[math.exp(max(s - max(row), -60)) for s in row] for row in scores]
        share, _ = em(likely, [1 / len(kinds)] * len(kinds), 6)
        order = sorted(range(len(kinds)), key=lambda k: -share[k])
        best = None
        for size in range(1, len(kinds) + 1):
            start = [max(share[k], 1e-6) if k in order[:size] else 0.0 for k in range(len(kinds))]
            kept, value = em(likely, [s / sum(start) for s in start], 4 if size > 1 else 0)
            value -= size * math.log(len(likely) + 1)
            if best is None or value > best[0]:
                best = value, kept
        top = max(range(len(kinds)), key=lambda k: best[1][k])
        out.append((kinds[top], best[1][top]))
    return out


def test_language_equals_brute_force(docs):
    some = docs.where("doc_id < 60 and length(text) < 6000").unionByName(docs.sparkSession.createDataFrame([(900, None, None), (901, "", None), (902, "12 ÷ 3", "en"), (903, "ÉTÉ Straße das ist the end", None)], "doc_id long, text string, lang string"))
    rows = some.orderBy("doc_id").collect()
    want = brute_language([r.text for r in rows], [(r.text, r.lang) for r in rows if r.lang])
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.LanguageMixture.fit(some).transform(some).collect()}
    for row, (lang, score) in zip(rows, want, strict=True):
        assert got[row.doc_id][0] == lang and math.isclose(got[row.doc_id][1], score, abs_tol=1e-3), (row.doc_id, got[row.doc_id], lang, score)


def test_language_mixture_of_many(spark):
    letters = {"aa": "abcd", "bb": "efgh", "cc": "ijkl", "dd": "mnop", "ee": "qrst", "ff": "uvwx"}
    words = {lang: ["".join(w) for w in itertools.permutations(own, 3)] for lang, own in letters.items()}
    model = language_id.LanguageMixture.fit(spark.createDataFrame([(" ".join(w), lang) for lang, w in words.items()], "text string, lang string"))
    for number in range(1, 7):
        data = " ".join(w for lang in sorted(words)[:number] for w in words[lang]).encode()
        share = model.proportions(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0]
        assert np.allclose(share[:number], 1 / number, atol=0.02) and not share[number:].any()


def test_language_odd(odd_docs, no_docs):
    model = language_id.LanguageMixture.fit(odd_docs)
    rows = model.transform(odd_docs.drop("score").withColumn("lang_pred", F.lit(1))).collect()
    assert len(rows) == odd_docs.count()
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == {1, 2, 3, 5}
    assert all(0 <= r.score <= 1 for r in rows)
    assert [r.lang_pred for r in language_id.LanguageMixture.fit(no_docs).transform(odd_docs).collect()] == ["und"] * odd_docs.count()
    assert model.transform(no_docs).count() == 0


SYMBOL_OF = {"NOT": toxicity.NEGATION, "SAYS": toxicity.REPORT, "YOU": toxicity.TARGET, "w": toxicity.WORD, "IDIOT": toxicity.INSULT, "KILL": toxicity.THREAT}


def run_grammar(words):
    """The machine's tags for each word, and those of the clause's end."""
    state, tags = 0, []
    for w in words:
        tags.append(toxicity.GRAMMAR.emit[state][SYMBOL_OF[w]])
        state = toxicity.GRAMMAR.step[state][SYMBOL_OF[w]]
    return tags, toxicity.GRAMMAR.last[state]


def brute_tags(words):
    """The same by looking back and forth over the clause."""
    tags = []
    for i, w in enumerate(words):
        verb = max((k for k in range(i) if words[k] == "KILL"), default=None)
        threat = w == "YOU" and verb is not None and i - verb <= 3 and "YOU" not in words[verb + 1 : i]
        tag = toxicity.INSULTED * (w == "IDIOT") + toxicity.THREATENED * threat
        tags.append(tag + toxicity.NEGATED * ("NOT" in words[max(0, i - 4) : i]) + toxicity.REPORTED * ("SAYS" in words[:i]))
    return tags, toxicity.ADDRESSED * ("YOU" in words)


@pytest.mark.parametrize("length", range(6))
def test_grammar_equals_brute_force(length):
    for words in itertools.product(SYMBOL_OF, repeat=length):
        assert run_grammar(words) == brute_tags(words)


def test_grammar_scores_clauses():
    grammar = toxicity.ToxicityGrammar({b"idiot ": 5.0, b"moro": 5.0}, toxicity.PRIOR)
    weight = lambda text: grammar.features(text)[0]
    assert weight("you are an idiot. fine") == 5 and weight("an idiot here") == weight("an idiot, idiot here") == 4
    assert weight("you are not an idiot") == 0.5 and weight("he said you are an idiot") == 1.25
    assert weight("morons. You said so") == 4  # the target stands in another clause
    assert weight("they will kill you") == 5 and weight("it kills weeds, they kill time") == 0
    assert list(grammar.features("you moron and idiot! moron. fine")) == [14, 6, 2]
    forms = ["you are an idiot", "an idiot", "he said you are an idiot", "you are not an idiot", "she wrote that he was never an idiot", "a quiet day"]
    scores = grammar.score(forms)
    assert list(scores) == sorted(scores, reverse=True) and len(set(scores)) == len(forms)
    assert scores[1] >= 0.7 > scores[2] and max(grammar.score([None, ""])) < 0.3
    calm = "the harbour was calm and the boats went out. " * 200
    assert grammar.score([calm + "you are an idiot"])[0] >= 0.7 > max(grammar.score([calm + "you are not an idiot", calm + "he said you are an idiot"]))


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF1}/{t}.parquet") for t in ("documents", "labels"))
    test = remainder("doc_id", 3) == 1
    scored = toxicity.scores(docs.select("doc_id", "text"), labels, learn=docs.where(~test)).where(test).join(labels, "doc_id")
    rows = scored.select((F.col("score") >= 0.7).alias("p"), "toxic").collect()
    hit = np.mean([r.p for r in rows if r.toxic == 1])
    false = np.mean([r.p for r in rows if r.toxic == 0])
    assert hit > 0.85 and false < 0.01


def test_toxicity_odd(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1), (6, 0), (2, None)], "doc_id long, toxic int")
    for learn in (odd_docs, no_docs):
        rows = toxicity.scores(odd_docs, labels, learn=learn).collect()
        assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.scores(no_docs, labels, learn=odd_docs).count() == 0


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF1}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.where("doc_id < 4000").select("doc_id", "text")
    test = remainder("doc_id", 4) == 2
    model = quality.fit(docs, labels, learn=docs.where(~test), sample_per_label=400)
    rows = model.transform(docs.where(test)).join(labels, "doc_id").select((F.col("score") >= 0.7).alias("p"), "quality").collect()
    assert np.mean([r.p == (r.quality == 1) for r in rows]) > 0.95


def test_quality_votes_equal_brute_force(docs, spark):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = quality.fit(docs, labels, learn=docs, sample_per_label=50)
    texts = [r.text.encode() for r in docs.orderBy("doc_id").limit(20).collect()]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    counts = quality.term_counts(data, ends)
    own = model.latent(counts)
    expected = []
    for row in own:
        cosine = np.array([float(row @ v) for v in model.vectors])
        near = np.argsort(-cosine)[: model.neighbours]
        weight = np.maximum(cosine[near], 0) ** 8 * model.votes[near] + 1e-9
        expected.append((weight * model.labels[near]).sum() / weight.sum())
    assert np.allclose(model.score(counts), expected, atol=1e-4)


def test_quality_odd(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1), (6, 0)], "doc_id long, quality int")
    for learn in (odd_docs, no_docs):
        rows = quality.fit(odd_docs, labels, learn=learn).transform(odd_docs).collect()
        assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.fit(no_docs, labels, learn=no_docs).transform(no_docs).count() == 0


def test_license_inheritance(spark):
    rows = [
        ("/a/b/LICENSE", "Released under the MIT License."), ("/a/b/c/x.py", "print(1)"), ("/a/b/c/y.py", "# Licensed under CC BY-NC 4.0.\n" + "word " * 50),
        ("/a/z.py", "nothing"), ("/LICENSE", "Licensed under the Apache License, Version 2.0."), ("/a/b/c/d/LICENSE", "All rights reserved."), ("/a/b/c/d/e/f.txt", ""),
        (None, "Released under the MIT License."), ("/a/n.txt", None), ("/a/b/c/x.py", "print(1)"), ("/q.txt", "the license of the work is under this version"),
    ]
    files = spark.createDataFrame(rows, "path string, text string").withColumn("licence", F.lit("clash"))
    out = licenses.inherit(files, licenses.scan(files)).select("path", "licence", "origin", "licence_path").collect()
    got = {r.path: (r.licence, r.origin, r.licence_path) for r in out}
    assert len(out) == len(rows)
    assert got["/a/b/c/x.py"] == ("MIT", "inherited", "/a/b/LICENSE")
    assert got["/a/b/c/y.py"] == ("CC-BY-NC-4.0", "header", "/a/b/c/y.py")
    assert got["/a/z.py"] == ("Apache-2.0", "inherited", "/LICENSE") and got["/a/n.txt"][0] == "Apache-2.0"
    assert got["/a/b/c/d/e/f.txt"] == ("Proprietary", "inherited", "/a/b/c/d/LICENSE")
    assert got[None] == (None, "none", None)
    assert licenses.scan(files.where("false")).count() == 0


def test_license_counts_unrelated_words(spark, docs):
    rows = [
        ("/n/news.txt", "The hotel said that all rooms were reserved while voting rights groups met downtown"),
        ("/n/novel.txt", "the author released a new novel about MIT students and their driving license"),
        ("/m/x.txt", "Released under the MIT License."),
        ("/n/plain.txt", "print(1)"),
    ]
    files = docs.select(F.concat(F.lit("/d/"), "doc_id").alias("path"), "text").unionByName(spark.createDataFrame(rows, "path string, text string"))
    found = {r.path: r.licence for r in licenses.inherit(files, licenses.scan(files)).collect()}
    assert [found[path] for path, _ in rows] == [None, None, "MIT", None]


MIT_FILE = """MIT License

Copyright (c) 2024 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""


def test_license_files_and_wrapped_headers(spark, docs):
    rows = [
        ("/p/LICENSE", MIT_FILE), ("/p/src/a.py", "print(1)"), ("/q/b.py", "# Licensed under the Apache\n# License, Version 2.0\nimport os\n"),
        ("/r/c.py", "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n#\nimport os\n"),
        ("/s/staff.txt", "All staff reserved seats; rights holders objected to many other completely unrelated matters during a long meeting"), ("/t/big.txt", "word " * 200_000 + "\nMIT License\n" + "word " * 1000),
        ("/u/one.txt", "license"), ("/v/spdx.c", "// SPDX-License-Identifier: Apache-2.0\nint x;"),
    ]
    files = docs.select(F.concat(F.lit("/d/"), "doc_id").alias("path"), "text").unionByName(spark.createDataFrame(rows, "path string, text string"))
    files = files.selectExpr("*", "1 as h", "2 as own_licence", "3 as folder", "4 as row", "5 as score", "6 as `dotted.name`")
    out = licenses.inherit(files, licenses.scan(files))
    assert out.columns == ["path", "text", "h", "own_licence", "folder", "row", "dotted.name", "licence", "score", "origin", "licence_path"]
    got = {r.path: (r.licence, r.origin) for r in out.collect()}
    assert [got[path] for path, _ in rows] == [("MIT", "header"), ("MIT", "inherited"), ("Apache-2.0", "header"), ("GPL-3.0", "header"), (None, "none"), ("MIT", "header"), (None, "none"), ("Apache-2.0", "header")]


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.9])
def test_license_anchors_are_safe(spark, docs, threshold):
    weights = licenses.template_weights(spark, docs, "text", licenses.TEMPLATES, docs.count()).collect()
    anchors = set(licenses.anchors(weights, threshold))
    for template in {w.template for w in weights}:
        own = [w for w in weights if w.template == template]
        light = sum((w.tf * w.idf) ** 2 for w in own if w.token not in anchors) ** 0.5
        assert light / own[0].length < threshold


def test_nearest_takes_the_first_of_equals():
    values = np.random.default_rng(4).integers(0, 4, (60, 30)) / 4
    for number in (1, 7, 30):
        want = np.sort(np.argsort(-values, axis=1, kind="stable")[:, :number], axis=1)
        assert (np.sort(quality.nearest(values, number), axis=1) == want).all()


#: Titles, notices and stray lines of licence texts, and the licence that each text is under.
SIBLINGS = [
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE\n   Version 2, June 1991\n\nEveryone is permitted to copy verbatim copies.\n\nAll rights reserved."),
    ("GPL-2.0", "# This program is free software; you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation; either version 2 of the License, or\n# (at your option) any later version.\n"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\nEveryone may copy."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE\n   Version 2.1, February 1999\n\nEveryone may copy."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\nEveryone may copy."),
    ("MPL-2.0", "Mozilla Public License Version 2.0\n==================================\n\nDefinitions"),
    ("BSD-3-Clause", "Copyright The Regents of a place.\nAll rights reserved.\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:\n\nmore"),
    ("Proprietary", "Some words of ours.\nAll rights reserved.\nMore words of ours."),
]


def test_sibling_licences_and_stray_lines(spark):
    files = spark.createDataFrame([(f"/p/f{i}", text) for i, (_, text) in enumerate(SIBLINGS)] + [(f"/q/g{i}", "plain words here") for i in range(30)], "path string, text string")
    found = {r.path: r.licence for r in licenses.scan(files).collect()}
    assert found == {f"/p/f{i}": name for i, (name, _) in enumerate(SIBLINGS)}
