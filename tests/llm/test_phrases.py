"""Phrase collocations against brute force, and the trie that counts them."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import collocations
from tallyspark.llm.hat_trie import HatTrie


def brute_phrases(rows, least=30, top=2000):
    count, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for size in range(1, 5):
                count.update((lang, *words[i : i + size]) for i in range(len(words) - size + 1))
    candidates = {p: a for p, a in count.items() if len(p) > 2 and a >= least}
    out = set()
    for lang in {p[0] for p in candidates}:
        own = []
        for p, a in candidates.items():
            if p[0] != lang:
                continue
            words = p[1:]
            longer = [b for q, b in candidates.items() if q[0] == lang and len(q) > len(p) and any(q[i : i + len(words)] == words for i in range(1, len(q)))]
            if any(100 * b >= 80 * a for b in longer):
                continue
            cuts = []
            for k in range(1, len(words)):
                left, right = count[(lang, *words[:k])], count[(lang, *words[k:])]
                cuts.append((2000000 * a // (left + right), k, left, right))
            score, _, left, right = min(cuts)
            own.append((-score, -a, " ".join(words).encode(), left, right))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(own)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, total[lang], -s))
    return out


def found_phrases(docs, **options):
    rows = collocations.collocations(docs, **options)
    assert rows.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    rows = [tuple(r) for r in rows.collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


@pytest.mark.parametrize("limits", [{}, {"most": 40, "burst": 8, "partitions": 3}])
def test_phrases_equal_brute_force(spark, limits):
    """Few words, so that all phrases are frequent; small limits burst and spill."""
    rng = np.random.default_rng(3)
    words = ["der", "Die", "ÄB", "x", "日本", "the"]
    stops = [" ", " ", " ", "\t", ", ", "\x0b", " . "]
    rows = []
    for i in range(300):
        text = "".join(rng.choice(words, p=[0.4, 0.2, 0.1, 0.1, 0.1, 0.1]) + rng.choice(stops) for _ in range(40))
        rows.append(([None, "de", "en", "und"][i % 4], text))
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert found_phrases(docs, **limits) == brute_phrases(rows)
    assert found_phrases(docs, top=5, least=60, **limits) == brute_phrases(rows, 60, 5)


def test_phrases_odd(spark, odd_docs, no_docs):
    rows = [(r.lang, r.text) for r in odd_docs.collect()]
    more = [("x", "a b c d e " * 31), ("x", "a b c d e " * 31), ("x", None), (None, "p q! " * 60_000)]
    frame = spark.createDataFrame(more, "lang string, text string").withColumn("rank", F.lit("mine")).withColumn("w1", F.lit(1))
    docs = odd_docs.unionByName(frame, allowMissingColumns=True).withColumn("n", F.lit(1))
    assert found_phrases(docs) == brute_phrases(rows + more)
    assert found_phrases(no_docs) == set()


@pytest.mark.parametrize("most,burst", [(10_000, 4), (60, 8), (3, 2)])
def test_trie_counts_rows(most, burst):
    rng = np.random.default_rng(7)
    trie, want = HatTrie(3, most=most, burst=burst, partitions=5), Counter()
    ids = rng.integers(1, 1 << 63, 12).astype(np.uint64) * np.uint64(2)
    for _ in range(20):
        rows = ids[np.minimum(rng.geometric(0.3, (50, 3)), 12) - 1]
        rows[rng.random(50) < 0.3, 2] = 0
        want.update(map(tuple, rows.tolist()))
        trie.add(rows)
    got, seen = Counter(), []
    for rows, n in trie.merged(block=7):
        assert len(rows)
        got.update({tuple(r): k for r, k in zip(rows.tolist(), n.tolist())})
        seen += map(tuple, rows.tolist())
    assert got == want and seen == sorted(set(seen))
