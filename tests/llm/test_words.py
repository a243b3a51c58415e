"""Spelling variants against brute force."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import spelling

SF = "/root/testdata/sf0.001"


def brute_spelling(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 5:
                count[word] += 1
    count = {w: n for w, n in count.items() if n >= 3}
    near, holes = {w: set() for w in count}, {}
    for w in count:
        for k in range(len(w)):
            holes.setdefault((w[:k], w[k + 1 :]), []).append(w)
            if (shorter := w[:k] + w[k + 1 :]) in count:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in holes.values():
        for w in group:
            near[w].update(x for x in group if x != w)
    best = {w: min(near[w], key=lambda x: (-count[x], x)) for w in count if near[w]}
    form = {w: b for w, b in best.items() if count[b] >= 2 * count[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), count[w], len(near[w]), count.get(form.get(w))) for w in count}


def found_spelling(docs, **options):
    rows = spelling.spelling_groups(docs, **options).collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_spelling_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert found_spelling(docs) == brute_spelling([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("hot", [4, 100])
def test_spelling_of_hot_groups_and_accents(spark, hot):
    """Words over few letters, so that groups are dealt down to single positions."""
    rng = np.random.default_rng(hot)
    words = ["".join(rng.choice(list("abé×"), rng.integers(5, 9))) for _ in range(400)]
    rows = [(i, " ".join(rng.choice(words, 60)) + ", ABABABÉ") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found_spelling(docs, hot=hot, pack=8) == brute_spelling(rows)


def test_spelling_odd(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    long = [(11, "lettersss" * 200_000 + " wordy words wordyy"), (12, "wordy wordy.words WORDS Wordyy wordyy wordyy"), (None, "wordyy wordyx")]
    more = spark.createDataFrame(long, "doc_id long, text string").withColumn("n", F.lit("mine")).withColumn("form", F.lit(1))
    docs = odd_docs.unionByName(more, allowMissingColumns=True)
    assert found_spelling(docs) == brute_spelling(rows + long)
    assert found_spelling(no_docs) == {}


def test_long_texts_are_cut_between_words(monkeypatch):
    import pyarrow as pa

    from tallyspark.llm.common import bounded_slices

    text = "alpha beta " * 50 + "x" * 300 + " gamma"
    parts = list(bounded_slices(pa.array(["ab", text, None, "c"]), spelling._CUT, 100))
    assert b"".join(d.tobytes() for _, d, _ in parts).decode() == "ab" + text + "c"
    assert all(len(d) <= 400 and (len(r) > 1 or d[-1] == 32 or d.tobytes() in (b"ab", b" gamma", b"gamma", b"c")) for r, d, _ in parts)


def test_run_crcs():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    lengths = np.array([1, 5, 64, 65, 300, 2, 9])
    starts = np.array([0, 7, 20, 100, 400, 900, 4000])
    before = np.array([zlib.crc32(b"%d:" % k) for k in range(7)], np.uint32)
    want = [zlib.crc32(b"%d:" % k + data[s : s + n].tobytes()) for k, (s, n) in enumerate(zip(starts, lengths))]
    assert spelling.run_crcs(data, starts, lengths, before).tolist() == want
