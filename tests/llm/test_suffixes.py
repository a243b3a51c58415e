"""Induced sorting and removal of repeated strings against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import induced_sort, queries, suffix_dedup

SF = "/root/testdata/sf0.001"


def brute_order(symbols, most):
    """Sorted prefixes of all suffixes and the common prefixes of neighbours."""
    prefixes = sorted(tuple(symbols[i : i + most]) for i in range(len(symbols)))
    return prefixes, [0] + [next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(prefixes, prefixes[1:])]


@pytest.mark.parametrize("memory,block", [(4, 3), (16, 16), (100_000, 1 << 20)])
def test_suffixes_are_sorted(monkeypatch, memory, block):
    """Small memory makes the queue spill and the names recur."""
    monkeypatch.setattr(induced_sort, "BLOCK", block)
    monkeypatch.setattr(induced_sort, "HELD_BYTES", 10 * memory)
    rng = np.random.default_rng(memory)
    for trial in range(80):
        symbols = rng.integers(1, rng.integers(2, 6), rng.integers(1, 100))
        if trial % 3 == 0:
            symbols = np.tile(symbols[: max(1, len(symbols) // 4)], 5)
        if trial % 5 == 0:
            symbols = np.repeat(symbols, rng.integers(1, 9))
        symbols = np.append(symbols, 0).astype(np.uint16)
        most = int(rng.choice([6, 40, 1000]))
        order, common = induced_sort.suffix_order(symbols, most, memory)
        assert sorted(order.tolist()) == list(range(len(symbols)))
        prefixes, shared = brute_order(symbols.tolist(), most)
        assert [tuple(symbols[i : i + most].tolist()) for i in order] == prefixes
        assert common.tolist() == shared


def test_queue_keeps_order_under_a_key(monkeypatch):
    monkeypatch.setattr(induced_sort, "BLOCK", 4)
    rng = np.random.default_rng(2)
    for sign in (1, -1):
        queue, want = induced_sort.PriorityQueue(sign, 30), {}
        for start in range(0, 200, 10):
            keys = np.sort(rng.integers(0, 6, 10))
            queue.push(keys, (np.arange(start, start + 10), keys * 2))
            for key, value in zip(keys.tolist(), range(start, start + 10)):
                want.setdefault(key, []).append(value)
        for key in sorted(want, key=lambda k: sign * k):
            assert queue.first() == key
            parts = list(queue.pop())
            assert np.concatenate([p[0] for p in parts]).tolist() == want[key] and all((p[1] == 2 * key).all() for p in parts)
        assert queue.first() is None


def brute_repeats(texts, length=400):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        covered = np.zeros(len(b) + 1, np.int64)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                covered[i] += 1
                covered[i + length] -= 1
        covered = np.cumsum(covered)[: len(b)] > 0
        edge = np.flatnonzero(np.diff(np.concatenate(([0], covered, [0]))))
        out.append((list(zip(edge[::2].tolist(), edge[1::2].tolist())), bytes(np.frombuffer(b, np.uint8)[~covered])))
    return out


def found_repeats(docs, **options):
    rows = suffix_dedup.remove_repeats(docs, **options).select("id", "spans", "kept").collect()
    return {r.id: ([(s.start, s.stop) for s in r.spans], bytes(r.kept)) for r in rows}


SMALL = {"length": 20, "levels": (6, 16, 20)}


@pytest.mark.parametrize("options", [{}, {"hot_bytes": 50, "shard_bytes": 500}, {"shard_bytes": 3000, "memory": 16}])
def test_repeats_equal_brute_force(spark, monkeypatch, options):
    """Copies, shared passages of all lengths around the window's, periods, and other text around them."""
    if "hot_bytes" in options:
        monkeypatch.setattr(suffix_dedup, "HOT_SHARE", 1_000_000)
    rng = np.random.default_rng(5)
    letters = lambda n: "".join(rng.choice(list("abcdefghé "), n))
    passage = letters(40)
    texts = [letters(rng.integers(0, 60)) + passage[: rng.integers(15, 40)] + letters(rng.integers(0, 60)) for _ in range(60)]
    texts += [texts[0], texts[0], texts[3] + "x", "ab" * 40, "ab" * 15 + "c", "a" * 19, "a" * 20, "b" * 21, None, "", "é" * 30]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    assert found_repeats(docs, **SMALL, **options) == dict(enumerate(brute_repeats(texts, 20)))


def test_long_texts_are_cut_with_overlap(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup._text_slices, "__defaults__", (64,))
    rng = np.random.default_rng(6)
    long = "".join(rng.choice(list("abcdef"), 700))
    texts = [long, "xx" + long[100:350] + "yy", long[500:520], "short", long + long[:90]]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    got = found_repeats(docs, **SMALL)
    assert got == dict(enumerate(brute_repeats(texts, 20)))
    # Workers may cut otherwise than the driver, so the cut itself is tested here.
    import pyarrow as pa

    parts = list(suffix_dedup._text_slices(pa.array([long]), 20, 64))
    assert len(parts) == -(-681 // 64) and all(long.encode()[at : at + len(d)] == d.tobytes() for _, d, _, at in parts)


def test_repeats_odd(spark, odd_docs, no_docs):
    rows = odd_docs.collect()
    docs = odd_docs.withColumn("spans", F.lit("mine")).withColumn("fp", F.lit(3)).withColumn("id", F.monotonically_increasing_id())
    got = suffix_dedup.remove_repeats(docs)
    assert set(got.columns) == {*docs.columns, "kept"}
    want = Counter((r.doc_id, kept) for r, (_, kept) in zip(rows, brute_repeats([r.text for r in rows])))
    assert Counter((r.doc_id, bytes(r.kept)) for r in got.collect()) == want
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


def test_suffix_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for r, (spans, kept) in zip(docs, brute_repeats([r.text for r in docs])):
        size = len((r.text or "").encode())
        want[r.doc_id] = (size, size - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op11_suffix_dedup(spark, SF).collect()}
    assert got == want
