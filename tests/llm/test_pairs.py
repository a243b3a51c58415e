"""Joins, searches, packing, encoding and language modelling against brute force."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import common, gru, lattice_dedup, lm_scoring, ngram_join, packing, pieces, queries, topk_search
from tallyspark.llm.common import remainder
from tallyspark.llm.components import connected_components

SF = "/root/testdata/sf0.001"
SF2 = "/root/testdata/sf0.01"
BPE = "byte_bpe_50k.json"


def tokenizer(name):
    import public_tokenizers

    return public_tokenizers.path(name)


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def brute_links(rows):
    sets = {}
    for i, text in rows:
        w = (text or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    out, ids = set(), sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and len(sets[a] & sets[b]) * 10 >= 8 * len(sets[a] | sets[b]):
                out.add((a, b))
    return out


def check_join(rows, result):
    links = brute_links(rows)
    ids = [i for i, _ in rows]
    count = Counter(i for pair in links for i in pair)
    component = roots(ids, links)
    assert {r.doc_id: (r.n_links, r.component_id, r.kept) for r in result} == {i: (count[i], component[i], component[i] == i) for i in ids}


def test_join_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF2}/documents.parquet").select("doc_id", "text")
    check_join([(r.doc_id, r.text) for r in docs.collect()], ngram_join.jaccard_join(docs).collect())


def test_join_of_large_groups_in_blocks(spark):
    rng = np.random.default_rng(0)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(90):
        words = list(base)
        for at in rng.choice(120, rng.integers(0, 4), replace=False):
            words[at] = f"x{rng.integers(0, 9)}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, rows[0][1].upper()) for i in range(20)] + [(200, ""), (201, None), (202, "one two"), (203, "One  two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_links", F.lit(1))
    check_join(rows, ngram_join.jaccard_join(docs, block=16).collect())


def test_join_odd(odd_docs, no_docs):
    rows = ngram_join.jaccard_join(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert sorted(r.n_links for r in rows if r.copy_id == 4) == [2, 2, 2]
    assert all(r.n_links == 0 and r.kept for r in rows if r.doc_id in (1, 2, 3))
    assert ngram_join.jaccard_join(no_docs).count() == 0


def brute_rows(linked, ids):
    """(id, links, component's smallest id, kept) of every row, whatever ids repeat; null ids sort last."""
    root = roots(range(len(ids)), [(i, j) for i in range(len(ids)) for j in range(i) if linked(i, j)])
    out = []
    for i, own in enumerate(ids):
        group = [ids[j] for j in range(len(ids)) if root[j] == root[i] and ids[j] is not None]
        name = min(group, default=None)
        out.append((own, sum(linked(i, j) for j in range(len(ids)) if j != i), name, name == own))
    return Counter(out)


def test_join_of_repeated_and_null_ids(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a), (1, b), (2, b + " tail"), (3, a + " tail"), (None, a + " end"), (None, c), (None, c + " end"), (7, None), (7, ""), (1, a)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1)).withColumn("rep", F.lit("x"))
    linked = lambda i, j: (min(i, j), max(i, j)) in links
    links = brute_links([(i, text) for i, (_, text) in enumerate(rows)])
    got = Counter((r.doc_id, r.n_links, r.component_id, r.kept) for r in ngram_join.jaccard_join(frame).collect())
    assert got == brute_rows(linked, [i for i, _ in rows])


def test_lattice_of_repeated_and_null_ids(spark):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((3, 64))
    near = base + 0.05 * rng.standard_normal((3, 64))
    rows = [(1, base[0]), (1, base[1]), (2, near[1]), (3, base[0]), (None, near[0]), (None, base[2]), (None, near[2]), (1, base[0])]
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>").withColumn("node", F.lit(1)).withColumn("id", F.lit("x"))
    cosine = lambda x, y: float(x @ y / np.sqrt((x @ x) * (y @ y)))
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in lattice_dedup.lattice_dedup(frame).collect())
    assert got == brute_rows(lambda i, j: cosine(rows[i][1], rows[j][1]) >= 0.95, [i for i, _ in rows])


def test_sieve_marks_every_id(spark, monkeypatch):
    monkeypatch.setattr(common, "SIEVE_WORDS", 64)
    rows, ids = spark.range(3000).withColumn("x", F.lit(1)), spark.range(0, 3000, 7)
    assert common.matching_rows(rows, ids, "left_semi").count() == 429 and common.matching_rows(rows, ids, "left_anti").count() == 3000 - 429
    marked = common.sieved(rows, ids).where("__maybe").count()
    assert 429 <= marked < 3000


def test_bands_reach_recall():
    bands, rows = ngram_join.choose_bands()
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and bands * rows <= 160


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(400, 460)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    expected = roots({n for e in edges for n in e}, edges)
    assert got == {n: c for n, c in expected.items() if any(n in e and e[0] != e[1] for e in edges)}


def vectors_of(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((150, 64))
    near = base[:40] + 0.2 * rng.standard_normal((40, 64))
    group = base[0] + 0.1 * rng.standard_normal((60, 64))
    whole = np.concatenate((base, near, group, base[:5]))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(whole)]
    odd = [(900, None), (901, [0.0] * 64), (902, [float("nan")] * 64), (903, [None] + [1.0] * 63), (904, [1.0, 2.0]), (905, []), (906, [float("inf")] * 64)]
    return whole, spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("label", F.lit(0))


def test_lattice_dedup(spark):
    whole, frame = vectors_of(spark)
    unit = whole / np.linalg.norm(whole, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.95
    np.fill_diagonal(close, False)
    rows = {r.vec_id: r for r in lattice_dedup.lattice_dedup(frame, block=32).collect()}
    found = np.array([rows[i].n_links for i in range(len(whole))])
    assert (found <= close.sum(axis=1)).all() and found.sum() >= 0.98 * close.sum()
    component = roots(range(len(whole)), [tuple(map(int, p)) for p in np.argwhere(close)])
    assert np.mean([rows[i].component_id == component[i] for i in range(len(whole))]) > 0.97
    assert all(rows[i].n_links == 0 and rows[i].component_id == i and rows[i].kept for i in range(900, 907))
    assert lattice_dedup.lattice_dedup(frame.where("false")).count() == 0


def test_lattice_points():
    rng = np.random.default_rng(3)
    around = lattice_dedup.minimal_vectors()
    assert len(around) == 240 and np.allclose((around**2).sum(axis=1), 2)
    x = rng.standard_normal((500, 8)) * 2
    point = lattice_dedup.nearest_e8(x)
    near = np.concatenate((np.zeros((1, 8)), around))
    # No neighbour of the decoded point is nearer, and all lie within the covering radius.
    distance = ((x[:, None] - point[:, None] - near) ** 2).sum(axis=2)
    assert (distance.argmin(axis=1) == 0).all() and distance[:, 0].max() <= 1 + 1e-9


def test_topk_equals_brute_force(spark):
    frame = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = sorted((r.vec_id, r.embedding) for r in frame.collect())
    z = np.floor(256 * np.array([v for _, v in rows], float))
    ids = np.array([i for i, _ in rows])
    expected = []
    for q in np.flatnonzero(ids % 50 == 0):
        score = z @ z[q]
        order = [j for j in np.lexsort((ids, -score)) if j != q][:5]
        expected += [(ids[q], k + 1, ids[j], int(score[j])) for k, j in enumerate(order)]
    got = topk_search.top_k(frame, F.col("id") % 50 == 0).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == expected


def test_topk_odd(spark):
    _, frame = vectors_of(spark)
    rows = topk_search.top_k(frame, F.col("id").isin(0, 900, 902, 904, 905), k=3).collect()
    assert {r.query_id for r in rows} == {0} and len(rows) == 3
    small = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r.rank, r.vec_id) for r in topk_search.top_k(small, F.col("id") == 0).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert topk_search.top_k(small.where("false"), F.col("id") == 0).count() == 0


def test_topk_skips_blocks_and_fills_parts(spark):
    rng = np.random.default_rng(8)
    # Candidates at many levels: only the highest can answer a query of positive mean.
    level = np.linspace(-4, 4, 4000)[:, None]
    whole = level + 0.2 * rng.standard_normal((4000, 32))
    z = np.floor(256 * whole)
    queries, ids = z[3990:], np.arange(4000)
    least = np.array([np.sort(np.delete(z @ q, 3990 + n))[-5] for n, q in enumerate(queries)])
    far, near = (topk_search.block_top(queries, ids[3990:], z[part], ids[part], 5, least) for part in (slice(0, 1024), slice(2976, 4000)))
    assert far[3] == 0 and len(far[0]) == 0  # the envelope alone rules the block out
    assert 50 <= near[3] < 10 * 1024
    frame = spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in enumerate(whole)], "vec_id long, embedding array<double>")
    got = topk_search.top_k(frame, F.col("id") % 50 == 0).orderBy("query_id", "rank").collect()
    expected = []
    for q in range(0, 4000, 50):
        score = z @ z[q]
        expected += [(q, k + 1, j, int(score[j])) for k, j in enumerate([j for j in np.lexsort((ids, -score)) if j != q][:5])]
    assert [tuple(r) for r in got] == expected


def test_topk_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 2.0]), (1, [1.0, 0.0]), (1, [3.0, 0.0]), (2, [0.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash")).withColumn("d", F.lit(1))
    got = topk_search.top_k(frame, F.col("id") == 0, k=3).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 3 * 65536), (2, 2 * 65536), (1, 65536)]


def brute_best_fit(lengths, capacity):
    import bisect

    free, number = [], 0
    for length in sorted(lengths, reverse=True):
        at = bisect.bisect_left(free, length)
        room = free.pop(at) if at < len(free) else capacity
        number += room == capacity and True
        bisect.insort(free, room - length)
    return number


@pytest.mark.parametrize("seed", range(4))
def test_plan_equals_best_fit(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 101, 700) if seed else rng.choice([34, 51, 17, 100], 500)
    steps = packing.plan(dict(Counter(lengths.tolist())), 100)
    bins, used = {}, Counter()
    for length, first, number, bin_, each, offset in steps:
        assert first == used[length]
        used[length] += number
        for i in range(number):
            at = bins.setdefault(bin_ + i // each, [])
            assert sum(at) == offset + i % each * length
            at.append(length)
    assert used == Counter(lengths.tolist()) and max(map(sum, bins.values())) <= 100
    assert len(bins) == brute_best_fit(lengths.tolist(), 100)


def check_packing(rows, result):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer(BPE))
    ids = {i: np.array([*model.encode(text or "", add_special_tokens=False).ids, 0], "<u4") for i, text in rows}
    assert sum(r.length for r in result) == sum(len(ids[i]) for i, _ in rows)
    ends = Counter()
    for r in sorted(result, key=lambda r: (r.sequence_id, r.offset)):
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        assert ends[r.sequence_id] == r.offset
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 2048
    return len(ends)


def test_packing_round_trip(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    result = packing.pack(docs, tokenizer(BPE)).collect()
    assert check_packing(rows, result) == brute_best_fit([r.length for r in result], 2048)


def test_packing_odd(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    check_packing(rows, packing.pack(odd_docs, tokenizer(BPE)).collect())
    assert packing.pack(no_docs, tokenizer(BPE)).count() == 0


def test_packing_query_gives_added_tokens_their_ids(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = [(1, "see <|endoftext|> here"), (2, "<|endoftext|>"), (3, " a <|endoftext|><|endoftext|>\n"), (4, "<|EndOfText|>"), (5, "plain words")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    model = Tokenizer.from_file(tokenizer(BPE))
    found = {r.doc_id: (r.length, r.ids_crc32) for r in queries.op10_best_fit_packing(spark, str(tmp_path)).collect()}
    ids = {i: np.array([*model.encode(text, add_special_tokens=False).ids, 0], "<u4") for i, text in rows}
    assert found == {i: (len(x), zlib.crc32(x.tobytes())) for i, x in ids.items()}


def test_pieces_equal_library(docs):
    import sentencepiece

    model = pieces.PieceModel.load(tokenizer("piece_bpe_32k.model"))
    proto = pytest.importorskip("sentencepiece.sentencepiece_model_pb2").ModelProto()
    proto.ParseFromString(open(tokenizer("piece_bpe_32k.model"), "rb").read())
    proto.trainer_spec.model_type = 1
    for i, piece in enumerate(proto.pieces):
        piece.score = float(model.scores[i])
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    texts = [r.text for r in docs.collect()] + [" a  b ", "日本語 😀\t\n", "x" * 5000, " "]
    for text, ids in zip(texts, pieces.Encoder(model).encode(texts), strict=True):
        own, theirs = np.frombuffer(ids, "<i4").tolist(), library.encode(text)
        # Equal scores may be cut differently; the library adds them up in single precision.
        assert own == theirs or math.isclose(model.scores[own].sum(dtype=float), model.scores[theirs].sum(dtype=float), rel_tol=1e-5)
        assert library.decode(own) == text


def best_score(model, word):
    """The largest total score of a word's segmentations, by the plain recursion over its bytes."""
    known = {piece.encode(): model.scores[i] for i, piece in enumerate(model.pieces) if i not in set(model.byte_ids.tolist())}
    best = [0.0] + [-math.inf] * len(word)
    for start in range(len(word)):
        if word[start] & 0xC0 != 0x80:
            for stop in range(start + 1, min(len(word), start + model.longest) + 1):
                if word[start:stop] in known:
                    best[stop] = max(best[stop], best[start] + known[word[start:stop]])
    return best[-1]


def test_long_unspaced_words_are_exact(spark, monkeypatch):
    model = pieces.PieceModel.load(tokenizer("piece_bpe_32k.model"))
    rng = np.random.default_rng(10)
    words = ["".join(chr(c) for c in rng.integers(97, 123, n)) for n in (20_000, 3000, 3000, 40)]
    for places in (pieces.PLACES, 5000):
        monkeypatch.setattr(pieces, "PLACES", places)
        for word, ids in zip(words, pieces.Encoder(model).encode(words), strict=True):
            own = np.frombuffer(ids, "<i4")
            assert math.isclose(model.scores[own].sum(), best_score(model, ("▁" + word).encode()), rel_tol=1e-12)
            assert "".join(model.pieces[i] for i in own) == "▁" + word


@pytest.mark.parametrize("ids", [[32_000_000], [-1], [None, 5]])
def test_decode_refuses_invalid_ids(spark, ids):
    model = pieces.PieceModel.build(["<unk>", "▁a", "b"], [0.0, -1.5, -2.5], [True, False, False])
    with pytest.raises(Exception, match="beyond the vocabulary"):
        pieces.decode(spark.createDataFrame([(ids,)], "ids array<int>"), model).collect()


def test_trie_holds_its_keys():
    rng = np.random.default_rng(4)
    keys = {bytes(rng.integers(97, 101, rng.integers(1, 7)).tolist()): i for i in range(300)}
    trie = pieces.DoubleArrayTrie(keys.items())

    def find(key):
        node = 0
        for c in key:
            following = trie.base[node] + c
            if trie.check[following] != node:
                return -1
            node = following
        return trie.leaf[node]

    assert {k: find(k) for k in keys} == keys


def test_pieces_round_trip(odd_docs, no_docs):
    model = pieces.PieceModel.load(tokenizer("piece_bpe_32k.model"))
    rows = pieces.decode(pieces.encode(odd_docs, model), model).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.decoded == (r.text if r.text is None else r.text.replace("▁", " ")) for r in rows)
    assert [r.ids for r in rows if r.text is None] == [None] and [r.ids for r in rows if r.text == ""] == [[]]
    assert pieces.encode(no_docs, model).count() == 0


def test_gradients():
    shape = gru.Shape(6, 3, 2)
    p = {k: v.astype(np.float64) for k, v in gru.initial(shape, np.ones(8)).items()}
    rng = np.random.default_rng(5)
    inputs, targets = rng.integers(0, 8, (2, 4, 3))
    fresh = rng.random((4, 3)) < 0.3
    h = rng.standard_normal((gru.HIDDEN, 3))
    live = rng.random((4, 3)) < 0.8
    g, _, _ = gru.gradients(p, shape, inputs, targets, fresh, h, live)
    for name in p:
        for at in rng.integers(0, p[name].size, 6):
            sides = []
            for step in (1e-5, -1e-5):
                q = {k: v.copy() for k, v in p.items()}
                q[name].ravel()[at] += step
                sides.append(gru.gradients(q, shape, inputs, targets, fresh, h, live)[2])
            assert math.isclose(g[name].ravel()[at], (sides[0] - sides[1]) / 2e-5, rel_tol=1e-3, abs_tol=1e-6), name


def test_model_sums_to_one_and_carries_state(monkeypatch):
    shape = gru.Shape(5, 3, 2)
    p = gru.initial(shape, np.arange(1.0, 8.0))
    p["gates"] *= 3
    states = np.random.default_rng(6).standard_normal((4, gru.HIDDEN)).astype(np.float32)
    total = sum(np.exp(gru.log_probability(p, shape, states, np.full(4, s))) for s in range(7))
    assert np.allclose(total, 1, atol=1e-3)
    text = np.random.default_rng(7).integers(1, 7, 3 * gru.WINDOW + 5)
    h, last, expected = np.zeros((gru.HIDDEN, 1), np.float32), 0, 0.0
    for symbol in [*text, 0]:
        h = gru._step(p["gates"], gru._inputs(p, np.array([[last]]))[0], h)[0]
        expected += gru.log_probability(p, shape, h.T, np.array([symbol]))[0]
        last = symbol
    for lanes in (1, 2, 256):
        monkeypatch.setattr(gru, "LANES", lanes)
        scores = gru.text_scores(p, shape, [text[:3], text, text[:0], text])
        assert math.isclose(scores[1], expected, rel_tol=1e-5) and math.isclose(scores[3], expected, rel_tol=1e-5)
        assert math.isclose(scores[2], gru.text_scores(p, shape, [text[:0]])[0], rel_tol=1e-5)


def test_training_counts_every_symbol():
    shape = gru.Shape(5, 3, 2)
    start = gru.initial(shape, np.ones(7))
    # The last symbols of the stream are the only ones of their kind.
    texts = [np.array([1, 2] * 40), np.array([1, 2] * 40), np.array([4])]
    for seed in range(4):
        learned, seen = gru.train(start, shape, texts, lanes=5, seed=seed)
        assert seen == 164 and learned["inputs"][4].tolist() != start["inputs"][4].tolist()


def test_lm_scores(spark):
    docs = spark.read.parquet(f"{SF2}/documents.parquet").select("doc_id", "text")
    learn = remainder("doc_id", 7) != 2
    rows = {r.doc_id: r for r in lm_scoring.lm_scores(docs, learn).collect()}
    texts = {r.doc_id: r.text.encode().lower().split() + [b""] for r in docs.collect()}
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 7 == 2}
    count = Counter(w for i, t in texts.items() if i not in held for w in t)
    total, kinds = sum(count.values()), len(count)
    for i, text in texts.items():
        base = sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in text)
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(text), sum(count[w] > 0 for w in text), total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
    assert sum(rows[i].score for i in held) > sum(rows[i].base_score for i in held)


def test_lm_odd(odd_docs, no_docs):
    rows = lm_scoring.lm_scores(odd_docs, F.lit(True)).collect()
    assert len(rows) == odd_docs.count() and all(r.score < 0 and r.base_score < 0 for r in rows)
    assert [r.n_tokens for r in rows if r.doc_id == 1] == [1]
    assert lm_scoring.lm_scores(odd_docs, F.lit(False)).count() == odd_docs.count()
    assert lm_scoring.lm_scores(no_docs, F.lit(True)).count() == 0


def test_lm_learns_from_every_document(spark):
    # Beyond 2,000 documents the ones of larger id hash count too: only they hold the pair "ccc ddd".
    docs = spark.range(8000).select(F.col("id").alias("doc_id"))
    late = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) >= 250_000
    docs = docs.withColumn("text", F.when(late, F.repeat(F.lit("ccc ddd "), 100)).otherwise(F.repeat(F.lit("aaa bbb "), 100)))
    docs = docs.unionByName(spark.createDataFrame([(9000, "ccc ddd " * 100)], docs.schema))
    row = lm_scoring.lm_scores(docs, F.col("doc_id") < 9000).where("doc_id = 9000").first()
    assert row.score > 0.2 * row.base_score
