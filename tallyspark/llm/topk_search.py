"""Exact top-k search by multi-resolution segment statistics.

Every vector keeps the means and deviations of its segments at several resolutions.  For two
vectors the segments bound the squared distance from below by the sum of m * ((mean difference)^2 +
(deviation difference)^2), m being the segment's length; with the vectors' norms this bounds the
inner product from above.

Candidates are ordered by their mean and packed into blocks that carry the envelope of their segment
statistics.  First every block of queries meets the few candidate blocks with the best envelope
bounds, which gives each query a k-th best score that holds for the whole table.  Then the query
blocks, with these thresholds, meet all candidate blocks: queries whose threshold a block's envelope
cannot reach skip it, each finer resolution removes pairs, and the exact integer score is computed
for the survivors only.  Blocks shuffle on a hash of the candidate block into parts whose number
grows with the table.

Defined results: a vector that is null or holds a null or non-finite component takes no part;
vectors of different lengths are not compared; rows with the query's own id are the query's own;
other repeated rows are candidates of their own, and of equal scores the smaller id comes first;
repeated query rows with equal vectors count as one query, and the answers to different vectors of
one query id are ranked together; columns of other names are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import cut_lineage

QUERY_BLOCK = 512
CANDIDATE_BLOCK = 1024
#: Candidate blocks of one part, which a query block is sent to once.
BLOCKS_TOGETHER = 8
#: Candidate blocks that give the first thresholds of a query block.
FIRST_BLOCKS = 4
#: Numbers of segments, coarse to fine.
RESOLUTIONS = (1, 4, 16)


def segment_features(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, scaled so that the product of two rows is the bound."""
    edges = np.unique(np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int))
    size = np.diff(edges)
    mean = np.add.reduceat(x, edges[:-1], axis=1) / size
    square = np.add.reduceat(x * x, edges[:-1], axis=1) / size
    spread = np.sqrt(np.maximum(square - mean * mean, 0))
    return np.concatenate((mean * np.sqrt(size), spread * np.sqrt(size)), axis=1)


def envelope_bound(features: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The most that the product of each row with any vector between ``low`` and ``high`` can be."""
    return np.maximum(features, 0) @ high + np.minimum(features, 0) @ low


def _products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the pairs (i, j): in one block if most pairs are asked for, else one by one."""
    if 8 * len(i) > len(a) * len(b):
        return (a @ b.T)[i, j]
    return np.concatenate([np.zeros(0), *(np.einsum("nd,nd->n", a[i[lo : lo + 100_000]], b[j[lo : lo + 100_000]]) for lo in range(0, len(i), 100_000))])


def first_scores(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int) -> list[np.ndarray]:
    """The k best scores of each query in a block of rows, or all if they are fewer."""
    score = queries @ rows.T
    score[query_ids[:, None] == row_ids[None, :]] = -np.inf
    best = -np.partition(-score, min(k, len(rows)) - 1, axis=1)[:, : min(k, len(rows))]
    return [row[np.isfinite(row)] for row in best]


def block_top(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The k best rows of each query in a block among those that reach the query's threshold.

    Returns places in ``queries``, places in ``rows``, scores, and how many exact scores were computed.
    """
    slack = 1e-9 * (np.linalg.norm(queries, axis=1) * np.linalg.norm(rows, axis=1).max(initial=0) + 1)
    bar = least - slack
    own, other = (([segment_features(x, n) for n in RESOLUTIONS]) for x in (queries, rows))
    # Queries that no row between the block's extremes can satisfy skip the block.
    asked = np.ones(len(queries), bool)
    for a, b in zip(own, other, strict=True):
        asked &= envelope_bound(a, b.min(axis=0), b.max(axis=0)) >= bar
    ask = np.flatnonzero(asked)
    if not len(ask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), 0
    i, j = np.nonzero((query_ids[ask][:, None] != row_ids[None, :]) & (own[0][ask] @ other[0].T >= bar[ask][:, None]))
    i = ask[i]
    for a, b in zip(own[1:], other[1:], strict=True):
        alive = _products(a, b, i, j) >= bar[i]
        i, j = i[alive], j[alive]
    score = _products(queries, rows, i, j)
    computed = len(i)
    good = score >= least[i]
    i, j, score = i[good], j[good], score[good]
    order = np.lexsort((row_ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[keep], j[keep], score[keep], computed


def integer_vectors(vectors: DataFrame, vec_id: str, vector: str, scale: float) -> DataFrame:
    """(id, v): floor(scale * component) of every sound vector, as doubles that hold integers."""
    x = F.col(vector).cast("array<double>")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & (F.size(x) > 0)
    return vectors.where(sound & F.col(vec_id).isNotNull()).select(F.col(vec_id).alias("id"), F.transform(x, lambda c: F.floor(c * scale).cast("double")).alias("v"))


def _pack(rows: DataFrame, most: int, kind: str) -> DataFrame:
    """Rows packed into blocks of vectors of one length, with the envelope of their middle statistics."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for d in np.unique(sizes):
                some = batch.filter(pa.array(sizes == d))
                for lo in range(0, len(some), most):
                    part = some.slice(lo, most)
                    x = part.column(1).flatten().to_numpy().astype(np.float64).reshape(-1, d)
                    f = segment_features(x, RESOLUTIONS[1])
                    data = [pa.array([v.tobytes()], pa.binary()) for v in (x, f.min(axis=0), f.max(axis=0))]
                    yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([part.column(0).to_pylist()], pa.list_(part.column(0).type)), *data], names=["d", "ids", "data", "low", "high"])

    packed = rows.mapInArrow(pack, f"d int, ids array<{kind}>, data binary, low binary, high binary")
    return cut_lineage(packed.withColumn("block", F.monotonically_increasing_id()))


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest integer inner product for each query.

    ``is_query`` is a condition on ``id``.  Every block of queries meets every block of candidates once.
    """
    kind = vectors.schema[vec_id].dataType.simpleString()
    rows = integer_vectors(vectors, vec_id, vector, scale)
    # Like vectors share blocks, so that envelopes are narrow; the hash parts equal vectors.
    level = F.aggregate("v", F.lit(0.0), lambda a, c: a + c) / F.size("v")
    ordered = rows.repartitionByRange(level, F.xxhash64("id")).sortWithinPartitions(level)
    blocks = _pack(ordered, CANDIDATE_BLOCK, kind)
    queries = _pack(rows.where(is_query).dropDuplicates(["id", "v"]), QUERY_BLOCK, kind).withColumnRenamed("block", "q")
    parts = max(1, -(-blocks.count() // BLOCKS_TOGETHER))
    dealt = blocks.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int"))
    parted = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(*([np.frombuffer(x) for x in batch.column(c).to_pylist()] for c in ("q_low", "q_high", "low", "high")), strict=True)
            value = [float(np.maximum.reduce([a * c, a * d, b * c, b * d]).sum()) for a, b, c, d in sides]
            yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("block"), pa.array(value, pa.float64())], names=["q", "block", "bound"])

    # The blocks' envelopes alone say where a query block looks first.
    heads = queries.select("d", "q", parted, F.col("low").alias("q_low"), F.col("high").alias("q_high"))
    promised = cut_lineage(dealt.select("d", "part", "block", "low", "high").join(heads, ["d", "part"]).mapInArrow(bounds, "q long, block long, bound double"))
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound"), "block"))
    chosen = promised.withColumn("nth", nth).where(F.col("nth") <= FIRST_BLOCKS).select("q", "block")
    first = chosen.join(blocks.select("block", F.col("ids").alias("row_ids"), F.col("data").alias("row_data")), "block").join(queries.select("q", "d", "ids", "data"), "q")

    def pairs(batches: Iterator[pa.RecordBatch], *more: str) -> Iterator[tuple]:
        for batch in batches:
            for q, d, ids, data, row_ids, row_data, *rest in zip(*(batch.column(c).to_pylist() for c in ("q", "d", "ids", "data", "row_ids", "row_data", *more)), strict=True):
                yield q, np.frombuffer(data).reshape(-1, d), np.array(ids), np.frombuffer(row_data).reshape(-1, d), np.array(row_ids), *rest

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q, x, ids, y, row_ids in pairs(batches):
            best = first_scores(x, ids, y, row_ids, k)
            place = np.repeat(np.arange(len(best), dtype=np.int32), [len(b) for b in best])
            yield pa.RecordBatch.from_arrays([pa.array([q] * len(place), pa.int64()), pa.array(place), pa.array(np.concatenate([np.zeros(0), *best]))], names=["q", "place", "score"])

    seen = first.mapInArrow(look, "q long, place int, score double")
    kth = F.row_number().over(Window.partitionBy("q", "place").orderBy(F.desc("score")))
    least = seen.withColumn("nth", kth).where(F.col("nth") == k).groupBy("q").agg(F.collect_list(F.struct("place", "score")).alias("least"))
    asked = cut_lineage(queries.select("q", "d", "ids", "data").join(least, "q", "left"))
    # A block none of whose bounds reaches the least known k-th score meets no data; scores are integers, so one makes up for rounding.
    full = (F.size("least") == F.size("ids")) & F.col("least").isNotNull()
    bars = asked.select("q", F.when(full, F.array_min(F.transform("least", lambda x: x["score"]))).alias("bar"))
    alive = promised.join(bars, "q").where(F.col("bar").isNull() | (F.col("bound") + 1 >= F.col("bar"))).join(dealt.select("block", "part"), "block")
    # At most BLOCKS_TOGETHER blocks to a part, more or less.
    alive = alive.groupBy("q", "part").agg(F.collect_list("block").alias("alive"))
    met = dealt.select("d", "part", "block", F.col("ids").alias("row_ids"), F.col("data").alias("row_data")).join(asked.join(alive, "q"), ["d", "part"])
    met = met.where(F.array_contains("alive", F.col("block")))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x, ids, y, row_ids, known in pairs(batches, "least"):
            bar = np.full(len(x), -np.inf)
            for row in known or ():
                bar[row["place"]] = row["score"]
            i, j, score, _ = block_top(x, ids, y, row_ids, k, bar)
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(row_ids[j]), pa.array(score.astype(np.int64))], names=["query_id", "vec_id", "score"])

    found = met.select("q", "d", "ids", "data", "row_ids", "row_data", "least").mapInArrow(search, f"query_id {kind}, vec_id {kind}, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
