"""Log-likelihood of whole documents under a gated recurrent language model.

Spark counts every token of every document.  Tokens above a fixed share of all tokens are common:
their number is bounded by the share, so they go to every task.  The most frequent of them are the
model's words; all other tokens are predicted through one of a few rare classes and then by their
smoothed frequency within it.  The network is trained on every training document by truncated
backpropagation: shards of them, whose number grows with the table, start from the same parameters
and Spark averages what they learn.  Scoring carries the state over a whole document.  Counts of tokens that
are not common are looked up by a join, so no table of all tokens leaves the executors.

Defined results: a null text is an empty one and has one token, its end; repeated rows are scored
alike; if no document may be learned from, every token has the probability that the add-one formula
gives without counts; columns of other names are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm import gru
from tallyspark.llm.common import cut_lineage, row_slices, sum_by

#: Tokens with at least this share of all tokens are common; there are at most its inverse of them.
COMMON_SHARE = 1 / 500_000
#: Longer tokens are never common, which bounds the size of the common tokens too.
COMMON_BYTES = 64
WORDS, CLASS_SIZE = 480, 24
END_TOKEN = b""
#: Tokens of a shard that one task trains on, and of a block that it scores at once.
SHARD_TOKENS, BLOCK_TOKENS = 700_000, 2_000_000
#: Distinct tokens that a task counts before it hands them on.
HELD = 400_000

_LAST = np.zeros(256, np.int64)
_LAST[97:123], _LAST[48:58], _LAST[list(b".,;:!?")] = 1, 2, 3
_LENGTH = np.array([0, 0, 0, 0, 1, 1, 1, 2, 2, 2, 2, 2, 3])
RARE = 32


def rare_classes(words: list[bytes]) -> np.ndarray:
    """A class for each rare token by its letters, last character and length; an empty token is of class 0."""
    size = np.array([len(w) for w in words], np.int64)
    data = np.frombuffer(b"".join(words), np.uint8)
    full = np.flatnonzero(size)
    out = np.zeros(len(words), np.int64)
    if len(full):
        ends = np.cumsum(size[full])
        foreign = np.maximum.reduceat(data, ends - size[full]) >= 128
        out[full] = 16 * foreign + 4 * _LAST[data[ends - 1]] + _LENGTH[np.minimum(size[full], 12)]
    return out


def tokens(text: str | None) -> list[bytes]:
    """Words of a text, A-Z in lower case, split at blanks and the controls 9 to 13."""
    return (text or "").encode("utf-8", "replace").lower().split()


@dataclass(frozen=True)
class Statistics:
    """Token counts of the training documents: all, different, and of each rare class."""

    total: int
    kinds: int
    common: dict[bytes, int]
    words: tuple[bytes, ...]
    rare_total: np.ndarray
    rare_kinds: np.ndarray


def token_counts(docs: DataFrame, learn: Column, *, text: str = "text") -> DataFrame:
    """(token, learned, seen): how often each token is in the training documents and in all of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: tuple[Counter[bytes], Counter[bytes]] = (Counter(), Counter())

        def give(total: Counter[bytes], learned: bool) -> pa.RecordBatch:
            n = pa.array(list(total.values()), pa.int64())
            none = pa.array([0] * len(total), pa.int64())
            found = list(total)
            kinds = pa.array(rare_classes(found).astype(np.int32))
            batch = pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), kinds, n if learned else none, n], names=["token", "kind", "learned", "seen"])
            total.clear()
            return batch

        for batch in batches:
            for value, learned in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total = totals[bool(learned)]
                total.update(tokens(value))
                total[END_TOKEN] += 1
                if len(total) > HELD:
                    yield give(total, bool(learned))
        for learned in (False, True):
            yield give(totals[learned], learned)

    rows = docs.select(F.col(text).cast("string"), learn).mapInArrow(count, "token binary, kind int, learned long, seen long")
    return rows.groupBy("token").agg(F.first("kind").alias("kind"), F.sum("learned").alias("learned"), F.sum("seen").alias("seen"))


def statistics(counts: DataFrame) -> Statistics:
    """Sums over all tokens, and the common tokens with their counts."""
    sums = counts.agg(F.sum("learned").alias("total"), F.count_if(F.col("learned") > 0).alias("kinds"), F.sum("seen").alias("seen")).first()
    least = max(1, math.ceil((sums.seen or 0) * COMMON_SHARE))
    chosen = counts.where((F.col("seen") >= least) & (F.length("token") <= COMMON_BYTES) | (F.length("token") == 0)).select("token", "learned")
    common = {END_TOKEN: 0} | {bytes(row.token): row.learned for row in chosen.toLocalIterator()}
    ranked = sorted((token for token, n in common.items() if n > 0 and token), key=lambda token: (-common[token], token))
    words = (END_TOKEN, *ranked[: WORDS - 1])
    rare_total, rare_kinds = np.zeros(RARE), np.zeros(RARE)
    for row in counts.where("learned > 0").groupBy("kind").agg(F.sum("learned").alias("n"), F.count("*").alias("k")).collect():
        rare_total[row.kind], rare_kinds[row.kind] = row.n, row.k
    for token, kind in zip(words, rare_classes(list(words)).tolist(), strict=True):
        if common.get(token):
            rare_total[kind] -= common[token]
            rare_kinds[kind] -= 1
    return Statistics(sums.total or 0, sums.kinds, common, words, rare_total, rare_kinds)


def shape_of(known: Statistics) -> gru.Shape:
    return gru.Shape(len(known.words), CLASS_SIZE, RARE)


def read_symbols(rows: DataFrame, known: Statistics) -> DataFrame:
    """The rows' symbols, sums over their common tokens, and their other tokens.

    ``inside`` is what the common tokens' frequencies in their rare classes add to the log10 score.
    """
    common, size = list(known.common), len(known.words)
    words = {token: i for i, token in enumerate(known.words)}
    place = {token: i for i, token in enumerate(common)}
    times = np.array(list(known.common.values()), np.int64)
    symbol_of = size + rare_classes(common)
    symbol_of[[place[w] for w in known.words if w in place]] = [words[w] for w in known.words if w in place]
    rare_log = np.log10(np.maximum(known.rare_total, 0) + known.rare_kinds + 1)
    logs = np.log10(times + 1.0)
    # What a common token adds to each sum, and what a rare symbol takes from the last one.
    adds = np.column_stack((times > 0, logs, np.where(symbol_of >= size, logs, 0)))
    takes = np.concatenate((np.zeros(size), rare_log))
    end = adds[place[END_TOKEN]]

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in row_slices(whole)):
            found = [tokens(value) for value in batch.column(3).to_pylist()]
            bounds = np.cumsum([0, *map(len, found)])
            flat = list(chain.from_iterable(found))
            number = np.fromiter(map(place.get, flat, repeat(-1)), np.int64, len(flat))
            foreign = number < 0
            strange = list(compress(flat, foreign.tolist()))
            symbols = symbol_of[number]
            symbols[foreign] = size + rare_classes(strange)
            values = adds[number]
            values[foreign] = 0
            values[:, 2] -= takes[symbols]
            sums = sum_by(values, bounds) + end
            sums[:, 2] -= takes[gru.END]
            held = np.concatenate(([0], np.cumsum(foreign)))[bounds].astype(np.int32)
            data = pa.py_buffer(symbols.astype(np.uint16).tobytes())
            columns = [pa.Array.from_buffers(pa.binary(), len(found), [None, pa.py_buffer((2 * bounds).astype(np.int32)), data]), pa.ListArray.from_arrays(pa.array(held), pa.array(strange, pa.binary()))]
            columns += [pa.array(np.diff(bounds) + 1), pa.array(sums[:, 0].astype(np.int64)), pa.array(sums[:, 1]), pa.array(sums[:, 2])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *columns], names=names)

    names = ["key", "doc_id", "learn", "symbols", "tokens", "n_tokens", "n_seen", "log_sum", "inside"]
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"key long, doc_id {kind}, learn boolean, symbols binary, tokens array<binary>, n_tokens long, n_seen long, log_sum double, inside double"
    return rows.select("key", "doc_id", "learn", "text").mapInArrow(convert, schema)


def train(rows: DataFrame, known: Statistics, *, rounds: int = 4, shard_tokens: int = SHARD_TOKENS) -> gru.Parameters:
    """Parameters averaged over shards of all training rows of ``read_symbols``.

    Every row is dealt to one round and to one shard of about ``shard_tokens`` in it, so the number of
    shards grows with the table and each row is passed over once.
    """
    shape = shape_of(known)
    frequency = np.concatenate(([float(known.common.get(token, 0)) for token in known.words], known.rare_total))
    parameters = gru.initial(shape, np.maximum(frequency, 0))
    if not known.total:
        return parameters
    shards = max(1, round(known.total / (rounds * shard_tokens)))
    # Rows are dealt by their own key, so that copies do not all meet in one shard.
    turn_of = F.pmod(F.xxhash64("key", F.lit(17)), F.lit(rounds)).cast("int")
    shard_of = F.pmod(F.xxhash64("key", F.lit(23)), F.lit(shards)).cast("int")
    dealt = rows.where("learn").select(turn_of.alias("turn"), shard_of.alias("shard"), "symbols")

    def average(_: tuple, table: pa.Table) -> pa.Table:
        weight = table["weight"].to_numpy().astype(float)
        mean = sum(w * np.frombuffer(x, np.float32) for w, x in zip(weight, table["parameters"].to_pylist(), strict=True)) / max(weight.sum(), 1)
        return pa.table({"part": table["part"].slice(0, 1), "weight": pa.array([int(weight.sum())]), "parameters": pa.array([mean.astype(np.float32).tobytes()], pa.binary())})

    def learner(start: gru.Parameters, turn: int):
        def learn_shard(key: tuple, table: pa.Table) -> pa.Table:
            texts = [np.frombuffer(x, np.uint16) for x in sorted(table["symbols"].to_pylist())]
            learned, seen = gru.train(start, shape, texts, rate=0.008 if turn == 0 else 0.004, lanes=192, seed=100 * turn + key[0].as_py())
            return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "weight": pa.array([seen]), "parameters": pa.array([gru.pack(learned)], pa.binary())})

        return learn_shard

    schema = "part int, weight long, parameters binary"
    for turn in range(rounds):
        found, parts = dealt.where(F.col("turn") == turn).groupBy("shard").applyInArrow(learner(parameters, turn), schema), shards
        # Parameters have a fixed size; at most 16 of them are averaged at once or reach the driver.
        while parts > 16:
            parts = -(-parts // 16)
            found = found.withColumn("part", F.pmod("part", F.lit(parts)).cast("int")).groupBy("part").applyInArrow(average, schema)
        found = found.collect()
        total = sum(row.weight for row in found)
        if total:
            parameters = gru.unpack(sum(row.weight / total * np.frombuffer(row.parameters, np.float32) for row in found), parameters)
    return parameters


def _blocks(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most ``most`` tokens, or of one longer row."""
    ends, start = np.cumsum(lengths), 0
    while start < len(lengths):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right")))
        yield start, stop
        start = stop


def lm_scores(docs: DataFrame, learn: Column, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities) of each row."""
    # Rows get a key of their own, so repeated and null ids stay apart.
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), learn.alias("learn"), F.monotonically_increasing_id().alias("key"))
    counts = cut_lineage(token_counts(rows, F.col("learn"), text="text"))
    known = statistics(counts)
    shape = shape_of(known)
    read = cut_lineage(read_symbols(rows, known))
    parameters = train(read, known)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [np.frombuffer(x, np.uint16) for x in batch.column(1).to_pylist()]
            blocks = _blocks(np.array([len(x) + 1 for x in texts], np.int64), BLOCK_TOKENS)
            value = np.concatenate([np.zeros(0), *(gru.text_scores(parameters, shape, texts[lo:hi]) for lo, hi in blocks)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value / math.log(10)), *batch.columns[2:]], names=["key", "value", "doc_id", "n_tokens", "n_seen", "log_sum", "inside"])

    kind = docs.schema[doc_id].dataType.simpleString()
    scored = read.select("key", "symbols", "doc_id", "n_tokens", "n_seen", "log_sum", "inside")
    scored = scored.mapInArrow(score, f"key long, value double, doc_id {kind}, n_tokens long, n_seen long, log_sum double, inside double")
    strange = read.select("key", F.explode("tokens").alias("token"))
    looked = strange.join(counts.where("learned > 0").select("token", "learned"), "token")
    others = looked.groupBy("key").agg(F.count("*").alias("known"), F.sum(F.log10(F.col("learned") + 1)).alias("others"))
    summed = scored.join(others, "key", "left")
    size = math.log10(known.total + known.kinds + 1)
    rest = F.coalesce("others", F.lit(0.0))
    return summed.select(
        F.col("doc_id").alias(doc_id),
        "n_tokens",
        (F.col("n_seen") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(known.total).cast("long").alias("train_tokens"),
        (F.col("log_sum") + rest - F.col("n_tokens") * size).alias("base_score"),
        (F.col("value") + F.col("inside") + rest).alias("score"),
    )
