"""Removal of long byte strings that occur more than once, by external induced sorting of suffixes.

Every window of ``LENGTH`` bytes is dealt by the least hash among its substrings of a shorter length, so
equal windows meet wherever they start.  Consecutive windows of one text with one such key form a piece.
Pieces whose key has one place in all texts go; equal pieces are counted, and one of each is sent to the shard of its
key.  A shard writes its pieces to disk as one sequence and sorts all suffixes with their common prefixes;
windows that share all bytes with a neighbour, or whose piece was counted twice, are repeated.  Spark
brings them back to the texts, where the bytes they cover are joined to spans.

A key that holds more than a thousandth of all piece bytes is dealt again by longer substrings, at last
by whole windows, whose groups hold equal windows only; there are fewer than a thousand such keys a level.

Defined results: null and short texts have no windows; windows never cross texts; repeated rows repeat
each other; equal texts get equal spans whatever their ids; an empty table gives no row; columns that
have the names of results are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.common import RollingHash, Sieve, cut_lineage, mix64, passes, sieved, slices
from tallyspark.llm.induced_sort import IN_MEMORY, Column, descending, scratch

#: Bytes of a window, and the lengths of the substrings that deal it out, level by level.
LENGTH, LEVELS = 400, (128, 384, 400)
#: Keys with more bytes of pieces than a share of all, and than this, are dealt again.
HOT_BYTES, HOT_SHARE = 4_000_000, 1000
#: Bytes of pieces that a shard holds on average.
SHARD_BYTES = 4_000_000
SLICE = 1 << 18


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    n = len(values) - width + 1
    if width == 1 or n <= 0:
        return values[: max(n, 0)]
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, ~np.uint64(0))
    padded[: len(values)] = values
    square = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    back = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


@dataclass(frozen=True)
class Dealing:
    """How windows are dealt: their length, the levels of keys, and the keys known to be hot on each level so far."""

    length: int = LENGTH
    levels: tuple[int, ...] = LEVELS
    hot: tuple[np.ndarray, ...] = ()

    def hashes(self, rolling: RollingHash, n: int, level: int) -> np.ndarray:
        """Hashes of all substrings of a level's length."""
        starts, size = np.arange(n + 1), self.levels[level]
        return mix64(rolling.of(starts[: n - size + 1], starts[size:]) + np.uint64(level + 1))

    def keys(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The key of each window on the last level, 0 for windows that cross texts or belong to an earlier level, and the hashes."""
        n, rolling = len(data), RollingHash(data)
        begins = np.zeros(n - self.length + 2, np.int64)
        # Windows begin at least ``length`` before the end of their text.
        first, stop = ends[:-1], ends[1:] - self.length + 1
        some = stop > first
        begins[first[some]] += 1
        begins[stop[some]] -= 1
        keys = None
        own = np.cumsum(begins[:-1]) > 0
        for level in range(len(self.hot) + 1):
            if level:
                own &= np.isin(keys, self.hot[level - 1])
                if not own.any():
                    return np.zeros(len(own), np.uint64), hashes
            hashes = self.hashes(rolling, n, level)
            keys = sliding_least(hashes, self.length - self.levels[level] + 1)
        return np.where(own, keys, np.uint64(0)), hashes

    def counts(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(key, number of places of the substring that gives it) in the texts of a batch."""
        width = self.length - self.levels[len(self.hot)] + 1
        for _, data, ends, _ in _text_slices(batch.column(1), self.length):
            if len(data) < self.length:
                continue
            keys, hashes = self.keys(data, ends)
            if not keys.any():
                continue
            edge = np.zeros(width - 1, np.uint64)
            most = ~sliding_least(~np.concatenate((edge, keys, edge)), width)
            yield np.unique(hashes[(hashes == most) & (most > 0)], return_counts=True)

    def pieces(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        """(row, start, windows, key, start in the bytes, bytes) of the pieces of a batch of texts on the last level."""
        for rows, data, ends, at in _text_slices(batch.column(1), self.length):
            if len(data) < self.length:
                continue
            keys, _ = self.keys(data, ends)
            change = np.append(True, keys[1:] != keys[:-1])
            change[ends[:-1][ends[:-1] < len(keys)]] = True
            begins = np.flatnonzero(change)
            windows = np.diff(np.append(begins, len(keys)))
            own = keys[begins] > 0
            begins, windows = begins[own], windows[own]
            text = np.searchsorted(ends, begins, side="right") - 1
            yield rows[text], begins - ends[text] + at, windows, keys[begins], begins, data


def _text_slices(column: pa.Array, length: int, most: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(rows, bytes, offsets, start in the text) of slices; a longer text is cut into parts that overlap by a window."""
    for lo, hi, data, ends in slices(column, most):
        if hi - lo > 1 or len(data) <= 2 * most:
            yield np.arange(lo, hi), data, ends, 0
            continue
        for at in range(0, max(len(data) - length + 1, 1), most):
            part = data[at : at + most + length - 1]
            yield np.array([lo]), part, np.array([0, len(part)]), at


def _printed(docs: DataFrame, text: str) -> DataFrame:
    """(fp, text): each row's text and its fingerprint."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.unhex(F.md5(whole.cast("binary"))).alias("fp"), whole.alias("text"))


def repeated_keys(texts: DataFrame, dealing: Dealing) -> DataFrame:
    """The keys that the texts give at more than one place."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found, n in dealing.counts(batch):
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["key", "n"])

    return texts.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key")


def repeated_pieces(texts: DataFrame, dealing: Dealing) -> DataFrame:
    """(fp, start, windows, key, digest, copies) of the pieces under keys that occur more than once."""
    repeated = cut_lineage(repeated_keys(texts, dealing))
    held, length = Sieve(repeated).held, dealing.length

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, starts, windows, keys, begins, data in dealing.pieces(batch):
                own = passes(held.value, keys[:, None])
                raw, view = begins[own], memoryview(np.ascontiguousarray(data))
                digests = [hashlib.blake2b(view[b : b + w + length - 1], digest_size=16).digest() for b, w in zip(raw.tolist(), windows[own].tolist(), strict=True)]
                columns = [batch.column(0).take(pa.array(rows[own])), pa.array(starts[own]), pa.array(windows[own]), pa.array(keys[own].view(np.int64)), pa.array(digests, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["fp", "start", "windows", "key", "digest"])

    found = texts.mapInArrow(emit, "fp binary, start long, windows long, key long, digest binary")
    found = found.groupBy("fp", "start", "windows", "key", "digest").agg(F.count("*").alias("copies"))
    return cut_lineage(found.join(repeated, "key", "left_semi").select("fp", "start", "windows", "key", "digest", "copies"))


def repeated_windows(pieces: Iterator[tuple[bytes, int, int]], length: int = LENGTH, memory: int = IN_MEMORY) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each of a shard's ``pieces(bytes, windows, copies)`` its number and the runs of repeated windows: starts and lengths.

    The pieces are written to disk one after the other, each closed by a mark, and their suffixes sorted.
    """
    symbols, windows, copies, starts, at = Column(np.uint16), [], [], [], 0
    for body, n, number in pieces:
        raw = np.frombuffer(body, np.uint8)
        symbols.append(np.append(raw.astype(np.uint16) + 2, np.uint16(1)))
        starts.append(at)
        windows.append(n)
        copies.append(number)
        at += len(raw) + 1
    if not starts:
        return
    symbols.append(np.zeros(1, np.uint16))
    repeated = scratch(np.zeros(at + 1, bool))
    before = None
    for positions, common in descending(symbols.all(), length, memory):
        equal = common >= length
        repeated[positions[equal]] = True
        repeated[positions[:-1][equal[1:]]] = True
        if len(positions) and equal[0]:
            repeated[before] = True
        before = positions[-1] if len(positions) else before
    for k, (start, n, number) in enumerate(zip(starts, windows, copies, strict=True)):
        own = np.ones(n, bool) if number > 1 else np.asarray(repeated[start : start + n])
        edge = np.flatnonzero(np.diff(np.concatenate(([False], own, [False])).astype(np.int8)))
        if len(edge):
            yield k, edge[::2], edge[1::2] - edge[::2]


def _sorted_shards(distinct: DataFrame, texts: DataFrame, shards: int, length: int, memory: int) -> DataFrame:
    """(key, digest, starts, lengths): runs of repeated windows of the pieces that have any."""
    wanted = distinct.select("rep.fp", F.struct("rep.start", "rep.windows", "key", "digest", "copies").alias("piece")).groupBy("fp").agg(F.collect_list("piece").alias("pieces"))
    wanted = cut_lineage(wanted)
    own = sieved(texts, wanted.select("fp")).where("__maybe").groupBy("fp").agg(F.first("text").alias("text"))

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, pieces in zip(batch.column("text"), batch.column("pieces"), strict=True):
                raw, found = memoryview(text.cast(pa.binary()).as_buffer()), pieces.values.flatten()
                start, windows = found[0].to_numpy(), found[1].to_numpy()
                for lo in range(0, len(start), 2000):
                    parts = [bytes(raw[s : s + w + length - 1]) for s, w in zip(start[lo : lo + 2000].tolist(), windows[lo : lo + 2000].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary()), *(c[lo : lo + 2000] for c in found[1:])], names=["body", "windows", "key", "digest", "copies"])

    sent = own.join(wanted, "fp").select("text", "pieces").mapInArrow(bodies, "body binary, windows long, key long, digest binary, copies long")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, digests = Column(np.int64), Column(np.uint8)

        def pieces() -> Iterator[tuple[bytes, int, int]]:
            for batch in batches:
                keys.append(batch.column(2).to_numpy())
                digests.append(np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8))
                for body, n, number in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(4).to_pylist(), strict=True):
                    yield body.as_buffer(), n, number

        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            at = np.array([k for k, _, _ in held])
            columns = [pa.array(keys.all()[at]), pa.array([d.tobytes() for d in digests.all().reshape(-1, 16)[at]], pa.binary())]
            columns += [pa.array([x[c] for x in held], pa.list_(pa.int64())) for c in (1, 2)]
            return pa.RecordBatch.from_arrays(columns, names=["key", "digest", "starts", "lengths"])

        for found in repeated_windows(pieces(), length, memory):
            held.append(found)
            if len(held) == 10_000:
                yield out()
                held.clear()
        if held:
            yield out()

    return sent.repartition(shards, "key").mapInArrow(search, "key long, digest binary, starts array<long>, lengths array<long>")


def repeated_spans(docs: DataFrame, *, text: str = "text", length: int = LENGTH, levels: tuple[int, ...] = LEVELS, hot_bytes: int = HOT_BYTES, shard_bytes: int = SHARD_BYTES, memory: int = IN_MEMORY) -> DataFrame:
    """(fp, spans): for the MD5 of each text with repeated windows, the byte ranges that they cover, as (start, stop)."""
    texts = _printed(docs, text)
    dealing, parts = Dealing(length, levels), []
    while True:
        pieces = repeated_pieces(texts, dealing)
        distinct = cut_lineage(pieces.groupBy("key", "digest").agg(F.sum("copies").alias("copies"), F.min(F.struct("fp", "start", "windows")).alias("rep")))
        sizes = distinct.groupBy("key").agg(F.sum(F.col("rep.windows") + length - 1).alias("bytes"))
        total = distinct.agg(F.sum(F.col("rep.windows") + length - 1)).first()[0] or 0
        least = max(hot_bytes, total // HOT_SHARE)
        found = [] if len(dealing.hot) == len(levels) - 1 else [r.key for r in sizes.where(F.col("bytes") > least).select("key").collect()]
        calm = ~F.col("key").isin(found) if found else F.lit(True)
        parts.append((pieces.where(calm), distinct.where(calm), total))
        if not found:
            break
        dealing = replace(dealing, hot=(*dealing.hot, np.array(found, np.int64).view(np.uint64)))
    pieces, distinct = parts[0][:2]
    for more in parts[1:]:
        pieces, distinct = pieces.unionByName(more[0]), distinct.unionByName(more[1])
    shards = 1 + sum(total for _, _, total in parts) // shard_bytes
    runs = _sorted_shards(distinct, texts, shards, length, memory)
    windows = pieces.join(runs, ["key", "digest"]).select("fp", "start", F.explode(F.arrays_zip("starts", "lengths")).alias("run"))
    covered = windows.select("fp", (F.col("start") + F.col("run.starts")).alias("start"), (F.col("start") + F.col("run.starts") + F.col("run.lengths") + length - 1).alias("stop"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            out = []
            for ranges in batch.column(1):
                start, stop = (c.to_numpy() for c in ranges.values.flatten())
                order = np.argsort(start, kind="stable")
                start, reach = start[order], np.maximum.accumulate(stop[order])
                first = np.flatnonzero(np.append(True, start[1:] > reach[:-1]))
                out.append([{"start": int(a), "stop": int(b)} for a, b in zip(start[first], reach[np.append(first[1:], len(reach)) - 1], strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["fp", "spans"])

    gathered = covered.groupBy("fp").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    return gathered.mapInArrow(joined, "fp binary, spans array<struct<start:long,stop:long>>")


def remove_repeats(docs: DataFrame, *, text: str = "text", **options: object) -> DataFrame:
    """All columns of ``docs``, ``spans`` of repeated bytes as (start, stop), and ``kept``: the other bytes."""
    spans = cut_lineage(repeated_spans(docs, text=text, **options))
    docs = docs.drop("spans", "kept")
    marked = docs.withColumn("fp", F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"))))
    marked = sieved(marked, spans.select("fp"))
    none = F.array().cast("array<struct<start:long,stop:long>>").alias("spans")
    whole = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("kept")
    same = marked.where("not __maybe").select(*docs.columns, none, whole)
    maybe = marked.where("__maybe").join(spans, "fp", "left").select(*docs.columns, F.coalesce("spans", none).alias("spans"), whole)
    schema = T.StructType(maybe.schema.fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for body, spans in zip(batch.column(batch.num_columns - 1), batch.column(batch.num_columns - 2), strict=True):
                raw, at, parts = memoryview(body.as_buffer()), 0, []
                for span in spans.as_py():
                    parts.append(raw[at : span["start"]])
                    at = span["stop"]
                kept.append(b"".join([*parts, raw[at:]]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(kept, pa.binary())], names=schema.names)

    return same.unionByName(maybe.mapInArrow(cut, schema))
