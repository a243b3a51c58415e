"""Helpers that several operators share: checkpoints, holdout splits and byte-level text arrays."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are worked on in slices of about this many bytes, which bounds a task's memory.
SLICE_BYTES = 1_000_000
#: Rows whose texts a task holds as Python strings at once.
SLICE_ROWS = 1000


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the session's reliable checkpoint folder and return the written rows.

    The folder is the one in ``spark.checkpoint.dir``; a temporary one is set only where the
    session names none and runs on one machine, as in tests.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


#: Words of 64 bits in a sieve, which bounds what is sent to all tasks.
SIEVE_WORDS = 1 << 20
#: Bits that an id sets in its word.
SIEVE_BITS = 4


def _sieve_place(columns: list[str]) -> tuple[Column, Column]:
    """The word and the bits of the row's id; null is an id like any other."""
    word = F.pmod(F.xxhash64(*columns), F.lit(SIEVE_WORDS))
    spread = F.xxhash64(*columns, F.lit(5))
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(spread, 6 * k).bitwiseAND(F.lit(63)).cast("int")) for k in range(SIEVE_BITS)]
    return word, bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])


def sieved(rows: DataFrame, ids: DataFrame, mark: str = "__maybe") -> DataFrame:
    """``rows`` with a mark that is true for every row whose id is in ``ids`` and for few others.

    The ids become a Bloom filter of ``SIEVE_WORDS`` words, so what all tasks receive has a fixed
    bound at any size; with many more ids than words the filter lets more rows through.
    """
    word, bits = _sieve_place(ids.columns)
    table = ids.select(word.alias("__word"), bits.alias("__bits")).groupBy("__word").agg(F.bit_or("__bits").alias("__held"))
    word, bits = _sieve_place(ids.columns)
    placed = rows.withColumn("__word", word).join(F.broadcast(table), "__word", "left")
    return placed.withColumn(mark, F.coalesce(F.col("__held").bitwiseAND(bits) == bits, F.lit(False))).select(*rows.columns, mark)


def matching_rows(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """``rows`` semi- or anti-joined with distinct ids; only rows that pass the ids' sieve are joined."""
    marked = sieved(rows, ids)
    joined = marked.where("__maybe").drop("__maybe").join(ids, ids.columns, how)
    return joined if how == "left_semi" else joined.unionByName(marked.where("not __maybe").drop("__maybe"))


def remainder(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; a null id counts as the empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow column as one byte array and the n + 1 offsets; a null is empty."""
    array = column.fill_null("").cast(pa.large_string())
    _, offsets, data = array.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    if data is None or not len(array):
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) for runs of rows of at most ``most`` bytes,
    or of one longer text."""
    data, ends = text_bytes(column)
    start, n = 0, len(ends) - 1
    while start < n:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + most, side="right")) - 1)
        yield start, stop, data[ends[start] : ends[stop]], ends[start : stop + 1] - ends[start]
        start = stop


def row_slices(batch: pa.RecordBatch, most: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """A batch in runs of at most ``most`` rows."""
    return (batch.slice(lo, most) for lo in range(0, len(batch), most))


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def fold_case(data: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and for the accented capitals of Latin-1 in UTF-8."""
    low = _FOLD[data]
    if len(data) > 1:
        accented = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low[1:][accented] += 0x20
    return low


def segments(inside: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of true positions that no text boundary crosses.

    Returns the run starts, the run lengths and, per text, the index of its first run (n + 1 values).
    """
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(ends), np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[ends[:-1][ends[:-1] < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[ends[1:][ends[1:] > 0] - 1] = False
    stops = np.flatnonzero(inside & ~after) + 1
    return starts, stops - starts, np.searchsorted(starts, ends)


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (the public SplitMix64 finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15


def run_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each run."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    powers = np.empty(int(lengths.max()), np.uint64)
    powers[0] = 1
    powers[1:] = _BASE
    powers = np.multiply.accumulate(powers)
    first = np.zeros(len(starts), np.int64)
    np.cumsum(lengths[:-1], out=first[1:])
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    picked = data[np.repeat(starts, lengths) + place].astype(np.uint64) + np.uint64(1)
    return mix64(np.add.reduceat(picked * powers[place], first) + lengths.astype(np.uint64))


def sum_by(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (rows) between consecutive ``bounds``; empty ranges give 0."""
    out = np.zeros((len(bounds) - 1, *values.shape[1:]), values.dtype)
    full = bounds[1:] > bounds[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, bounds[:-1][full], axis=0)
    return out


def bounded_slices(column: pa.Array, cuts: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of each piece, bytes, offsets) for slices of about ``most`` bytes; a longer text is cut into pieces.

    Cuts lie behind bytes for which the table ``cuts`` is true, so nothing that lies between two such
    bytes is parted; a longer stretch without one stays whole.
    """
    for lo, hi, data, ends in slices(column, most):
        if hi - lo > 1 or len(data) <= most:
            yield np.arange(lo, hi), data, ends
            continue
        allowed, start = np.flatnonzero(cuts[data]) + 1, 0
        while start < len(data):
            last = np.searchsorted(allowed, start + most, side="right") - 1
            stop = int(allowed[last]) if last >= 0 and allowed[last] > start else int(allowed[last + 1]) if last + 1 < len(allowed) else len(data)
            if len(data) - start <= most:
                stop = len(data)
            yield np.array([lo]), data[start:stop], np.array([0, stop - start])
            start = stop


def run_strings(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The bytes of each run, which neither overlap nor run backwards, as an Arrow array of strings."""
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    place = np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[place])))


class RollingHash:
    """64-bit hashes of any runs of a byte array, from the prefix sums of one polynomial."""

    _powers = _inverses = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray) -> None:
        if len(self._powers) <= len(data):
            size = 1 << (len(data) + 1).bit_length()
            for name, base in (("_powers", _BASE), ("_inverses", pow(_BASE, -1, 1 << 64))):
                table = np.full(size, base, np.uint64)
                table[0] = 1
                setattr(RollingHash, name, np.multiply.accumulate(table))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self._powers[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return mix64((self.sums[stops] - self.sums[starts]) * self._inverses[starts] + (stops - starts).astype(np.uint64))


def row_hash(rows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of ids."""
    h = np.full(len(rows), rows.shape[1] + 1, np.uint64)
    for column in rows.T:
        h = mix64(h ^ column)
    return h


#: 64-bit words of a bitmap that Python workers receive.
BITMAP_WORDS = 1 << 19


class Sieve:
    """A bitmap of fixed size that holds every row of ids it was made of, and lets few others pass."""

    def __init__(self, rows: DataFrame, words: int = BITMAP_WORDS) -> None:
        width = len(rows.columns)

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.zeros(words, np.uint64)
            for batch in batches:
                ids = np.column_stack([batch.column(k).to_numpy().view(np.uint64) for k in range(width)])
                place, bits = self._place(ids, words)
                np.bitwise_or.at(held, place, bits)
            used = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(held[used].view(np.int64))], names=["place", "bits"])

        found = rows.mapInArrow(mark, "place int, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
        held = np.zeros(words, np.uint64)
        held[found["place"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
        self.held = rows.sparkSession.sparkContext.broadcast(held)

    @staticmethod
    def _place(ids: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        h = row_hash(ids)
        one = np.uint64(1)
        bits = (one << (h & np.uint64(63))) | (one << ((h >> np.uint64(6)) & np.uint64(63)))
        return ((h >> np.uint64(12)) % np.uint64(words)).astype(np.int64), bits


def passes(held: np.ndarray, ids: np.ndarray) -> np.ndarray:
    place, bits = Sieve._place(ids, len(held))
    return held[place] & bits == bits
