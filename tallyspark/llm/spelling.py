"""Groups of spelling variants: words that differ by one code point, found with bit-sliced position indexes.

An index holds one bitset over its words for each (position, letter).  A query word is followed letter
by letter for all words at once: one bitset marks the words without an error so far, others the words
with one replaced, one additional or one missing letter, read at the same position, one position on or
one back.  Words are ordered by frequency, so the first bit of a result is the most frequent near word.

Two words that differ by one code point agree before their first difference and behind the range of
positions that holds it.  Words are therefore dealt by all but one range of their positions, first by
halves; a hot group is dealt again by halves of its range, down to single positions, where a group
holds a few thousand words at most, as it agrees in all but one or two letters.  A pair meets once,
in the range of its first difference.

Defined results: null and empty texts and texts without runs give no word; a null id counts as the
empty text; repeated rows count each; an empty table gives no word; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import _FOLD, bounded_slices, cut_lineage, run_strings, segments

#: Words have at least this many code points and occurrences; a form is so many times as frequent.
LEAST_LENGTH, LEAST_COUNT, FORM_TIMES = 5, 3, 2
#: Of runs whose hash this number divides one code point is deleted.
SLIP = 97
#: Larger groups are dealt again; small groups share an index of about this many words.
HOT, PACK = 4096, 2048
#: Runs of more bytes are hashed one by one.
LONG_RUN = 64

_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True
_CUT = np.arange(256) < 128
_CUT &= ~_ASCII_LETTER


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> 1), table >> 1)
    return table


_CRC = _crc_table()


def run_crcs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each run behind a text whose own crc32 is ``before``."""
    order = np.argsort(-lengths, kind="stable")
    long = int(np.searchsorted(-lengths[order], -LONG_RUN))
    crc = before[order].astype(np.uint32)
    for k in range(long):
        at = starts[order[k]]
        crc[k] = zlib.crc32(data[at : at + lengths[order[k]]].tobytes(), int(crc[k]))
    rest, at, size = crc[long:] ^ np.uint32(0xFFFFFFFF), starts[order[long:]], lengths[order[long:]]
    for k in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -k))
        rest[:n] = _CRC[(rest[:n] ^ data[at[:n] + k]) & np.uint32(255)] ^ (rest[:n] >> np.uint32(8))
    crc[long:] = rest ^ np.uint32(0xFFFFFFFF)
    out = np.empty(len(starts), np.uint32)
    out[order] = crc
    return out


def words_of(rows: np.ndarray, data: np.ndarray, ends: np.ndarray, prefixes: np.ndarray) -> pa.Array:
    """The words of a slice, one for each occurrence; ``prefixes`` has the crc32 of each row's id and colon."""
    data = _FOLD[data]
    accented = data == 0xC3
    inside = _ASCII_LETTER[data] | accented
    inside[1:] |= accented[:-1]
    starts, lengths, first = segments(inside, ends)
    tails = np.zeros(len(data) + 1, np.int64)
    np.cumsum(accented, out=tails[1:])
    points = lengths - (tails[starts + lengths] - tails[starts])
    row = np.repeat(rows, np.diff(first))
    keep = points >= LEAST_LENGTH
    starts, lengths, points, row = starts[keep], lengths[keep], points[keep], row[keep]
    crc = run_crcs(data, starts, lengths, prefixes[row])
    slipped = crc % SLIP == 0
    whole = run_strings(data, starts[~slipped], lengths[~slipped])
    changed = []
    for at, size, n, h in zip(starts[slipped], lengths[slipped], points[slipped], crc[slipped], strict=True):
        text, place = data[at : at + size].tobytes().decode(), int(h) % int(n)
        if n > LEAST_LENGTH:
            changed.append(text[:place] + text[place + 1 :])
    return pa.concat_arrays([whole, pa.array(changed, pa.large_string())])


def vocabulary(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of all words with at least ``least`` occurrences."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefixes = np.array([zlib.crc32(f"{x}:".encode()) for x in batch.column(0).to_pylist()], np.uint32)
            for rows, data, ends in bounded_slices(batch.column(1), _CUT, 4_000_000):
                found = words_of(rows, data, ends, prefixes)
                if len(found):
                    counts = pc.value_counts(found)
                    yield pa.RecordBatch.from_arrays([counts.field(0).cast(pa.string()), counts.field(1)], names=["word", "n"])

    known = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.col(text).cast("string"))
    return known.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class PositionIndex:
    """Bitsets of words by (position, letter), and by length; ``words`` are in order of preference."""

    def __init__(self, words: list[str]) -> None:
        self.lengths = np.array([len(w) for w in words])
        top, n = int(self.lengths.max()) + 1, len(words)
        self.codes = np.full((n, top), -1, np.int64)
        points = np.concatenate([np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in words]).astype(np.int64)
        letters, ids = np.unique(points, return_inverse=True)
        inside = np.arange(top) < self.lengths[:, None]
        self.codes[inside] = ids
        self.width = -(-n // 64)
        self.held = np.zeros((top + 1, len(letters) + 1, self.width), np.uint64)
        for position in range(top):
            rows = np.flatnonzero(inside[:, position])
            np.bitwise_or.at(self.held, (position, self.codes[rows, position], rows // 64), np.uint64(1) << (rows % 64).astype(np.uint64))

    def of_length(self, length: int) -> np.ndarray:
        bits = np.zeros(self.width * 64, np.uint8)
        bits[np.flatnonzero(self.lengths == length)] = 1
        return np.packbits(bits, bitorder="little").view(np.uint64)

    def near(self, queries: np.ndarray, short: int, low: int, high: int) -> np.ndarray:
        """Bitsets of the words near to each query whose first difference lies in ``low``..``high`` - 1.

        All queries have one length, ``short`` or one more, and meet words of these two lengths, not both of the
        longer one.  An additional letter behind the shorter word lies in the range that ends with it.
        """
        codes, length = self.codes[queries], int(self.lengths[queries[0]])
        clean = np.full((len(queries), self.width), ~np.uint64(0))
        replaced, longer, shorter = (np.zeros_like(clean) for _ in range(3))
        for i in range(length):
            here = self.held[i, codes[:, i]]
            open_ = low <= i < high or (i == short == high)
            slip = clean & ~here if open_ else None
            if length == short:
                ahead = self.held[i + 1, codes[:, i]]
                replaced, longer = replaced & here, longer & ahead
                if open_:
                    replaced, longer = replaced | slip, longer | (slip & ahead)
            else:
                shorter = shorter & self.held[i - 1, codes[:, i]] if i else shorter
                if open_:
                    shorter = shorter | slip
            clean = clean & here
        if length > short:
            return shorter & self.of_length(short)
        if high == short:
            longer = longer | clean
        return (replaced & self.of_length(short)) | (longer & self.of_length(short + 1))


def near_words(words: list[str], counts: np.ndarray, short: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, number of near words, place of the best) of the words that have near words."""
    order = sorted(range(len(words)), key=lambda i: (-counts[i], words[i]))
    place = np.array(order)
    index = PositionIndex([words[i] for i in order])
    out: list[list[np.ndarray]] = [[], [], []]
    for length in (short, short + 1):
        own = np.flatnonzero(index.lengths == length)
        step = max(1, 500_000 // index.width)
        for lo in range(0, len(own), step):
            some = own[lo : lo + step]
            found = index.near(some, short, low, high)
            number = np.bitwise_count(found).sum(axis=1, dtype=np.int64)
            some, found, number = some[number > 0], found[number > 0], number[number > 0]
            column = (found != 0).argmax(axis=1)
            lowest = found[np.arange(len(found)), column]
            bit = np.bitwise_count((lowest & (~lowest + np.uint64(1))) - np.uint64(1))
            for kept, value in zip(out, (place[some], number, place[column * 64 + bit]), strict=True):
                kept.append(value)
    return tuple(np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in out)


def _dealt(rows: DataFrame) -> DataFrame:
    """A row for each half of the range ``low``..``high``, with all of the word outside that half as its key."""
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    halves = F.array(F.struct(F.col("low").alias("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("high").alias("high")))
    halved = rows.select("word", "n", "short", F.explode(halves).alias("r")).select("word", "n", "short", "r.low", "r.high")
    behind = F.when(F.col("short") > F.col("high"), F.right("word", F.col("short") - F.col("high"))).otherwise("")
    return halved.withColumn("key", F.concat_ws("|", F.substring("word", F.lit(1), F.col("low")), behind))


def groups(words: DataFrame, hot: int = HOT) -> DataFrame:
    """(word, n, short, low, high, key): words that may differ from others only in the range; no group is alone or hot."""
    length = F.length("word")
    start = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("short")).where(F.col("short") >= LEAST_LENGTH)
    left, done = start.withColumns({"low": F.lit(0), "high": F.col("short")}), None
    keys = ["short", "low", "high", "key"]
    while True:
        dealt = _dealt(left)
        sizes = dealt.groupBy(*keys).agg(F.count("*").alias("size")).where("size > 1")
        sized = cut_lineage(dealt.join(sizes, keys))
        large = (F.col("size") > hot) & (F.col("high") - F.col("low") > 1)
        calm = sized.where(~large).drop("size")
        done = calm if done is None else done.unionByName(calm)
        left = sized.where(large).drop("size", "key")
        if left.isEmpty():
            return done


def near_counts(words: DataFrame, *, hot: int = HOT, pack: int = PACK) -> DataFrame:
    """(word, n_near, best, best_n) for the words that have near words."""
    dealt = cut_lineage(groups(words, hot))
    shape = ["short", "low", "high"]
    number = dealt.groupBy(*shape).agg(F.ceil(F.count("*") / pack).cast("int").alias("packs"))
    packed = dealt.join(number, shape).withColumn("pack", F.pmod(F.xxhash64("key"), F.col("packs")).cast("int"))

    def search(key: tuple, data: pa.Table) -> pa.Table:
        words, counts = data["word"].to_pylist(), data["n"].to_numpy()
        at, number, best = near_words(words, counts, *(k.as_py() for k in key[:3]))
        named = [pa.array([words[i] for i in places], pa.string()) for places in (at, best)]
        return pa.table({"word": named[0], "n_near": number, "best": named[1], "best_n": counts[best]})

    found = packed.select("word", "n", *shape, "pack").groupBy(*shape, "pack").applyInArrow(search, "word string, n_near long, best string, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best"))).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.less")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms(word, form)``: forms are followed to the last, twice as far in each round."""
    reached = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("last"))
        moved = cut_lineage(reached.join(further, "root", "left").select("word", F.coalesce("last", "root").alias("root"), F.col("last").isNotNull().alias("moved")))
        reached = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return reached


def spelling_groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", hot: int = HOT, pack: int = PACK) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of the corpus."""
    words = cut_lineage(vocabulary(docs, doc_id=doc_id, text=text))
    found = words.join(near_counts(words, hot=hot, pack=pack), "word", "left")
    formed = F.col("best_n") >= FORM_TIMES * F.col("n")
    form, form_n = F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n")
    found = cut_lineage(found.select("word", form, "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form_n))
    rooted = found.join(roots(found.where("form is not null").select("word", "form")), "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
