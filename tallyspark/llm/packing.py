"""Best-fit-decreasing packing of token sequences.

Every text is tokenised whole and cut into pieces of at most ``capacity`` tokens.  Best fit
decreasing depends on the pieces' lengths alone, and there are at most ``capacity`` lengths, so the
packing of the whole table is worked out on the length counts: a segment tree over the remaining
capacities finds the tightest open bin in logarithmic time, and equal pieces that meet equal bins
are placed together.  The plan says where the i-th piece of each length goes; its size depends on
the capacity, not on the table.  Spark numbers the pieces of each length and looks their places up.

Defined results: a null text is an empty one, and each text has at least one piece, its end mark;
repeated rows are packed as documents of their own; ties between equal lengths and equal bins are
broken by row numbers, so sequence numbers may differ between runs while all sums stay the same;
columns of other names are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import cut_lineage, row_slices

CAPACITY = 2048
END = 0
#: Pieces of one length are numbered in this many salted parts.
SALTS = 256
#: Words whose ids a worker remembers.
REMEMBERED = 300_000


@lru_cache(maxsize=2)
def encoder(path: str):
    """The byte-level BPE of a ``tokenizers`` file, run by tiktoken: the same ids at several times the speed."""
    import tiktoken
    from public_tokenizers import PATTERN

    model = json.load(open(path, encoding="utf-8"))
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(printable)))}
    special = {token["content"] for token in model["added_tokens"]}
    ranks = {bytes(letters[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def library(path: str):
    """The ``tokenizers`` model of the file with its default settings, and a pattern of the added tokens' literals."""
    from tokenizers import Tokenizer

    literals = [token["content"] for token in json.load(open(path, encoding="utf-8"))["added_tokens"]]
    return Tokenizer.from_file(path), re.compile("|".join(map(re.escape, literals)) or r"(?!)")


#: A blank next to other white space, or at an end of the text, is not always a word boundary.
_ODD_BLANK = re.compile(r"^ |\s | \s| $")


class WordCache:
    """Token ids of texts; words between single blanks are encoded once and remembered.

    With ``added`` a text that holds an added token's literal is encoded by the library itself, which
    gives the token's id; otherwise the literal is ordinary text.
    """

    def __init__(self, path: str, added: bool = True) -> None:
        self.encode = encoder(path).encode_ordinary
        self.library, self.literals = library(path) if added else (None, None)
        self.known: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        ids = np.array(self.encode(word), "<u4").tobytes()
        if len(word) <= 64:
            self.known[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if self.literals and self.literals.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if not text or _ODD_BLANK.search(text):
            return np.array(self.encode(text), "<u4").tobytes()
        first, *rest = text.split(" ")
        get, word = self.known.get, self._word
        parts = [get(w) or word(w) for w in [first, *(" " + w for w in rest)]]
        return b"".join(parts)


def pieces(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END, added: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece; only the first piece of a longer text may be shorter."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCache(path, added)
        mark = np.array([end], "<u4").tobytes()
        for batch in (part for whole in batches for part in row_slices(whole)):
            rows: list[tuple[int, int, int, int, int]] = []
            for i, value in enumerate(batch.column(1).to_pylist()):
                ids = cache.ids(value or "") + mark
                n = len(ids) // 4
                start, piece = 0, 0
                while start < n:
                    length = (n - start - 1) % capacity + 1
                    rows.append((i, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                    start, piece = start + length, piece + 1
            table = np.array(rows, np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(table[:, 0])), pa.array(table[:, 1].astype(np.int32)), *(pa.array(table[:, k]) for k in (2, 3, 4))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, F.col(text).cast("string")).mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class TightestFit:
    """A segment tree over remaining capacities 0..capacity that holds how many bins are open at each."""

    def __init__(self, capacity: int) -> None:
        self.width = 1 << capacity.bit_length()
        self.bins = [0] * (2 * self.width)

    def add(self, remaining: int, number: int) -> None:
        node = remaining + self.width
        while node:
            self.bins[node] += number
            node >>= 1

    def find(self, need: int) -> int | None:
        """The smallest remaining capacity of at least ``need`` that has an open bin."""
        node = need + self.width
        if self.bins[node]:
            return need
        while node > 1:
            if not node & 1 and self.bins[node + 1]:
                node += 1
                while node < self.width:
                    node = 2 * node if self.bins[2 * node] else 2 * node + 1
                return node - self.width
            node >>= 1
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit decreasing for ``counts`` pieces of each length.

    Rows (length, first, number, bin, each, offset): the pieces numbered first .. first + number - 1
    go to the bins from ``bin`` on, ``each`` pieces a bin, beginning at ``offset`` in each.
    """
    tree, free = TightestFit(capacity), defaultdict(deque)
    out, opened = [], 0
    for length in sorted(counts, reverse=True):
        done, left = 0, counts[length]
        while left:
            room = tree.find(length)
            if room is None:
                # No open bin fits: as many new bins as the rest of this length will fill.
                room, number = capacity, -(-left // (capacity // length))
                tree.add(room, number)
                free[room].append((opened, number))
                opened += number
            bin_, bins = free[room].popleft()
            each = room // length
            full = min(bins, left // each)
            if full:
                out.append((length, done, full * each, bin_, each, capacity - room))
                rest = room - each * length
                free[rest].append((bin_, full))
                tree.add(room, -full)
                tree.add(rest, full)
                done, left = done + full * each, left - full * each
                if bins > full:
                    free[room].appendleft((bin_ + full, bins - full))
            else:
                # The last pieces of this length begin a bin without filling it.
                out.append((length, done, left, bin_, left, capacity - room))
                rest = room - left * length
                free[rest].append((bin_, 1))
                tree.add(room, -1)
                tree.add(rest, 1)
                if bins > 1:
                    free[room].appendleft((bin_ + 1, bins - 1))
                done, left = done + left, 0
    return out


def pack(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END, added: bool = True) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = pieces(docs, path, doc_id=doc_id, text=text, capacity=capacity, end=end, added=added)
    salted = cut_lineage(cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", F.rand(7)), F.lit(SALTS)).cast("int")))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    # At most capacity * SALTS rows: the pieces of a length are numbered part by part.
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n"))
    total = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    steps = np.array(plan(total, capacity), np.int64).reshape(-1, 6)
    # Ranks are made unique over all lengths, so that one search finds a piece's step.
    lengths = np.array(sorted(total), np.int64)
    base = dict(zip(lengths.tolist(), np.cumsum([0, *(total[n] for n in lengths.tolist())])[:-1].tolist(), strict=True))
    begin = np.array([base[n] for n in steps[:, 0].tolist()], np.int64) + steps[:, 1]
    order = np.argsort(begin)
    begin, steps = begin[order], steps[order]
    shift = np.zeros(capacity + 1, np.int64)
    shift[lengths] = [base[n] for n in lengths.tolist()]
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1
    numbered = salted.withColumn("within", within).join(before.drop("n"), ["length", "salt"])
    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("within")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            key = shift[length] + rank
            step = steps[np.searchsorted(begin, key, side="right") - 1] if len(steps) else np.zeros((0, 6), np.int64)
            nth = key - (shift[length] + step[:, 1])
            bin_ = step[:, 3] + nth // np.maximum(step[:, 4], 1)
            offset = step[:, 5] + nth % np.maximum(step[:, 4], 1) * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(bin_), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return numbered.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
