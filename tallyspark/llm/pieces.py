"""SentencePiece encoding and decoding with a unigram model.

The pieces of a model file form a double-array trie over UTF-8 bytes.  Encoding finds the
segmentation of largest total log score by Viterbi search; a character that no piece covers falls
back to its byte pieces.  Blanks become whitespace markers, with one marker in front of the text.
Decoding turns markers back into blanks and byte pieces into characters.

No piece holds a marker after another character, so a text splits into marker-led words whose best
segmentations are independent.  Each task encodes a batch's new words together and remembers them.

Scores are the file's; if the file holds merge ranks (whole numbers), a piece of rank r gets the
log probability of Zipf's law, log(1 / ((r + 1) * H)).

Defined results: a null text gives null; an empty text gives no pieces; a marker character in the
text decodes as a blank, as in the original format; ids that are null, negative or beyond the
vocabulary are refused; repeated rows are
encoded alike; columns of other names are passed through.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MARK = "▁"
#: An unknown character costs this much more than the worst piece.
UNKNOWN_COST = 10.0
#: Words in each of the two generations that a task remembers.
REMEMBERED = 250_000
#: Words searched together, and the places of all of them, which bounds a search's memory.
TOGETHER, PLACES = 4096, 2_000_000


class DoubleArrayTrie:
    """Keys of bytes with values; the child of node s by byte c is base[s] + c if check agrees."""

    def __init__(self, keys: Iterable[tuple[bytes, int]]) -> None:
        tree: list[dict[int, int]] = [{}]
        values = [-1]
        for key, value in keys:
            node = 0
            for c in key:
                if c not in tree[node]:
                    tree[node][c] = len(tree)
                    tree.append({})
                    values.append(-1)
                node = tree[node][c]
            values[node] = value
        size = 4 * len(tree) + 1024
        base, check, leaf = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        used = np.zeros(size, bool)
        used[0] = True
        # Single children fill the gaps that the families before them left.
        single, family, todo = 1, 1, [(0, 0)]
        for node, place in todo:
            leaf[place] = values[node]
            children = sorted(tree[node])
            if not children:
                continue
            steps = np.array(children)
            if len(children) == 1:
                single = max(single, children[0] + 1)
                while used[single]:
                    single += 1
                at = single - children[0]
            else:
                fits = np.zeros(0, np.int64)
                while not len(fits):
                    starts = np.arange(family, family + 256)
                    fits = np.flatnonzero(~used[starts[:, None] + steps].any(axis=1))
                    family += 0 if len(fits) else 128
                at = int(starts[fits[0]])
            base[place] = at
            used[at + steps] = True
            check[at + steps] = place
            todo.extend((tree[node][c], at + c) for c in children)
        last = int(np.flatnonzero(used).max()) + 257
        self.base, self.check, self.leaf = base[:last].astype(np.int64), check[:last].astype(np.int64), leaf[:last]


@dataclass(frozen=True)
class PieceModel:
    """Pieces with log scores, the byte pieces and the trie of all others."""

    pieces: tuple[str, ...]
    scores: np.ndarray
    byte_ids: np.ndarray
    trie: DoubleArrayTrie
    longest: int
    words: bool

    @classmethod
    def load(cls, path: str) -> PieceModel:
        """Read a SentencePiece model file's vocabulary."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        kinds = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in ids]
        return cls.build([model.id_to_piece(i) for i in ids], [model.get_score(i) for i in ids], kinds)

    @classmethod
    def build(cls, pieces: list[str], scores: list[float], special: list[bool]) -> PieceModel:
        value = np.array(scores, np.float64)
        if (value == np.rint(value)).all():
            rank = np.minimum(-value, len(pieces)).clip(0)
            value = -np.log((rank + 1) * np.log(len(pieces) + 1))
        byte_ids = np.full(256, -1, np.int32)
        for i, piece in enumerate(pieces):
            if special[i] and re.fullmatch("<0x[0-9A-F]{2}>", piece):
                byte_ids[int(piece[3:5], 16)] = i
        usable = [(piece.encode(), i) for i, piece in enumerate(pieces) if not special[i] and piece]
        apart = all(MARK not in piece[1:] or not piece.strip(MARK) for i, piece in enumerate(pieces) if not special[i])
        return cls(tuple(pieces), value, byte_ids, DoubleArrayTrie(usable), max(map(len, (k for k, _ in usable))), apart)

    def viterbi(self, words: list[bytes]) -> list[bytes]:
        """The best segmentation of each word of UTF-8 bytes, as little-endian 32-bit ids."""
        size = np.array([len(word) for word in words], np.int64)
        order = np.argsort(size, kind="stable")
        out: list[bytes] = [b""] * len(words)
        lo = 0
        while lo < len(order):
            # Words of very different lengths are searched apart, and long ones few at a time.
            longest = size[order[lo : lo + TOGETHER]]
            fits = (longest <= max(2 * longest[0], 24)) & ((longest + 1) * np.arange(1, len(longest) + 1) <= PLACES)
            hi = lo + max(1, int(fits.sum()))
            some = order[lo:hi].tolist()
            for i, ids in zip(some, self._search([words[i] for i in some]), strict=True):
                out[i] = ids
            lo = hi
        return out

    def _search(self, words: list[bytes]) -> list[bytes]:
        n = len(words)
        length = np.array([len(word) for word in words])
        width = int(length.max())
        padded = np.frombuffer(b"".join(word.ljust(width + 1, b"\0") for word in words), np.uint8)
        text = np.ascontiguousarray(padded.reshape(n, width + 1).T).astype(np.int64)
        best = np.full((width + 1, n), -np.inf)
        best[0] = 0
        came, piece = np.zeros((width + 1, n), np.int32), np.full((width + 1, n), -1, np.int32)
        # The bytes of the character that begins here.
        letter = (1 + (text >= 0xC0) + (text >= 0xE0) + (text >= 0xF0)).astype(np.int8)
        opens = (text & 0xC0) != 0x80
        unknown = self.scores.min() - UNKNOWN_COST
        base, check, leaf = self.trie.base, self.trie.check, self.trie.leaf
        for start in range(width):
            rows = np.flatnonzero(opens[start] & (start < length))
            if not len(rows):
                continue
            covered = np.zeros(n, bool)
            here, node = rows, np.zeros(len(rows), np.int64)
            for stop in range(start + 1, min(width, start + self.longest) + 1):
                following = base[node] + text[stop - 1, here]
                ok = (check[following] == node) & (stop <= length[here])
                here, node = here[ok], following[ok]
                if not len(here):
                    break
                found = leaf[node]
                full = found >= 0
                at, ids = here[full], found[full]
                if stop - start <= 4:
                    covered[at[letter[start, at] == stop - start]] = True
                score = best[start, at] + self.scores[ids]
                better = score > best[stop, at]
                at = at[better]
                best[stop, at], came[stop, at], piece[stop, at] = score[better], start, ids[better]
            bare = rows[~covered[rows]]
            stop = np.minimum(letter[start, bare] + np.int64(start), length[bare])
            score = best[start, bare] + unknown
            better = score > best[stop, bare]
            bare, stop = bare[better], stop[better]
            best[stop, bare], came[stop, bare], piece[stop, bare] = score[better], start, -1
        # All words are followed back to their starts together.
        word, at = np.arange(n), length
        word, at = word[at > 0], at[at > 0]
        owners, starts, chosen = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        while len(word):
            start, found = came[at, word].astype(np.int64), piece[at, word]
            bare = found < 0
            owners.append(word[~bare])
            starts.append(start[~bare])
            chosen.append(found[~bare])
            for w, first, last in zip(word[bare].tolist(), start[bare].tolist(), at[bare].tolist(), strict=True):
                owners.append(np.full(last - first, w))
                starts.append(np.arange(first, last))
                chosen.append(self.byte_ids[text[first:last, w]])
            word, at = word[start > 0], start[start > 0]
        owner, first, ids = np.concatenate(owners), np.concatenate(starts), np.concatenate(chosen).astype("<i4")
        order = np.lexsort((first, owner))
        whole = ids[order].tobytes()
        ends = (4 * np.searchsorted(owner[order], np.arange(n + 1))).tolist()
        return [whole[lo:hi] for lo, hi in zip(ends, ends[1:])]

    def decode_table(self) -> list[bytes]:
        """What each id adds to a decoded text."""
        table = [piece.replace(MARK, " ").encode() for piece in self.pieces]
        for byte, i in enumerate(self.byte_ids.tolist()):
            if i >= 0:
                table[i] = bytes([byte])
        return table


_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")


class Encoder:
    """Ids of texts; the segmentations of words are remembered up to a bound."""

    def __init__(self, model: PieceModel) -> None:
        self.model = model
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _split(self, text: str) -> list[str]:
        marked = MARK + text.replace(" ", MARK)
        return _CHUNK.findall(marked) if self.model.words else [marked]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        chunks = [self._split(text) if text else [] for text in texts]
        words = set().union(*chunks)
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        missing = words - self.known.keys()
        again = missing & self.older.keys()
        self.known.update((word, self.older[word]) for word in again)
        fresh = list(missing - again)
        for word, ids in zip(fresh, self.model.viterbi([w.encode("utf-8", "replace") for w in fresh]), strict=True):
            self.known[word] = ids
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in chunks]


def encode(docs: DataFrame, model: PieceModel, *, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns of ``docs`` and the piece ids; a column of the result's name is replaced."""
    docs = docs.drop(ids)
    place = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        for whole in batches:
            for lo in range(0, len(whole), 500):
                batch = whole.slice(lo, 500)
                texts = batch.column(place).to_pylist()
                rows = encoder.encode([value or "" for value in texts])
                ends = np.concatenate(([0], np.cumsum([len(row) // 4 for row in rows]))).astype(np.int32)
                gone = pa.array([value is None for value in texts])
                column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows), "<i4")), mask=gone)
                yield pa.RecordBatch.from_arrays([*batch.columns, column], names=schema.names)

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, model: PieceModel, *, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """All columns of ``rows`` and the text of the piece ids; a column of the result's name is replaced."""
    rows = rows.drop(text)
    place = rows.columns.index(ids)
    schema = T.StructType([*rows.schema.fields, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.decode_table()
        for whole in batches:
            for lo in range(0, len(whole), 500):
                batch = whole.slice(lo, 500)
                out: list[str | None] = []
                for found in batch.column(place).to_pylist():
                    if found is None:
                        out.append(None)
                        continue
                    if None in found or found and not 0 <= min(found) <= max(found) < len(table):
                        raise ValueError("an id is null, negative or beyond the vocabulary")
                    joined = b"".join(map(table.__getitem__, found))
                    out.append((joined[1:] if joined[:1] == b" " else joined).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)
