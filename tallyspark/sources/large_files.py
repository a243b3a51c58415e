"""Exports of any size: byte ranges of one file are read by many tasks.

Spark splits a file at line feeds.  Whether a line feed lies inside a quoted cell is not known in the
middle of a file, so a first pass follows each split from both states, outside and inside a quote, and
notes the state at its end and the lines it counts.  The splits' notes are a few hundred bytes each; for
each file they are followed from its start, which gives every split its true state, line and place.  A
second pass emits records from there.  A record that crosses splits is emitted in pieces by the splits it
touches, which meet again by the split in which it began.

The records, their lines and their marks are those of ``csv_files.read_records``, but for the text of a
quote that never closes: its cells are cut some way behind the quote, as it may swallow the rest of a file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.sources.csv_files import _BLANK, RECORD, record_frame, records_from
from tallyspark.sources.tables import written_once

#: Characters that a task parses at once, and those shown of a fault or kept behind an unclosed quote.
CHUNK, SHOWN = 4_000_000, 200
#: The notes on all splits are sent to every task; more splits than this are refused.
MOST_SPLITS = 1_000_000

_OPENING = re.compile(rf'(?:^|[,\r\n])[{_BLANK}]*"')
_CONTENT = re.compile(r'(?:[^"]+|"")*("?)')
_NOTHING = re.compile(rf"[{_BLANK}\r\n]*\Z")
_NOTES = (
    "file_id string, part long, size long, bytes long, raw_lines long, head string, bad_line long, bad_kind string, bad_text string, "
    + ", ".join(f"{c}_{k} {t}" for k in ("out", "in") for c, t in (("inside", "boolean"), ("lines", "long"), ("began", "boolean"), ("ended", "boolean"), ("opened", "boolean")))
)
_STARTS = "file_id string, part long, inside boolean, line long, header boolean, owner long, swallowed boolean, no_feed boolean, fault_line long, fault array<string>"
_PIECE = "owner long, place array<long>, text string, feeds long, swallowed_whole boolean"


def line_ends(text: str, lo: int = 0, hi: int | None = None) -> int:
    hi = len(text) if hi is None else hi
    return text.count("\n", lo, hi) + text.count("\r", lo, hi) - text.count("\r\n", lo, hi)


def follow(text: str, inside: bool) -> tuple[bool, int, bool, bool, bool]:
    """(inside a quote at the end, lines counted, whether a record begins, whether the one that was open ends, whether a quote opens).

    ``text`` is whole lines.  From outside there is no open record, so ``ended`` is true.
    """
    at, lines, ended, after, opened = 0, 0, not inside, 0, False
    while True:
        if inside:
            content = _CONTENT.match(text, at)
            lines += text.count("\n", at, content.end())
            at = content.end()
            if not content[1]:
                return True, lines, ended and not _NOTHING.match(text, after), ended, opened
            inside = False
        opening = _OPENING.search(text, at)
        stop = opening.end() if opening else len(text)
        if not ended and (end := re.compile(r"[\r\n]").search(text, at, stop)):
            ended, after = True, end.end()
        lines += line_ends(text, at, stop)
        if not opening:
            return False, lines, ended and not _NOTHING.match(text, after), ended, opened
        at, inside, opened = stop, True, True


class _Notes:
    """What a task notes of one split, chunk by chunk."""

    def __init__(self, file_id: str, part: int, size: int) -> None:
        self.key, self.bytes, self.raw_lines, self.head, self.bad = (file_id, part, size), 0, 0, "", None
        self.states = {start: [start, 0, False, not start, False] for start in (False, True)}

    def add(self, text: str, size: int) -> None:
        self.bytes += size
        # One character more than is shown tells whether a text goes on.
        if len(self.head) <= SHOWN:
            self.head += text[: SHOWN + 1 - len(self.head)]
        if self.bad is None and (bad := re.search("[\0�]", text)):
            begun = max(text.rfind("\n", 0, bad.start()), text.rfind("\r", 0, bad.start())) + 1
            self.bad = [self.raw_lines + line_ends(text, 0, bad.start()) + 1, "utf-16" if bad[0] == "\0" else "lost byte", text[begun : begun + SHOWN + 1]]
        elif self.bad is not None and len(self.bad[2]) <= SHOWN:
            self.bad[2] += text[: SHOWN + 1 - len(self.bad[2])]
        self.raw_lines += line_ends(text)
        for state in self.states.values():
            inside, lines, began, ended, opened = follow(text, state[0])
            # Once the open record has ended, any text that is not blank begins another.
            state[2] = state[2] or began
            state[3], state[4] = state[3] or ended, state[4] or opened
            state[0], state[1] = inside, state[1] + lines

    def row(self) -> tuple:
        return (*self.key, self.bytes, self.raw_lines, self.head, *(self.bad or (None, None, None)), *self.states[False], *self.states[True])


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, part, size, text, bytes): the lines of the files below ``path`` up to line feeds, in order within a split."""
    where = [F.col("_metadata.file_path").alias("file_id"), F.col("_metadata.file_block_start").alias("part"), F.col("_metadata.file_size").alias("size")]
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(*where, F.make_valid_utf8("value").alias("text"), F.octet_length("value").cast("long").alias("bytes"))


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[tuple, str, int, bool]]:
    """(key, text, bytes, whether the split ends) of runs of lines of one split; the key is all columns but the last two."""
    held: list[str] = []
    key, size, chars = None, 0, 0
    for batch in batches:
        rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
        for own, group in groupby(rows, key=lambda r: r[:-2]):
            for *_, text, length in group:
                if own != key or chars > most:
                    if key is not None:
                        yield key, "\n".join([*held, ""]), size, own != key
                    held, size, chars = [], 0, 0
                    key = own
                held.append(text)
                size += length + 1
                chars += len(text) + 1
    if key is not None:
        yield key, "\n".join([*held, ""]), size, True


def split_notes(lines: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """A row of notes for each split of ``lines``."""
    names = [field.split()[0] for field in _NOTES.split(", ")]

    def note(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        notes = None
        for key, text, size, last in _chunks(batches, chunk):
            notes = notes or _Notes(*key)
            notes.add(text, size)
            if last:
                yield pa.RecordBatch.from_pandas(pd.DataFrame([notes.row()], columns=names).astype({"bad_line": "Int64"}), schema=_arrow(_NOTES), preserve_index=False)
                notes = None

    return lines.mapInArrow(note, _NOTES)


def _arrow(fields: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "int": pa.int32(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in fields.split(", "))])


def follow_splits(notes: pd.DataFrame) -> pd.DataFrame:
    """The true start of each split of one file: state, line, whether the header begins in it, and the split in which an open record began."""
    notes = notes.sort_values("part")
    inside, line, owner, quote, header, raw, fault, out = False, 1, None, None, False, 1, None, []
    for r in notes.itertuples():
        state = (r.inside_in, r.lines_in, r.began_in, r.ended_in, r.opened_in) if inside else (r.inside_out, r.lines_out, r.began_out, r.ended_out, r.opened_out)
        # The header of a file may be the record that is open here; then it began in an earlier split.
        first = not header and (state[2] or (not inside and state[0]))
        out.append([r.file_id, r.part, inside, line, first, owner if inside else None])
        header |= first
        if r.bad_kind is not None and fault is None:
            fault = (raw + int(r.bad_line) - 1, r.bad_kind, [r.bad_text])
        elif fault is not None and sum(map(len, fault[2])) <= SHOWN:
            fault[2].append(r.head)
        raw, line = raw + r.raw_lines, line + state[1]
        if state[0] and (state[3] or owner is None):
            owner = r.part
        if not state[0]:
            owner = None
        quote = r.part if state[4] else quote
        inside = state[0]
    total = int(notes["bytes"].sum())
    # The reader takes a byte order mark of three bytes away, and a line feed that the file's end lacks was counted.
    no_feed = int(notes["size"].iloc[0]) - total not in (0, 3)
    shown = "" if fault is None else "".join(fault[2])
    shown = shown[:-1] if no_feed and len(shown) <= SHOWN else shown[:SHOWN]
    told = None if fault is None else [fault[1], re.sub("[\0�]", "?", shown)]
    told = told or (None if header else ["empty", ""])
    at = None if told is None else fault[0] if fault else 0
    rows = []
    for k, (file_id, part, was, start, first, own) in enumerate(out):
        # A quote that never closes swallows all splits behind the one it opens in.
        rows.append((file_id, part, was, start, first, own, inside and part > quote, no_feed and k == len(out) - 1, at if k == 0 else None if told is None else -1, told))
    return pd.DataFrame(rows, columns=[field.split()[0] for field in _STARTS.split(", ")]).astype({"owner": "Int64", "fault_line": "Int64"})


def parse_split(key: tuple, chunks: Iterator[tuple[str, bool]]) -> Iterator[tuple]:
    """The rows of one split: records, and pieces of records that other splits share."""
    file_id, part, inside, line, header, owner, swallowed, no_feed, fault_line, fault = key
    if fault is not None:
        if fault_line >= 0:
            yield (file_id, -1, fault_line, fault, None, None, None, None, None, None, None)
        return
    carried, place = "", 0
    piece = lambda own, start, text, feeds, cut, first: (file_id, 0 if first else start, start, None, None, None, own, [part, place], text, feeds, cut)
    for text, last in chunks:
        text = carried + (text[:-1] if last and no_feed else text)
        carried, at = "", 0
        if inside:
            open_ = next(records_from('"' + text, 0, line))
            whole = open_.open_line is not None
            end = len(text) if whole else open_.end - 1
            yield piece(owner, line, text[: SHOWN if swallowed else end], text.count("\n", 0, end), swallowed, False)
            place += 1
            inside, line, at = whole, open_.next_line, end
            if whole:
                continue
        elif part == 0 and place == 0:
            at = int(text[:1] == "﻿")
        for r in records_from(text, at, line):
            if r.open_line is not None:
                # The rest of the chunk is inside a quote.
                carried, line = text[r.begin :], r.line
                if last:
                    yield piece(part, r.line, carried, 0, False, header)
                break
            line = r.next_line
            if not r.blank:
                yield (file_id, 0 if header else r.line, r.line, r.cells, None, None, None, None, None, None, None)
                header = False
        place += 1


def _joined(pieces: list[dict]) -> tuple[int, int, list[str], int | None, int | None]:
    """(idx, line, cells, line of an unclosed quote, lines it swallowed) of a record in pieces."""
    begun = pieces[0]
    known = "".join(p["text"] for p in pieces if not p["swallowed"])
    behind = "".join(p["text"] for p in pieces if p["swallowed"])[:SHOWN]
    record = next(records_from(known + behind, 0, begun["line"]))
    if record.open_line is None and behind:
        # The text was cut between two quotes that stand for one.
        record = next(records_from(known + behind[:-1], 0, begun["line"]))
    if record.open_line is None:
        return begun["idx"], begun["line"], record.cells, None, None
    own = next(records_from(known, 0, begun["line"]))
    return begun["idx"], begun["line"], record.cells, record.open_line, own.cells[-1].count("\n") + sum(p["feeds"] for p in pieces if p["swallowed"])


def read_large_files(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """The records of the files below ``path``, each read by as many tasks as it has splits.

    Spark's readers pass over files without a byte; a file of blank lines has its row.
    """
    lines = lines_of(spark, path)
    starts = written_once(split_notes(lines, chunk).groupBy("file_id").applyInPandas(follow_splits, _STARTS))
    if starts.count() > MOST_SPLITS:
        raise ValueError(f"more than {MOST_SPLITS} splits: raise spark.sql.files.maxPartitionBytes")
    keys = [field.split()[0] for field in _STARTS.split(", ")]
    schema = f"{RECORD}, {_PIECE}"
    names = [field.split()[0] for field in schema.split(", ")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _arrow(schema), strict=True)], names=names)

        held: list[tuple] = []
        for key, group in groupby(_chunks(batches, chunk), key=lambda c: c[0]):
            for row in parse_split(key, ((text, last) for _, text, _, last in group)):
                held.append(row)
                if len(held) == 20_000:
                    yield emit(held)
                    held = []
        if held:
            yield emit(held)

    placed = lines.join(F.broadcast(starts), ["file_id", "part"]).select(*keys, "text", "bytes")
    rows = written_once(placed.mapInArrow(parse, schema))
    record = [field.split()[0] for field in RECORD.split(", ")]
    part = F.struct("place", "idx", "line", "text", "feeds", F.col("swallowed_whole").alias("swallowed"))
    shared = rows.where("owner is not null").groupBy("file_id", "owner").agg(F.array_sort(F.collect_list(part)).alias("pieces"))

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file_id, pieces in zip(batch["file_id"], batch["pieces"], strict=True):
                rows.append((file_id, *_joined([dict(p) if isinstance(p, dict) else p.asDict() for p in pieces])))
            yield record_frame(rows)

    joined = shared.select("file_id", "pieces").mapInPandas(join, RECORD)
    return rows.where("owner is null").select(*record).unionByName(joined)
