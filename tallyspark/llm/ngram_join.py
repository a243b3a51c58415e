"""N-gram Jaccard self-join by MinHash banding.

Texts are lower-cased and split at ASCII white space; their distinct five-word shingles are hashed
to 64 bits.  Texts with equal shingle sets form one class, so copies never meet again.  One member
of each class goes to its bands: the numbers of bands and rows follow from the threshold and the
target recall.  Documents shuffle on their band hashes; buckets with the same members in several
bands are merged, large buckets are dealt into blocks, and every block (or pair of blocks) verifies
its pairs on the full shingle sets.  A pair is counted in the first band it shares.  Blocks return a
link count and a local root for each document, never the pairs themselves.

The work is done on classes of texts, never on ids, so an id may repeat or be null.

Defined results: a text that is null or has no word links with nothing and is its own component; a
text of one to four words has one shingle, its whole word list; every row is a document of its own,
also if its id repeats; a component of rows without any id has a null component_id and all its
rows are kept, since no id tells them apart; columns of other names are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import cut_lineage, fold_case, mix64, run_hashes, segments, sieved, slices
from tallyspark.llm.components import connected_components, named_components

WORDS = 5
THRESHOLD = 0.8
#: A bucket of more members is dealt into blocks of about this many.
BLOCK = 400


def choose_bands(threshold: float = THRESHOLD, recall: float = 0.999, most: int = 160) -> tuple[int, int]:
    """(bands, rows): the most rows whose bands, within ``most`` hashes, find a pair at the threshold
    with probability ``recall``."""
    best = None
    for rows in range(1, 33):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands * rows <= most:
            best = bands, rows
    if best is None:
        raise ValueError("no banding reaches this recall within the hashes allowed")
    return best


def shingles(data: np.ndarray, ends: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after the other, and the n + 1 bounds."""
    inside = (data != 32) & ((data < 9) | (data > 13))
    starts, lengths, first = segments(inside, ends)
    word = run_hashes(fold_case(data), starts, lengths)
    count = np.diff(first)
    number = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    owner = np.repeat(np.arange(len(count)), number)
    offset = np.zeros(len(count) + 1, np.int64)
    np.cumsum(number, out=offset[1:])
    at = first[:-1][owner] + np.arange(int(offset[-1])) - offset[:-1][owner]
    left = first[1:][owner] - at
    value = np.zeros(len(at), np.uint64)
    for k in range(words):
        there = left > k
        value[there] = mix64(value[there] + word[at[there] + k] + np.uint64(k + 1))
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[fresh], np.searchsorted(owner[fresh], np.arange(len(count) + 1))


def band_hashes(value: np.ndarray, bounds: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The band hashes of each text with shingles (bounds strictly rise); a row for each text."""
    random = np.random.default_rng(20240229)
    factor = random.integers(0, 2**32, bands * rows, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    add = random.integers(0, 2**32, bands * rows, dtype=np.uint64).astype(np.uint32)
    short = (value >> np.uint64(32)).astype(np.uint32) ^ value.astype(np.uint32)
    out = np.zeros((len(bounds) - 1, bands), np.uint64)
    for band in range(bands):
        mixed = np.full(len(bounds) - 1, band + 1, np.uint64)
        for row in range(band * rows, band * rows + rows):
            hashed = short * factor[row] + add[row]
            hashed ^= hashed >> np.uint32(15)
            least = np.minimum.reduceat(hashed * np.uint32(0x2C1B3C6D), bounds[:-1])
            mixed = mix64(mixed + least.astype(np.uint64))
        out[:, band] = mixed
    return out


def prints(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 128-bit print of each text's shingle set, as two rows of 64 bits (bounds strictly rise)."""
    out = np.zeros((2, len(bounds) - 1), np.uint64)
    for k in range(2):
        total = np.add.reduceat(mix64(value + np.uint64(0x1234567 * (k + 1))), bounds[:-1])
        out[k] = mix64(total + np.diff(bounds).astype(np.uint64))
    return out.view(np.int64)


def signatures(docs: DataFrame, *, doc_id: str, text: str, bands: int, rows: int, words: int) -> DataFrame:
    """(doc_id, f1, f2, bands): a 128-bit print of the shingle set and the band hashes; null without words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, ends in slices(batch.column(1)):
                value, bounds = shingles(data, ends, words)
                full = np.flatnonzero(np.diff(bounds))
                n = hi - lo
                both = np.zeros((2, n), np.int64)
                hashed = np.zeros((n, bands), np.uint64)
                if len(full):
                    cut = np.append(bounds[full], bounds[-1])
                    both[:, full] = prints(value, cut)
                    hashed[full] = band_hashes(value, cut, bands, rows)
                empty = np.ones(n, bool)
                empty[full] = False
                cells = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(hashed.ravel().view(np.int64)))
                none = pa.scalar(None, pa.int64())
                columns = [pa.compute.if_else(pa.array(empty), none, pa.array(p)) for p in both]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), *columns, cells], names=["doc_id", "f1", "f2", "bands"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, F.col(text).cast("string")).mapInArrow(sign, f"doc_id {kind}, f1 long, f2 long, bands array<long>")


def _shingle_table(texts: DataFrame, words: int) -> DataFrame:
    """(f1, f2, shingles) of each text with words: its print and its sorted shingle hashes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, ends in slices(batch.column(0)):
                value, bounds = shingles(data, ends, words)
                full = np.flatnonzero(np.diff(bounds))
                both = prints(value, np.append(bounds[full], bounds[-1])) if len(full) else np.zeros((2, 0), np.int64)
                sets = [value[bounds[i] : bounds[i + 1]].tobytes() for i in full]
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1]), pa.array(sets, pa.binary())], names=["f1", "f2", "shingles"])

    return texts.mapInArrow(cut, "f1 long, f2 long, shingles binary")


def shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of the given sets of distinct hashes."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    kinds, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = times == n
    out = np.full((n, n), int(common.sum()), np.float32)
    useful = np.flatnonzero((times > 1) & ~common)
    place = np.full(len(kinds), -1)
    place[useful] = np.arange(len(useful))
    column = place[column]
    owner, column = owner[column >= 0], column[column >= 0]
    step = max(1, 8_000_000 // n)
    for lo in range(0, len(useful), step):
        some = (column >= lo) & (column < lo + step)
        table = np.zeros((n, min(step, len(useful) - lo)), np.float32)
        table[owner[some], column[some] - lo] = 1
        out += table @ table.T
    return out


def local_roots(linked: np.ndarray) -> np.ndarray:
    """The smallest index that each index reaches in a symmetric adjacency matrix."""
    n = len(linked)
    root = np.arange(n)
    while True:
        low = np.where(linked, root[None, :], n).min(axis=1, initial=n)
        new = np.minimum(root, low)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def verify(sets: list[np.ndarray], bands: np.ndarray, copies: np.ndarray, block: np.ndarray, band: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each member of a bucket (counting copies) and its local root's place.

    If the bucket's members come from two blocks, only pairs across them count.  A pair that shares
    an earlier band is left to that band.
    """
    size = np.array([len(s) for s in sets])
    both = shared(sets)
    hundred = round(threshold * 100)
    linked = np.rint(both).astype(np.int64) * 100 >= hundred * (size[:, None] + size[None, :] - np.rint(both).astype(np.int64))
    np.fill_diagonal(linked, False)
    if block.min() != block.max():
        linked &= block[:, None] != block[None, :]
    for earlier in range(band):
        linked &= bands[:, earlier][:, None] != bands[:, earlier][None, :]
    return linked @ copies, local_roots(linked)


def jaccard_join(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = 0.999, words: int = WORDS, block: int = BLOCK) -> DataFrame:
    """One row for each row of ``docs``: doc_id, copy_id, n_links, component_id, kept.

    copy_id is the smallest id of a text with the same shingle set; n_links counts the other
    documents whose Jaccard similarity is at least ``threshold``, copies included; component_id is
    the smallest id reachable by links; ``kept`` marks the document that carries it.
    """
    count, rows = choose_bands(threshold, recall)
    signed = cut_lineage(signatures(docs, doc_id=doc_id, text=text, bands=count, rows=rows, words=words))
    known = signed.where("f1 is not null")
    classes = known.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    # The checkpoint keeps each class's number.
    classes = cut_lineage(classes.withColumn("node", F.monotonically_increasing_id()))
    cells = classes.select("node", F.posexplode("bands").alias("band", "cell"))
    mark = F.xxhash64("node")
    buckets = cells.groupBy("band", "cell").agg(F.count("*").alias("n"), F.bit_xor(mark).alias("x"), F.bit_xor(F.xxhash64(mark, F.lit(7))).alias("y")).where("n > 1")
    # Buckets of different bands with the same members are verified once, in their first band.
    buckets = buckets.groupBy("n", "x", "y").agg(F.min(F.struct("band", "cell")).alias("b")).select("b.band", "b.cell", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    members = cells.join(buckets, ["band", "cell"]).withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("parts")).cast("int"))
    members = cut_lineage(members)
    # Each block meets itself and every other block of its bucket once.
    dealt = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "band", "cell", "node", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    )
    wanted = cut_lineage(classes.join(members.select("node").distinct(), "node", "left_semi"))
    # A sieve of the candidates' ids spares the other texts; what it lets through is joined by its print.
    texts = docs.select(F.col(doc_id).alias("rep"), F.col(text).cast("string").alias("text"))
    texts = sieved(texts, wanted.select("rep").distinct()).where("__maybe").select("text")
    sets = _shingle_table(texts, words).join(wanted.select("f1", "f2", "node", "copies", "bands"), ["f1", "f2"]).dropDuplicates(["node"]).drop("f1", "f2")

    def check(key: tuple, table: pa.Table) -> pa.Table:
        nodes = table["node"].to_numpy()
        hashes = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
        cells_of = np.array(table["bands"].to_pylist(), np.int64).reshape(len(nodes), count)
        links, root = verify(hashes, cells_of, table["copies"].to_numpy(), table["block"].to_numpy(), key[0].as_py(), threshold)
        some = links > 0
        return pa.table({"a": nodes[some], "b": nodes[root[some]], "links": links[some]})

    checked = cut_lineage(dealt.join(sets, "node").groupBy("band", "cell", "low", "high").applyInArrow(check, "a long, b long, links long"))
    components = named_components(connected_components(checked.select("a", "b")), classes)
    links = checked.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    found = classes.join(links, "node", "left").join(components, "node", "left")
    component = F.when(F.col("joined"), F.col("component")).otherwise(F.col("rep")).alias("component")
    found = found.select("f1", "f2", "rep", "copies", "links", component)
    joined = signed.select("doc_id", "f1", "f2").join(found, ["f1", "f2"], "left")
    lone = F.col("copies").isNull()
    component = F.when(lone, F.col("doc_id")).otherwise(F.col("component"))
    return joined.select(
        F.col("doc_id").alias(doc_id),
        F.when(lone, F.col("doc_id")).otherwise(F.col("rep")).alias("copy_id"),
        (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("doc_id")).alias("kept"),
    )
