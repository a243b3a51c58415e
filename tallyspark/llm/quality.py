"""Quality scores by nearest-neighbour voting on latent-semantic vectors.

A text's terms are its character n-grams, once with letters and digits folded to their classes and
once lower-cased, and the distances at which a word comes again.  Term weights are the square roots
of relative frequencies times inverse document frequencies, which are counted over every document.
A truncated singular value decomposition of a bounded labelled sample gives the latent directions.
Every document is multiplied, block by block, with all labelled vectors (they are few by
construction and go to every task), and its nearest neighbours vote with their cosine as weight.

Defined results: a null or empty text has no terms and gets the share of label 1 as its score; if
no label is given every score is 0.5; ties between neighbours go to the earlier id; repeated rows
are scored alike; columns of other names are passed through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.common import fold_case, run_hashes, segments, slices, sum_by

SHAPE_BITS, GRAM_BITS = 11, 11
LAGS = 12
TERMS = (1 << SHAPE_BITS) + (1 << GRAM_BITS) + LAGS
#: Documents of one block of cosine products.
BLOCK = 512
#: How often a word comes again within a few words is one number for each distance, against thousands for the
#: n-grams; this weight gives repetition, a mark of poor texts, a say beside them.
LAG_WEIGHT = 4.0
#: Cosines of neighbours lie close together; this power lets the nearest of them lead the vote.
SHARPNESS = 8

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[48:58], _SHAPE[128:] = 65, 97, 48, 97


def _hashed(codes: np.ndarray, bits: int) -> np.ndarray:
    padded = np.concatenate((codes, np.full(2, 32, np.uint8))).astype(np.uint32)
    triple = padded[:-2] | padded[1:-1] << np.uint32(8) | padded[2:] << np.uint32(16)
    return (triple * np.uint32(2654435761)) >> np.uint32(32 - bits)


def term_counts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Relative frequencies of the terms of each text; each of the three kinds sums to 1 or less."""
    n = len(ends) - 1
    owner = np.repeat(np.arange(n), np.diff(ends))
    out = np.zeros((n, TERMS), np.float32)
    length = np.maximum(np.diff(ends), 1)[:, None]
    for start, bits, codes in ((0, SHAPE_BITS, _SHAPE[data]), (1 << SHAPE_BITS, GRAM_BITS, fold_case(data))):
        width = 1 << bits
        counts = np.bincount(owner * width + _hashed(codes, bits), minlength=n * width).reshape(n, width)
        out[:, start : start + width] = counts / length
    starts, lengths, first = segments(data > 32, ends)
    word = run_hashes(data, starts, lengths)
    text = np.repeat(np.arange(n), np.diff(first))
    number = np.maximum(np.diff(first), 1)
    for lag in range(1, LAGS + 1):
        again = np.zeros(len(word), np.int64)
        if len(word) > lag:
            again[lag:] = (word[lag:] == word[:-lag]) & (text[lag:] == text[:-lag])
        out[:, TERMS - LAGS + lag - 1] = sum_by(again, first) / number
    return out


def _blocks(column: pa.Array) -> Iterator[np.ndarray]:
    for _, _, data, ends in slices(column):
        for lo in range(0, len(ends) - 1, BLOCK):
            part = ends[lo : lo + BLOCK + 1]
            yield term_counts(data[part[0] : part[-1]], part - part[0])


def nearest(cosine: np.ndarray, number: int) -> np.ndarray:
    """The places of the ``number`` largest values of each row; of equal ones the first."""
    near = np.argpartition(-cosine, number - 1, axis=1)[:, :number]
    least = np.take_along_axis(cosine, near, axis=1).min(axis=1, keepdims=True)
    # Where more values than there is room for reach the least one, its first holders are taken.
    for row in np.flatnonzero((cosine >= least).sum(axis=1) > number):
        near[row] = np.argsort(-cosine[row], kind="stable")[:number]
    return near


@dataclass(frozen=True)
class NeighbourVote:
    """A fitted model: term weights, latent directions, labelled vectors with their labels and vote weights."""

    weights: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    votes: np.ndarray
    share: float
    neighbours: int = 15

    def latent(self, counts: np.ndarray) -> np.ndarray:
        vectors = (np.sqrt(counts) * self.weights) @ self.directions
        return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)

    def score(self, counts: np.ndarray) -> np.ndarray:
        out = np.full(len(counts), self.share)
        full = counts.any(axis=1)
        if not len(self.labels) or not full.any():
            return out
        cosine = self.latent(counts[full]) @ self.vectors.T
        number = min(self.neighbours, cosine.shape[1])
        near = nearest(cosine, number)
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(float) ** SHARPNESS * self.votes[near] + 1e-9
        out[full] = (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)
        return np.clip(out, 0, 1)

    def transform(self, docs: DataFrame, *, text: str = "text", score: str = "score") -> DataFrame:
        """All columns of ``docs`` and the score; a column of the result's name is replaced."""
        docs = docs.drop(score)
        place = docs.columns.index(text)
        schema = T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())])

        def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                value = np.concatenate([*(self.score(counts) for counts in _blocks(batch.column(place))), np.zeros(0)])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value)], names=schema.names)

        return docs.mapInArrow(label, schema)


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """How many of all documents hold each term, and the number of documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = np.zeros(TERMS, np.int64), 0
        for batch in batches:
            number += len(batch)
            for counts in _blocks(batch.column(0)):
                held += (counts > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, TERMS, dtype=np.int32)), pa.array(np.append(number, held))], names=["term", "n"])

    rows = docs.select(F.col(text).cast("string")).mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(TERMS + 1, np.int64)
    for row in rows:
        out[row.term + 1] = row.n
    return out[1:], int(out[0])


def principal_directions(rows: np.ndarray, number: int, rounds: int = 4) -> np.ndarray:
    """The leading right singular vectors by subspace iteration, scaled to even out their reach a little."""
    random = np.random.default_rng(11)
    basis = np.linalg.qr(random.standard_normal((rows.shape[1], number + 8)))[0].astype(np.float32)
    for _ in range(rounds):
        basis = np.linalg.qr(rows.T @ (rows @ basis))[0].astype(np.float32)
    _, values, turned = np.linalg.svd(rows @ basis, full_matrices=False)
    return (basis @ turned.T)[:, :number] / np.sqrt(np.maximum(values[:number], 1e-6))


def fit(docs: DataFrame, labels: DataFrame, *, learn: DataFrame, sample_per_label: int = 1500, directions: int = 48, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> NeighbourVote:
    """Fit on at most ``sample_per_label`` rows of either label, those of the smallest id hash.

    Document frequencies come from all of ``docs``; labels are used only for ids in ``learn``.
    """
    held, number = document_frequencies(docs, text)
    weights = np.log((number + 1) / (held + 1) + 0.1).clip(0.05).astype(np.float32)
    weights[TERMS - LAGS :] = LAG_WEIGHT
    known = labels.where(F.col(label).isin(0, 1)).select(doc_id, F.col(label).cast("int").alias("__label"))
    known = known.join(learn.select(doc_id), doc_id, "left_semi")
    total = {row["__label"]: row["count"] for row in known.groupBy("__label").count().collect()}
    parts = [known.where(F.col("__label") == kind).orderBy(F.xxhash64(doc_id), doc_id).limit(sample_per_label) for kind in (0, 1)]
    # At most 2 * sample_per_label ids: their size is bounded by the parameter.
    chosen = F.broadcast(parts[0].unionByName(parts[1]))
    rows = learn.select(doc_id, F.col(text).cast("string").alias("__text")).join(chosen, doc_id).select("__label", "__text", F.xxhash64(doc_id))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [row.tobytes() for counts in _blocks(batch.column(1)) for row in counts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.binary()), batch.column(2)], names=["label", "counts", "mark"])

    # At most 2 * sample_per_label rows of TERMS numbers.
    sample = sorted(rows.mapInArrow(measure, "label int, counts binary, mark long").collect(), key=lambda r: (r.mark, r.label, r.counts))
    marks = np.array([row.label for row in sample], int)
    matrix = np.array([np.frombuffer(row.counts, np.float32) for row in sample], np.float32).reshape(len(sample), TERMS)
    share = total.get(1, 0) / max(1, sum(total.values())) if total else 0.5
    if not len(sample):
        return NeighbourVote(weights, np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), marks, np.zeros(0), share)
    matrix = np.sqrt(matrix) * weights
    turned = principal_directions(matrix, min(directions, len(matrix)))
    vectors = matrix @ turned
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    # Votes undo the sample's even share of the labels.
    votes = np.array([(total.get(kind, 0) / max(1, (marks == kind).sum())) for kind in (0, 1)])[marks]
    return NeighbourVote(weights, turned.astype(np.float32), vectors.astype(np.float32), marks, votes / votes.max(), share)
