"""Language identification as inference in a mixture of language models.

Each language has a smoothed distribution over hashed byte n-grams, counted over every training
text by Spark.  A document's words are taken as draws from an unknown mixture of the languages.
Expectation-maximisation estimates the proportions, and the set of languages is chosen by
penalised likelihood among the nested sets of the largest proportions.

Defined results: a text that is null or has no letter gives ``und`` with score 0; a table without
any training label gives ``und`` for every row; a text may hold any number of the languages; equal
proportions go to the label that sorts first;
repeated rows are scored alike; columns of other names are passed through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.common import fold_case, segments, slices, sum_by

UNDETERMINED = "und"
#: N-grams are hashed to 2**BUCKET_BITS counters for each language.
BUCKET_BITS = 15
ORDER = 3
#: More labels than this are refused, which bounds the model that every task receives.
MAX_LANGUAGES = 256

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def _grams(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of every word (with the blank before it), the first n-gram of each word and,
    per text, the first word."""
    inside = _LETTER[data]
    starts, lengths, words = segments(inside, ends)
    place = np.flatnonzero(inside)
    letters = fold_case(data)[place].astype(np.uint32)
    first = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=first[1:])
    code = letters.copy()
    back = letters
    opened = np.zeros(len(letters), bool)
    opened[first[:-1]] = True
    for k in range(1, ORDER):
        back = np.concatenate((np.full(1, 32, np.uint32), back[:-1]))[: len(letters)]
        back[opened] = 32
        code |= back << np.uint32(8 * k)
    return (code * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS), first, words


@dataclass(frozen=True)
class LanguageMixture:
    """A fitted model: ``log_probability`` has a row for each bucket and a column for each language."""

    languages: tuple[str, ...]
    log_probability: np.ndarray
    rounds: int = 6
    set_rounds: int = 4
    penalty: float = 1.0

    @classmethod
    def fit(cls, docs: DataFrame, *, text: str = "text", label: str = "lang", smoothing: float = 0.5) -> LanguageMixture:
        """Count the n-grams of every row whose label is not null; rows are neither sampled nor cut."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals: dict[str, np.ndarray] = {}
            for batch in batches:
                names = batch.column(0).to_pylist()
                for lo, _, data, ends in slices(batch.column(1)):
                    grams, first, words = _grams(data, ends)
                    bounds = first[words]
                    labels = np.repeat(np.arange(len(ends) - 1), np.diff(bounds))
                    own = [names[lo + i] for i in range(len(ends) - 1)]
                    kinds = sorted(set(own))
                    code = np.array([kinds.index(x) for x in own])[labels]
                    counts = np.bincount((code << BUCKET_BITS) + grams, minlength=len(kinds) << BUCKET_BITS)
                    for k, kind in enumerate(kinds):
                        part = counts[k << BUCKET_BITS : (k + 1) << BUCKET_BITS]
                        totals[kind] = totals[kind] + part if kind in totals else part
            for kind, row in totals.items():
                seen = np.flatnonzero(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([kind] * len(seen), pa.string()), pa.array(seen.astype(np.int32)), pa.array(row[seen])],
                    names=["kind", "bucket", "n"],
                )

        known = docs.where(F.col(label).isNotNull()).select(F.col(label).cast("string"), F.col(text).cast("string"))
        counted = known.mapInArrow(count, "kind string, bucket int, n long").groupBy("kind", "bucket").agg(F.sum("n").alias("n"))
        totals: dict[str, np.ndarray] = {}
        for row in counted.toLocalIterator():
            if row.kind not in totals:
                if len(totals) == MAX_LANGUAGES:
                    raise ValueError(f"more than {MAX_LANGUAGES} language labels")
                totals[row.kind] = np.zeros(1 << BUCKET_BITS)
            totals[row.kind][row.bucket] = row.n
        languages = tuple(sorted(totals))
        table = np.array([totals[x] for x in languages]).reshape(len(languages), 1 << BUCKET_BITS)
        share = (table + smoothing) / (table + smoothing).sum(axis=1, keepdims=True)
        return cls(languages, np.ascontiguousarray(np.log(share).T.astype(np.float32)))

    def proportions(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Language proportions of each text; rows without letters are 0."""
        grams, first, words = _grams(data, ends)
        out = np.zeros((len(ends) - 1, len(self.languages)))
        full = np.flatnonzero(words[1:] > words[:-1])
        if not len(full) or not self.languages:
            return out
        scores = np.add.reduceat(self.log_probability[grams], first[:-1], axis=0)
        likely = np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), -60))
        bounds = words[np.append(full, full[-1] + 1)]
        bounds[:-1] = words[full]
        number = np.diff(bounds)

        def improve(share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
            for _ in range(rounds):
                joint = likely * np.repeat(share, number, axis=0)
                joint /= joint.sum(axis=1, keepdims=True)
                share = (sum_by(joint, bounds) / number[:, None]).astype(np.float32)
            mass = (likely * np.repeat(share, number, axis=0)).sum(axis=1, dtype=np.float64)
            return share, sum_by(np.log(np.maximum(mass, 1e-300)), bounds)

        even = np.full((len(full), len(self.languages)), 1 / len(self.languages), np.float32)
        share, _ = improve(even, self.rounds)
        rank = np.argsort(np.argsort(-share, axis=1, kind="stable"), axis=1, kind="stable")
        best, best_value = np.zeros_like(share), np.full(len(full), -np.inf)
        for size in range(1, len(self.languages) + 1):
            charge = self.penalty * size * np.log(number + 1.0)
            # No word is likelier than 1, so a set of this size or a larger one is worth -charge at most.
            if (-charge <= best_value).all():
                break
            start = np.where(rank < size, np.maximum(share, 1e-6), 0)
            kept, value = improve(start / start.sum(axis=1, keepdims=True), self.set_rounds if size > 1 else 0)
            value -= charge
            better = value > best_value
            best[better], best_value[better] = kept[better], value[better]
        out[full] = best
        return out

    def transform(self, docs: DataFrame, *, text: str = "text", prediction: str = "lang_pred", score: str = "score") -> DataFrame:
        """All columns of ``docs`` and the predicted language with its proportion of the text.

        A column of ``docs`` that has the name of a result is replaced.
        """
        docs = docs.drop(prediction, score)
        place = docs.columns.index(text)
        has_letter = F.coalesce(F.col(text).cast("string").rlike(r"\p{L}"), F.lit(False))
        marked = docs.select(*docs.columns, has_letter.alias("__letter"))
        schema = T.StructType([*docs.schema.fields, T.StructField(prediction, T.StringType()), T.StructField(score, T.DoubleType())])
        names = np.array([*self.languages, UNDETERMINED], dtype=object)

        def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                parts = [self.proportions(data, ends) for _, _, data, ends in slices(batch.column(place))]
                share = np.concatenate([*parts, np.zeros((0, len(self.languages)))])
                letter = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
                value = share.max(axis=1) if self.languages else np.zeros(len(letter))
                known = letter & (value > 0)
                best = np.where(known, share.argmax(axis=1) if self.languages else 0, len(self.languages))
                columns = [*batch.columns[:-1], pa.array(names[best], pa.string()), pa.array(np.where(known, np.minimum(value, 1.0), 0.0).astype(float))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        return marked.mapInArrow(label, schema)


def accepted(prediction: Column, score: Column, least: float = 0.4) -> Column:
    """Whether a text has a language: some letters, and one language with at least ``least`` of it."""
    return (prediction != UNDETERMINED) & (score >= least)
