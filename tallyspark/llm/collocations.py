"""Collocations: phrases whose words go together more often than their parts do, by language.

Words are counted first.  Phrases are then counted in HAT-tries of word ids, in two passes: pairs of
frequent words, then windows of up to four words all of whose pairs are frequent, as no phrase is more
frequent than its parts.  What is frequent reaches the tasks as a bitmap of fixed size, which lets some
more phrases through and never loses one.  The tasks' sorted runs meet by first word and are merged there.

Word ids are 64-bit hashes of language and word, so no dictionary is sent to the tasks; if two frequent
words shared an id the job would stop.  Scores are whole numbers from decimal arithmetic.

Defined results: a null text is empty and a null language is ``und``; texts without words give nothing;
repeated rows count each; an empty table gives no row; other columns are not read.  A piece longer than a
slice is held whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import _FOLD, RollingHash, Sieve, bounded_slices, cut_lineage, mix64, passes, run_strings, segments
from tallyspark.llm.hat_trie import HatTrie

LEAST_COUNT, MOST_WORDS, TOP = 30, 4, 2000
#: A candidate inside a longer one of at least this many hundredths of its number is dropped.
ABSORBED = 80
NO_LANGUAGE = "und"
#: Words with more than one part in this many of all are hot.
HOT_SHARE = 1000
SLICE = 4_000_000

_STOP = np.zeros(256, bool)
_STOP[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_STOP
_WORD[[0x20, 0x09]] = False
_IDS = [f"w{k + 1}" for k in range(MOST_WORDS)]


def _language_seed(name: str) -> np.uint64:
    return np.frombuffer(hashlib.blake2b(name.encode(), digest_size=8).digest(), np.uint64)[0]


def word_ids(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Ids of words in their languages; 0 means no word."""
    return np.maximum(mix64(RollingHash(data).of(starts, stops) ^ seeds), np.uint64(1))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(languages of the batch, language of each word, folded bytes, starts, lengths, whether the next word follows in the piece)."""
    for batch in batches:
        names = pc.dictionary_encode(batch.column(0))
        of_row = names.indices.to_numpy()
        for rows, data, ends in bounded_slices(batch.column(1), _STOP, SLICE):
            data = _FOLD[data]
            starts, lengths, first = segments(_WORD[data], ends)
            if not len(starts):
                continue
            row = np.repeat(np.arange(len(ends) - 1), np.diff(first))
            stops_before = np.zeros(len(data) + 1, np.int32)
            np.cumsum(_STOP[data], out=stops_before[1:])
            follows = (stops_before[starts[1:]] == stops_before[starts[:-1]]) & (row[1:] == row[:-1])
            yield names.dictionary.to_pylist(), of_row[rows][row], data, starts, lengths, np.append(follows, False)


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of all words of ``docs(lang, text)``; a null word stands for all words of its language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, kind, data, starts, lengths, _ in _slices(batches):
            for k in np.unique(kind):
                own = kind == k
                found = pc.value_counts(run_strings(data, starts[own], lengths[own]))
                words = pa.concat_arrays([found.field(0).cast(pa.string()), pa.nulls(1, pa.string())])
                numbers = pa.concat_arrays([found.field(1), pa.array([int(own.sum())])])
                yield pa.RecordBatch.from_arrays([pa.array([names[k]] * len(words)), words, numbers], names=["lang", "word", "n"])

    return docs.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def with_ids(words: DataFrame) -> DataFrame:
    """``words(lang, word, n)`` with their ids; the job stops if two words share one."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(1).cast(pa.large_string())
            raw = [w.encode() for w in words.to_pylist()]
            ends = np.cumsum([0, *map(len, raw)])
            seeds = np.array([_language_seed(x) for x in batch.column(0).to_pylist()], np.uint64)
            ids = word_ids(np.frombuffer(b"".join(raw), np.uint8), ends[:-1], ends[1:], seeds)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids.view(np.int64))], names=["lang", "word", "n", "id"])

    named = words.mapInArrow(name, "lang string, word string, n long, id long")
    once = named.groupBy("id").agg(F.min("lang").alias("lang"), F.min("word").alias("word"), F.min("n").alias("n"), F.count("*").alias("same"))
    return once.withColumn("word", F.when(F.col("same") > 1, F.raise_error(F.lit("two words share an id"))).otherwise(F.col("word"))).drop("same")


def _subtrees(rows: np.ndarray, n: np.ndarray, hot: np.ndarray) -> pa.RecordBatch:
    """Sorted rows as one row for each first word: its part, the other words of all its phrases, and their numbers."""
    part = np.where(np.isin(rows[:, 0], hot), rows[:, 1] >> np.uint64(60), np.uint64(0)).astype(np.int32)
    first = np.flatnonzero(np.append(True, (rows[1:, 0] != rows[:-1, 0]) | (part[1:] != part[:-1])))
    ends = np.append(first, len(rows)).astype(np.int32)
    rest = np.ascontiguousarray(rows[:, 1:]).ravel().view(np.int64)
    lists = [pa.ListArray.from_arrays(pa.array(ends * (rows.shape[1] - 1)), pa.array(rest)), pa.ListArray.from_arrays(pa.array(ends), pa.array(n))]
    return pa.RecordBatch.from_arrays([pa.array(rows[first, 0].view(np.int64)), pa.array(part[first]), *lists], names=["w1", "part", "rest", "n"])


def phrase_counts(docs: DataFrame, frequent: Sieve, known: int, width: int, hot: np.ndarray, least: int = LEAST_COUNT, **limits: int) -> DataFrame:
    """(w1..w4, a) of the phrases of more than ``known`` and up to ``width`` words with at least ``least`` occurrences.

    ``frequent`` holds the frequent phrases of ``known`` words; no phrase is counted that has another one in it.
    Tasks send whole subtrees by first word, those of ``hot`` words in parts by the second one; the runs that
    meet in a prefix partition are merged in a trie again.
    """
    held = frequent.held

    def windows(ids: np.ndarray, follows: np.ndarray) -> np.ndarray:
        padded = np.append(ids, np.zeros(width, np.uint64))
        n = len(ids)
        part = np.column_stack([padded[k : k + n] for k in range(known)])
        whole = follows.copy() if known > 1 else np.ones(n, bool)
        whole[whole] = passes(held.value, part[whole])
        # Whether a phrase of known + 1 words begins here, all of whose parts are frequent.
        on = follows & np.append(whole[1:], False) & whole
        columns, goes = [*part.T], on
        for k in range(known, width):
            columns.append(np.where(goes, padded[k : k + n], 0))
            goes = goes & np.append(on[k - known + 1 :], np.zeros(min(n, k - known + 1), bool))
        return np.column_stack(columns)[on]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = HatTrie(width, **limits)
        for names, kind, data, starts, lengths, follows in _slices(batches):
            seeds = np.array([_language_seed(x) for x in names], np.uint64)
            trie.add(windows(word_ids(data, starts, starts + lengths, seeds[kind]), follows))
        for rows, n in trie.merged():
            for size in range(known + 1, width + 1):
                some = np.flatnonzero(rows[:, size - 1])
                if not len(some):
                    continue
                own, m = rows[some], n[some]
                own[:, size:] = 0
                first = np.flatnonzero(np.append(True, (own[1:] != own[:-1]).any(axis=1)))
                yield _subtrees(own[first], np.add.reduceat(m, first), hot)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = HatTrie(width, **limits)
        for batch in batches:
            for lo in range(0, len(batch), 1000):
                part = batch.slice(lo, 1000)
                n = part.column(3).flatten().to_numpy()
                first = np.repeat(part.column(0).to_numpy(), pc.list_value_length(part.column(3)).to_numpy())
                rest = part.column(2).flatten().to_numpy().reshape(len(n), width - 1)
                trie.add(np.column_stack((first, rest)).view(np.uint64), n)
        for rows, n in trie.merged():
            own = n >= least
            columns = [rows[own, k].view(np.int64) if k < width else np.zeros(int(own.sum()), np.int64) for k in range(MOST_WORDS)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(n[own])], names=[*_IDS, "a"])

    sent = docs.mapInArrow(count, "w1 long, part int, rest array<long>, n array<long>").repartition("w1", "part")
    return sent.mapInArrow(merge, ", ".join(f"{w} long" for w in _IDS) + ", a long")


def _part(*ids: str) -> list[Column]:
    return [F.col(i) for i in ids] + [F.lit(0).cast("long")] * (MOST_WORDS - 1 - len(ids))


def best_cuts(candidates: DataFrame, parts: DataFrame) -> DataFrame:
    """Candidates with l, r and score of their lowest-scoring cut; ``parts(p1, p2, p3, f)`` has all shorter phrases."""
    cuts = [F.when(F.col(_IDS[k]) != 0, F.struct(F.lit(k).alias("k"), F.array(*_part(*_IDS[:k])).alias("head"), F.array(*_part(*_IDS[k:])).alias("tail"))) for k in range(1, MOST_WORDS)]
    cut = candidates.select(*_IDS, "a", F.explode(F.array_compact(F.array(*cuts))).alias("c")).select(*_IDS, "a", "c.*")
    for side, name in (("head", "l"), ("tail", "r")):
        keys = {f"p{k + 1}": F.col(side)[k] for k in range(MOST_WORDS - 1)}
        cut = cut.withColumns(keys).join(parts.withColumnRenamed("f", name), list(keys)).drop(*keys, side)
    score = F.expr("cast(a as decimal(20, 0)) * 2000000 div (cast(l as decimal(20, 0)) + r)")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c")
    return cut.groupBy(*_IDS, "a").agg(lowest).select(*_IDS, "a", "c.l", "c.r", "c.score")


def absorbed(candidates: DataFrame) -> DataFrame:
    """(p1, p2, p3, longer): the number of the most frequent longer candidate that has the phrase in it."""
    parts = []
    for size in range(2, MOST_WORDS):
        for k in range(MOST_WORDS - size + 1):
            inside = F.struct(*(c.alias(f"p{j + 1}") for j, c in enumerate(_part(*_IDS[k : k + size]))))
            parts.append(F.when(F.col(_IDS[max(k + size, size + 1) - 1]) != 0, inside))
    found = candidates.where(F.col(_IDS[2]) != 0).select("a", F.explode(F.array_compact(F.array(*parts))).alias("p"))
    return found.groupBy("p.p1", "p.p2", "p.p3").agg(F.max("a").alias("longer"))


def collocations(docs: DataFrame, *, lang: str = "lang", text: str = "text", least: int = LEAST_COUNT, top: int = TOP, **limits: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the ``top`` phrases of each language."""
    docs = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    counted = cut_lineage(word_counts(docs).where((F.col("n") >= least) | F.col("word").isNull()))
    totals = counted.where("word is null").select("lang", F.col("n").alias("total"))
    words = cut_lineage(with_ids(counted.where((F.col("n") >= least) & F.col("word").isNotNull())))
    total = totals.agg(F.sum("total")).first()[0] or 0
    # Fewer words than this can have so large a share of all.
    hot = np.array([r.id for r in words.where(F.col("n") > total / HOT_SHARE).select("id").collect()], np.int64).view(np.uint64)
    pairs = cut_lineage(phrase_counts(docs, Sieve(words.select("id")), 1, 2, hot, least, **limits))
    longer = cut_lineage(phrase_counts(docs, Sieve(pairs.select("w1", "w2")), 2, MOST_WORDS, hot, least, **limits))
    candidates = pairs.unionByName(longer)
    zero = F.lit(0).cast("long")
    single = words.select(F.col("id").alias("p1"), zero.alias("p2"), zero.alias("p3"), F.col("n").alias("f"))
    parts = single.unionByName(candidates.where("w4 = 0").select(F.col("w1").alias("p1"), F.col("w2").alias("p2"), F.col("w3").alias("p3"), F.col("a").alias("f")))
    scored = best_cuts(candidates, parts).withColumns({"p1": F.col("w1"), "p2": F.col("w2"), "p3": F.when(F.col("w4") == 0, F.col("w3")).otherwise(F.lit(-1))})
    alone = F.col("longer").isNull() | (100 * F.col("longer") < ABSORBED * F.col("a"))
    kept = scored.join(absorbed(candidates), ["p1", "p2", "p3"], "left").where(alone).drop("p1", "p2", "p3", "longer")
    kept = cut_lineage(kept)
    named = kept.select(*_IDS, F.posexplode(F.array(*_IDS)).alias("place", "id")).where("id <> 0").join(words.select("id", "lang", "word"), "id")
    phrase = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda w: w["word"]), " ").alias("phrase")
    named = named.groupBy(*_IDS).agg(F.min("lang").alias("lang"), phrase)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = kept.join(named, _IDS).drop(*_IDS).withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
