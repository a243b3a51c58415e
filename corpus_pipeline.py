"""A corpus pipeline: language ID, toxicity, near duplicates, packing.

Each stage takes what its predecessor kept.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm import language_id, ngram_join, packing, toxicity
from tallyspark.llm.common import cut_lineage, matching_rows, read_table
from tallyspark.llm.queries import CUT, tokenizer_path


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters of which one language has a large share.

    Null, empty and letterless texts have no language and go; repeated rows are judged alike; an empty
    table, or one without any label, keeps no row.
    """
    scored = language_id.LanguageMixture.fit(docs).transform(docs, prediction="__lang", score="__score")
    return scored.where(language_id.accepted(F.col("__lang"), F.col("__score"))).select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the cut.

    Null and empty texts score as texts without a match and stay; repeated rows are judged alike;
    without labels of both kinds only threats can be rejected.
    """
    grammar = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return grammar.transform(docs, score="__score").where(F.col("__score") < CUT).select(*docs.columns)


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the smallest id, rows without an id last.

    Rows are told apart by id and text, so an id may be null or repeat with other texts; of rows
    with both equal one stays.  Null and wordless texts are near copies of nothing.
    """
    key = F.struct(F.col("doc_id").isNull().alias("nameless"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("text"))
    keyed = docs.withColumn("__key", key)
    found = cut_lineage(ngram_join.jaccard_join(keyed.select("__key", "text"), doc_id="__key").select("__key", "kept"))
    left = matching_rows(keyed, found.where("not kept").select("__key").distinct(), "left_anti")
    repeated = found.where("kept").groupBy("__key").count().where("count > 1").select("__key")
    nth = F.row_number().over(Window.partitionBy("__key").orderBy(F.xxhash64(*docs.columns)))
    again = matching_rows(left, repeated, "left_semi").withColumn("__nth", nth).where("__nth = 1").drop("__nth")
    return matching_rows(left, repeated, "left_anti").unionByName(again).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' token pieces with their places in sequences.

    A null or empty text is one piece, its end mark; repeated rows are packed each; an empty table has no piece.
    """
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("toxicity", toxicity_stage),
    ("ngram_jaccard_join", duplicate_stage),
    ("best_fit_packing", packing_stage),
]

#: N-gram models, automata and tokenisation are not SQL: the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written before the next one starts."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut_lineage(docs)
    return docs
