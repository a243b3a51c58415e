"""The pipeline's stages on the smallest tables, each against what its operator says."""

import corpus_pipeline
from tallyspark.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] < sizes[0]
    found = {r.doc_id: r.component_id for r in queries.op7_ngram_jaccard_join(spark, SF).collect()}
    kept = [r.doc_id for r in docs.collect()]
    assert len({found[i] for i in kept}) == len(kept)
    packed = corpus_pipeline.packing_stage(spark, docs, SF)
    assert {r.doc_id for r in packed.collect()} == set(kept)


def test_odd_rows(spark, odd_docs, no_docs):
    columns = ["doc_id", "text", "lang", "__word", "__nth0"]
    docs = odd_docs.selectExpr("doc_id", "text", "lang", "1 as __word", "2 as __nth0")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
    # The row without an id is a copy of document 4.
    assert sorted(r.doc_id for r in docs.collect()) == [4, 6, 7]
    packed = corpus_pipeline.packing_stage(spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == {4, 6, 7} and all(0 < r.length <= 2048 for r in packed)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs.select("doc_id", "text", "lang"), SF).count() == 0


def test_duplicates_are_told_apart_by_id_and_text(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    rows = [(1, a, "en"), (1, b, "en"), (1, b, "fr"), (2, b + " tail", "en"), (None, "lone words of a row", "en"), (None, a + " tail", "en"), (None, None, "en"), (None, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = sorted((str(r.doc_id), str(r.text)) for r in corpus_pipeline.duplicate_stage(spark, docs, SF).collect())
    assert kept == sorted([("1", a), ("1", b), ("None", "lone words of a row"), ("None", ""), ("None", "None")])
