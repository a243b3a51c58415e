import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").persist()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, blanks, a repeated row, a long text and columns that clash with results."""
    rows = [(1, None, None, 9.0), (2, "", "en", 9.0), (3, " \n\t ", None, 9.0), (4, "the and of the", "en", 9.0), (4, "the and of the", "en", 9.0), (None, "the and of the", "en", 9.0), (5, "12 34 !!", "fr", 9.0), (6, "le la les et " * 40_000, "fr", 9.0), (7, "▁x  <|endoftext|> 日本 ", "fr", 9.0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    return frame.withColumn("ids", F.lit("mine"))


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
