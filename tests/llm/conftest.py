import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, rep long, size long, key long, row long"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table of (doc_id, text) pairs, with columns whose names the operators use inside."""

    def of(pairs, source=None):
        rows = [(i, t, "en", source(k) if source else f"s{k % 3}", None, 7, 7, 7, 7, 7) for k, (i, t) in enumerate(pairs)]
        return spark.createDataFrame(rows, DOCS)

    return of


@pytest.fixture(scope="session")
def small(spark):
    """A slice of the smallest driver table, for comparisons with brute force."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return docs.where(F.col("doc_id") >= 0).cache()
