"""Stages over a table whose further columns have the names that stages, or the library, use inside."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

DIR = "/root/testdata/sf0.001"
NAMES = ["_gone", "_copied", "_counts", "_key", "_KEY_", "_part", "_m", "_row", "row", "hash", "slot_", "a.b", "a`b", "x", "key", "n", "tie", "block", "chunk", "fp", "rep", "group", "_metadata", "_h", "quality", "best", "at"]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    """The smallest documents with these columns, each with a value that names its row, and copies of some rows."""
    at = str(tmp_path_factory.mktemp("clash") / "docs")
    plain = spark.read.parquet(f"{DIR}/documents.parquet")
    plain = plain.union(plain.where("doc_id % 10 = 0"))
    plain.select("*", *[F.concat(F.lit(f"{n} "), F.col("doc_id").cast("string")).alias(n) for n in NAMES]).write.parquet(at)
    return spark.read.parquet(at)


@pytest.mark.parametrize("k", range(5), ids=[n for n, _ in corpus_pipeline.STAGES])
def test_each_stage_keeps_all_columns(spark, docs, k):
    out = corpus_pipeline.STAGES[k][1](spark, docs, DIR)
    assert set(docs.columns) <= set(out.columns)
    rows = out.collect()
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert len(rows) > 50
    for r in rows:
        d = r.asDict()
        assert d["text"] == texts[d["doc_id"]] and all(d[n] == f"{n} {d['doc_id']}" for n in NAMES)


def test_stages_one_after_another(spark, docs, tmp_path):
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DIR).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    assert docs.count() > 50 and set(NAMES) <= set(docs.columns)
