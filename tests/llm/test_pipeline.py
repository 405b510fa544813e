"""The pipeline against what its stages should do, recomputed by brute force from their inputs."""

import corpus_pipeline
from tarnfold.llm import quality

from .test_decontam import brute as leaks
from .test_quality import brute as counts
from .test_simhash import brute_components, brute_fingerprint

DIR = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DIR)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.columns == columns or k == 4
        kept.append({r.doc_id: r.text for r in docs.collect()})
        assert docs.count() == len(kept[-1])
    before = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    base = {i for i, t in before.items() if (c := counts(t))[0] >= 10 and 100 * c[4] <= 20 * c[0]}
    assert set(kept[0]) <= base
    judged = quality.judge(spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")).where("kept").collect()
    assert set(kept[0]) == {r.doc_id for r in judged}
    ids = sorted(kept[0])
    comp = brute_components(ids, [brute_fingerprint(kept[0][i]) for i in ids])
    assert set(kept[1]) == set(comp.values())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    assert set(kept[2]) == {r[0] for r in leaks(list(kept[1].items()), items) if not r[5]}
    assert kept[3] == kept[2] and kept[4] == kept[3]
    by = {}
    for r in docs.collect():
        by.setdefault(r.shard, []).append(r)
    assert all(sorted(r.slot for r in rows) == list(range(len(rows))) for rows in by.values())


def test_rows_with_null_and_repeated_ids(spark, tmp_path):
    """A table in which a bad row shares its id with good ones, and rows without ids: each goes or stays by its own text."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") % 3 > 0, F.floor(F.col("doc_id") / 9))).withColumn("mine", F.monotonically_increasing_id())
    docs.write.parquet(str(tmp_path / "in"))
    docs = spark.read.parquet(str(tmp_path / "in"))
    rows = {r.mine: r for r in docs.collect()}
    assert len(rows) == 200
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DIR).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        got = docs.collect()
        assert all(rows[r.mine].text == r.text and rows[r.mine].doc_id == r.doc_id for r in got) and len({r.mine for r in got}) == len(got)
        kept.append({r.mine for r in got})
    good = {i for i, r in rows.items() if (c := counts(r.text))[0] >= 10 and 100 * c[4] <= 20 * c[0]}
    assert kept[0] <= good and len(kept[0]) > 0.5 * len(good)
    comp = brute_components(sorted(kept[0]), [brute_fingerprint(rows[i].text) for i in sorted(kept[0])])
    groups = {}
    for i, c in comp.items():
        groups.setdefault(c, set()).add(i)
    assert all(len(g & kept[1]) == 1 for g in groups.values()) and len(kept[1]) == len(groups)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    assert kept[2] == {r[0] for r in leaks([(i, rows[i].text) for i in kept[1]], items) if not r[5]}
    assert kept[3] == kept[2] and kept[4] == kept[3]


def test_run(spark):
    out = corpus_pipeline.run(spark, DIR)
    assert out.count() > 0 and {"doc_id", "text", "shard", "slot"} <= set(out.columns)
