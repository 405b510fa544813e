import os
import random

import pytest
from pyspark.sql import functions as F

from tarnfold.sources.buckets import BucketedTable, Conflict
from tarnfold.sources.files import RecordNotFound


def content(table, version=None):
    return {r.id: (r.path, r.n) for r in table.read(version).collect()}


def test_upserts_and_deletes_against_a_dict(spark, tmp_path):
    """Keys that move to another path, several new rows of one key, deletes by key and by path; old versions stay readable."""
    rng, t = random.Random(2), BucketedTable(spark, str(tmp_path / "t"), "id", "path", 8)
    with pytest.raises(RecordNotFound):
        t.read()
    make = lambda rows: spark.createDataFrame(rows, "id string, path string, n int")
    t.write(make([]))
    want, old = {}, {}
    for step in range(5):
        rows = [(f"k{rng.randrange(60)}", f"p{rng.randrange(9)}", 100 * step + i) for i in range(20)]
        t.upsert(make(rows), "n")
        want |= {i: (p, n) for i, p, n in rows}
        assert content(t) == want
        if step % 2:
            t.delete(make([("k1", "", 0), ("k2", "", 0)]))
            t.delete(make([("", f"p{step}", 0)]), "path")
            want = {i: x for i, x in want.items() if i not in ("k1", "k2") and x[0] != f"p{step}"}
            assert content(t) == want
        old[t.versions()[-1]] = dict(want)
    assert all(content(t, v) == w for v, w in old.items())
    t.vacuum()
    assert len(t.versions()) == 2 and content(t) == want
    t.upsert(make([]))
    assert content(t) == want


def test_a_small_write_into_a_large_table(spark, tmp_path):
    """Ten keys among a million rows: no more than ten of 256 buckets get new files."""
    t = BucketedTable(spark, str(tmp_path / "t"))
    t.write(spark.range(1_000_000).select("id", F.col("id").alias("n")))
    first = t.manifest()
    t.upsert(spark.range(5, 1_000_000, 100_000).select("id", F.lit(-1).cast("long").alias("n")))
    now = t.manifest()
    changed = {b for b in now["buckets"] if now["buckets"][b] != first["buckets"][b]}
    assert 0 < len(changed) <= 10 and len(now["buckets"]) == 256
    assert {f"_bucket={b}" for b in changed} == {d for d in os.listdir(tmp_path / "t/data" / f"v{now['version']}") if d.startswith("_bucket")}
    got = t.read().agg(F.count("*"), F.count_if(F.col("n") == -1), F.countDistinct("id")).first()
    assert tuple(got) == (1_000_000, 10, 1_000_000)


def test_two_writers(spark, tmp_path):
    """Of two writers that began with one version, one fails, and nothing of it is seen; a writer that never ended holds nobody up."""
    a, b = (BucketedTable(spark, str(tmp_path / "t"), buckets=4) for _ in range(2))
    rows = lambda n: spark.range(n).withColumn("n", F.lit(n))
    a.write(rows(3))
    start = b.manifest()
    a.upsert(rows(2))
    with pytest.raises(Conflict):
        b.commit(start["version"], rows(1).schema, {}, b.bucket(rows(1)))
    assert a.read().count() == 3
    a.fs.create(a.at(f".claim-v{a.versions()[-1] + 1}"), False).close()
    a.upsert(rows(5))
    assert a.read().count() == 5 and b.read().where("n = 5").count() == 5
