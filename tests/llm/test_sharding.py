import zlib

from pyspark.sql import functions as F

from tarnfold.llm import sharding


def laws(out, texts, shards):
    """texts: (doc_id, text) of the input. Gapless slots, right sizes and digests, near equal bytes."""
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r)
    for k, rows in by.items():
        assert 0 <= k < shards and sorted(r.slot for r in rows) == list(range(len(rows)))
    enc = lambda t: (t or "").encode()
    key = lambda x: (x[0] is None, x)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in out), key=key) == sorted(((i, len(enc(t)) + 16, zlib.crc32(enc(t))) for i, t in texts), key=key)
    return {k: sum(r.size for r in by.get(k, [])) for k in range(shards)}


def test_near_equal_bytes(small):
    texts = [(r.doc_id, r.text) for r in small.collect()]
    out = sharding.shard(small, shards=7, part_bytes=4000).collect()
    sizes = laws(out, texts, 7)
    largest = max(r.size for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 2 * largest


def test_a_hot_group_is_divided(make):
    texts = [(i, "same text" if i % 2 else f"other {i}") for i in range(800)]
    sizes = laws(sharding.shard(make(texts), shards=10, part_bytes=3000).collect(), texts, 10)
    assert max(sizes.values()) - min(sizes.values()) <= 2 * 30


def test_edge_cases(make):
    texts = [(1, None), (1, None), (2, ""), (None, "x"), (None, "x"), (3, "long " * 100_000), (4, "é")]
    laws(sharding.shard(make(texts)).collect(), texts, 40)
    assert sharding.shard(make([])).count() == 0


def test_equal_texts_are_neighbours(make):
    texts = [(i, f"t{i % 20}") for i in range(400)]
    out = sorted(sharding.shard(make(texts), shards=4, part_bytes=4000).collect(), key=lambda r: (r.shard, r.slot))
    runs = 1 + sum(a.text_crc32 != b.text_crc32 for a, b in zip(out, out[1:], strict=False))
    assert runs == 20


def test_rounds_refine_to_single_keys(spark):
    rows = spark.range(10_000).selectExpr("id * id * id AS k", "1 + id % 5 AS size")
    s = sharding.split(rows, "k", "size", 9, probes=4, tolerance=0)
    got = [r.size for r in rows.collect()]
    assert [abs(b - sum(got) * i // 9) <= 5 for i, b in enumerate(s.bytes)] == [True] * 9
    k = sorted(i**3 for i in range(10_000))
    assert [sum(x < b for x in k) for b in s.bounds] == s.rows[1:]


def test_written_order(make, tmp_path, spark):
    make([(i, "abc") for i in range(300)]).repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    out = sharding.shard_in_order(docs, sharding.written_order(), 5, 200).collect()
    assert len(out) == 300 and {sum(r.shard == k for r in out) for k in range(5)} == {60}


def test_without_an_order_it_is_that_of_the_keys(make):
    out = sharding.shard_in_order(make([(i, f"t{i}") for i in range(100)] + [(None, None)]), None, 5, 200)
    rows = out.collect()
    assert len(rows) == 101 and out.columns.count("size") == 1
    assert all(sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows))) for k in range(5))


def test_against_brute_force(small):
    """Bounds at the keys nearest to the byte targets, slots by sorting all rows on the driver."""
    keyed = small.withColumn("k", sharding.group_key(small.text, small.doc_id)).withColumn("n", sharding.size_of(small.text))
    rows = sorted(keyed.select("k", "doc_id", "n").collect())
    total, at, starts = sum(r.n for r in rows), 0, []
    for r in rows:
        starts.append(at)
        at += r.n
    bounds = [min(range(len(rows) + 1), key=lambda i: (abs((starts[i] if i < len(rows) else at) - total * s // 7), i)) for s in range(1, 7)]
    want, shard = {}, 0
    for i, r in enumerate(rows):
        while shard < 6 and i >= bounds[shard]:
            shard += 1
        want[r.doc_id] = shard, i - (bounds[shard - 1] if shard else 0)
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.shard(small, shards=7, tolerance=0).collect()}
    assert got == want


def test_a_binary_search_counts_bounds(spark):
    for n in (0, 1, 2, 3, 7, 8, 9, 100):
        values = [3 * i for i in range(n)]
        for r in spark.range(-2, 3 * n + 3).select("id", sharding.at_or_below(values, F.col("id")).alias("n")).collect():
            assert r.n == sum(v <= r.id for v in values)


def test_parts_follow_bytes_in_one_exchange(make):
    assert sharding.parts_of(40, 0, 100) == 1 and sharding.parts_of(40, 4001, 100) == 2
    out = sharding.shard_in_order(make([(i, f"t{i}") for i in range(50)]), None, 5)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1, plan
