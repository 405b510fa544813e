"""Near-duplicate groups: SimHash fingerprints linked by covering locality-sensitive hashing.

Each of the 64 bit positions gets a non-zero code of ``radius + 1`` bits. For every non-zero vector v of
``radius + 1`` bits, one table keeps the positions whose code has an odd inner product with v. Any ``radius``
positions have a common v that is orthogonal to their codes, so two fingerprints that differ in ``radius``
bits or fewer agree on all kept bits of some table: no pair is lost.

Equal fingerprints are merged before any table is built, so copies cost nothing there. A bucket of more than
``bucket_size`` different fingerprints is divided by a covering of the bits that its table left free; as each
level fixes about half of them, the third holds at most 2**8 fingerprints a bucket, whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfold.llm.common import cut, fresh, row_of, small, text_key, without

RADIUS = 3
SHINGLE = 3
BLOCK = 1 << 16


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """SimHash of the shingles' XXH64, as a signed 64-bit number; 0 where there is no word."""
    words = (text or b"").lower().split()  # bytes: only A-Z change, and only ASCII white space divides
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else iter([b" ".join(words)])
    total, ones = max(1, len(words) - width + 1), np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for start in range(0, total, BLOCK):
        n = min(BLOCK, total - start)
        h = np.fromiter((digest(next(shingles), 42) for _ in range(n)), np.uint64, n)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * ones > total).astype(np.uint8), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, key: Column | None = None) -> DataFrame:
    """key (doc_id where it is None) and fp of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array([fingerprint(t.as_py()) for t in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fp], [b.schema.names[0], "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id") if key is None else key.alias("key"), F.col("text").cast("binary").alias("_text"))
    (name, kind), _ = rows.dtypes
    return rows.mapInArrow(run, f"{name} {kind}, fp long")


def masks(free: int = (1 << 64) - 1, radius: int = RADIUS) -> list[int]:
    """Covering masks over the bits that are set in free."""
    codes = (1 << (radius + 1)) - 1
    places = [i for i in range(64) if free >> i & 1]
    return [sum(1 << p for k, p in enumerate(places) if (k % codes + 1 & v).bit_count() % 2) for v in range(1, codes + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def linked(fps: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each fingerprint of a bucket, the place of the first one that it is connected to within the bucket."""
    n = len(fps)
    label = np.full(n, -1)
    for i in range(n):
        if label[i] >= 0:
            continue
        label[i], front = i, [i]
        while front:
            open_ = np.flatnonzero(label < 0)
            if not len(open_):
                return label
            near = open_[np.bitwise_count(fps[open_] ^ fps[front.pop()]) <= radius]
            label[near] = i
            front += near.tolist()
    return label


def bucket_links(radius: int):
    @F.pandas_udf("array<struct<a:long,b:long>>")
    def links(buckets: pd.Series) -> pd.Series:
        out = []
        for bucket in buckets:
            rep = np.array([x["rep"] for x in bucket], np.int64)
            label = linked(np.array([x["fp"] for x in bucket], np.int64).view(np.uint64), radius)
            out.append([{"a": int(rep[i]), "b": int(rep[k])} for i, k in enumerate(label) if i != k])
        return pd.Series(out)

    return links


def near_links(nodes: DataFrame, radius: int = RADIUS, bucket_size: int = 512) -> DataFrame:
    """(a, b): links between the reps of different fingerprints that connect all that lie within the radius."""
    spark, full, levels = nodes.sparkSession, (1 << 64) - 1, 3
    per = (1 << (radius + 1)) - 1
    first = masks(full, radius)
    todo = nodes.select(
        "fp", "rep", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(first)])).alias("x")
    ).select("fp", "rep", "x.t", "x.key")
    kept, out = first, None
    for level in range(levels):
        last = level == levels - 1
        sizes = todo.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
        live = cut(todo.join(sizes, ["t", "key"]))
        links = (
            (live if last else live.where(F.col("n") <= bucket_size))
            .groupBy("t", "key")
            .agg(F.collect_list(F.struct("fp", "rep")).alias("bucket"))
            .select(F.explode(bucket_links(radius)("bucket")).alias("x"))
            .select("x.a", "x.b")
        )
        out = links if out is None else out.union(links)
        hot = live.where(F.col("n") > bucket_size)
        if last or hot.isEmpty():
            break
        # Bucket (t, key) goes on with masks over the bits that table t left free; its own bits stay part of the key.
        deeper = [[k | m for m in masks(full & ~k, radius)] for k in kept]
        table = spark.createDataFrame([(t, t * per + i, signed(m)) for t, ms in enumerate(deeper) for i, m in enumerate(ms)], "t int, t2 int, m long")
        todo = hot.select("fp", "rep", "t").join(F.broadcast(table), "t").select("fp", "rep", F.col("t2").alias("t"), F.col("fp").bitwiseAND(F.col("m")).alias("key"))
        kept = [m for ms in deeper for m in ms]
    return cut(out.distinct())


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(v, label): the smallest vertex that v is connected to, by alternating large and small stars."""
    edges = links.where("a <> b").select("a", "b")
    before = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select("v", "m").where("v <> m").distinct()
        down = large.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("x"))
        edges = cut(small.select("x.a", "x.b").where("a <> b").distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.countDistinct("a")).first())
        if not now[0] or now == before and now[0] == now[2]:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("v"), F.col("b").alias("label"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, bucket_size: int = 512) -> DataFrame:
    """doc_id, fingerprint, component_id of every row.

    A null or empty text and one without words have fingerprint zero, linked like any other. Rows with the same
    doc_id are one vertex: what either is linked to is one component. Null doc_ids stay rows of their own, with
    a null component_id unless a row with a doc_id has a linked fingerprint. A text of any length is read whole, in
    bounded pieces. An empty table gives no rows. Other columns are not read.
    """
    fps = cut(fingerprints(docs))
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep is not null"))
    links = near_links(nodes, radius, bucket_size)
    # A doc_id with several texts joins their fingerprints.
    same = fps.where("doc_id is not null").distinct().groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    repeated = fps.join(same, "doc_id").join(nodes, "fp").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b").distinct()
    label = components(links.union(repeated))
    of_fp = nodes.join(label, nodes.rep == label.v, "left").select("fp", F.coalesce("label", "rep").alias("component_id"))
    return fps.join(of_fp, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def row_key(docs: DataFrame) -> Column:
    """What tells rows apart: doc_id and text. Rows that share both are copies of one row."""
    return F.struct(docs["doc_id"].cast("long").alias("doc_id"), text_key(docs["text"]).alias("text"))


def keep_one(docs: DataFrame, radius: int = RADIUS, bucket_size: int = 512) -> DataFrame:
    """One row of each group of near copies: that of the smallest doc_id, a null one last, then by the text's hash.

    Groups are linked fingerprints alone, so different texts that share a doc_id, or have none, are in different
    groups and stay. Of rows that share doc_id and text one is kept. Texts cross an exchange only if more than
    BROADCAST_ROWS different rows go, or for the copies of a row that is kept. A text of any length is read whole. An
    empty table gives no rows. docs may have further columns of any names, which stay as they are.
    """
    fps = cut(fingerprints(docs, row_key(docs)))
    nodes = cut(fps.groupBy("fp").agg(F.count("*").alias("n")).withColumn("rep", F.col("fp")))
    label = components(near_links(nodes, radius, bucket_size))
    of_fp = nodes.join(label, nodes.rep == label.v, "left").select("fp", F.coalesce("label", "rep").alias("group"))
    rows = cut(fps.groupBy("fp", "key").agg(F.count("*").alias("n")).join(of_fp, "fp"))
    order = F.struct(F.col("key.doc_id").isNull(), "key")
    best = rows.groupBy("group").agg(F.min_by("key", order).alias("best"), F.min_by("n", order).alias("n"))
    gone = rows.join(best.select("group", "best"), "group").where("key <> best").select("key")
    left = without(docs, gone, row_key(docs))
    mark = fresh(docs, "_copied")
    copied = cut(best.where("n > 1").select(F.col("best").alias(mark)))
    n = copied.count()
    if not n:
        return left
    key = row_key(docs)
    met = key == F.col(mark)
    once = left.join(small(copied, n), met, "left_semi").groupBy(key.alias("key")).agg(F.first(row_of(docs)).alias("row")).select("row.*")
    return left.join(small(copied, n), met, "left_anti").union(once)
