"""The nearest points of many queries: exactly, as a grid of query blocks and point chunks, or by an inverted file.

Queries are rows like points. No number of them is collected, and the plan does not grow with them: each cell of the grid
is one task, which multiplies two matrices and gives back its best points a query. The inverted file deals points to the
list of their nearest centre, and a query meets only the lists of its nearest centres; scores are exact either way. The
centres are fitted on a bounded sample; every point is in a list. How many lists a query has to meet for a recall is
measured on queries that are answered exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfold.session import cut

#: Queries of a block, and points of a chunk.
BLOCK, CHUNK = 4096, 1 << 16
#: At least so many tasks, if each has SPREAD_ROWS points.
SPREAD, SPREAD_ROWS = 32, 4096
#: Points that centres are fitted on, lists at most, and queries that the lists to be met are measured on.
SAMPLE, LISTS, MEASURED = 1 << 14, 4096, 256


def vectors(column: pa.ChunkedArray | pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: places in the column, and unit vectors. Those that are null, empty, zero or not finite are left out."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.list_(pa.float64()))
    flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    sizes = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, np.diff(offsets))
    out = {}
    for n in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == n)
        x = flat[offsets[:-1][at, None] + np.arange(n)]
        top = np.abs(x).max(axis=1)
        good = np.isfinite(top) & (top > 0)
        x = x[good] / top[good, None]
        out[int(n)] = at[good], x / np.linalg.norm(x, axis=1, keepdims=True)
    return out


def best_pairs(q_ids: np.ndarray, q: dict, ids: np.ndarray, x: dict, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, score): of each query its k nearest points, equal scores (to nine places) by the point's id."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for n in q.keys() & x.keys():
        mine, left = q[n]
        there, right = ids[x[n][0]], x[n][1]
        for i in range(0, len(mine), 256):
            scores = np.round(left[i : i + 256] @ right.T, 9)
            for j, row in zip(mine[i : i + 256], scores, strict=True):
                near = np.flatnonzero(row >= least)
                if len(near) > k:  # before sorting: all that the k-th lets in
                    near = near[row[near] >= np.partition(row[near], len(near) - k)[len(near) - k]]
                first = near[np.lexsort((there[near], -row[near]))[:k]]
                out.append((np.full(len(first), q_ids[j]), there[first], row[first]))
    return tuple(np.concatenate([o[c] for o in out]) if out else np.empty(0, t) for c, t in enumerate((np.int64, np.int64, float)))  # type: ignore[return-value]


def meet(queries: DataFrame, points: DataFrame, by: list[str], key: str, k: int, least: float) -> DataFrame:
    """query_id, key, score of the k best for each query and value of by. queries: query_id, embedding; points: key, embedding."""

    def task(q: pa.Table, p: pa.Table) -> pa.Table:
        who, what, score = best_pairs(q["query_id"].to_numpy(), vectors(q["embedding"]), p[key].to_numpy(), vectors(p["embedding"]), k, least) if q.num_rows and p.num_rows else ([], [], [])
        return pa.table({"query_id": pa.array(who, pa.int64()), key: pa.array(what, pa.int64()), "score": pa.array(score, pa.float64())})

    return queries.groupBy(*by).cogroup(points.groupBy(*by)).applyInArrow(task, f"query_id long, {key} long, score double")


def top(found: DataFrame, key: str, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")


def own(df: DataFrame, **renamed: Column) -> DataFrame:
    """The named columns as new ones, so that a table can meet itself."""
    return df.select(*[c.alias(n) for n, c in renamed.items()])


def exact(points: DataFrame, queries: DataFrame, key: str, k: int, least: float, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """query_id, key, score: every query against every point. Queries are copied to each chunk, points to each block."""
    n = points.count()
    chunks, blocks = max(-(-n // chunk), min(SPREAD, -(-n // SPREAD_ROWS)), 1), max(1, -(-queries.count() // block))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)).cast("array<long>"))
    q = own(queries, query_id=F.col(key).cast("long"), embedding=F.col("embedding"), block=F.pmod(F.xxhash64(key), F.lit(blocks))).withColumn("chunk", every(chunks))
    p = own(points, **{key: F.col(key).cast("long"), "embedding": F.col("embedding"), "chunk": F.pmod(F.xxhash64(key, F.lit(1)), F.lit(chunks))}).withColumn("block", every(blocks))
    return top(meet(q, p, ["block", "chunk"], key, k, least), key, k)


@dataclass
class InvertedFile:
    """Points by list. centres: unit vectors by length; rows: key, embedding, list; chunks: parts of a list, for long ones."""

    key: str
    centres: dict[int, np.ndarray]
    rows: DataFrame
    chunks: dict[int, int]

    @classmethod
    def fit(cls, points: DataFrame, key: str, lists: int | None = None, sample: int = SAMPLE, chunk: int = CHUNK) -> InvertedFile:
        """lists: about the square root of the points where it is None. The index is a written table: all points with a
        vector are in it."""
        points = own(points, **{key: F.col(key).cast("long"), "embedding": F.col("embedding")})
        share = lists or min(LISTS, max(1, round(points.count() ** 0.5)))
        some = points.where("size(embedding) > 0").orderBy(F.xxhash64(key), key).limit(sample).select("embedding").collect()
        centres = {n: spherical(x, share) for n, (_, x) in vectors(pa.array([r["embedding"] for r in some], pa.list_(pa.float64()))).items() if len(x)}
        index = cls(key, centres, points, {})
        index.rows = cut(index.listed(points, key, 1))
        sizes = index.rows.groupBy("list").agg(F.count("*").alias("n")).collect()  # one row a list
        index.chunks = {r["list"]: -(-r["n"] // chunk) for r in sizes}
        return index

    def listed(self, rows: DataFrame, key: str, probes: int) -> DataFrame:
        """key, embedding and list, for the `probes` nearest lists, with rank from 0. Lengths that the sample lacks have a list of their own."""
        centres, starts, total = self.centres, {}, 0
        for n in sorted(centres):
            starts[n] = total
            total += len(centres[n])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for n, (at, x) in vectors(b["embedding"]).items():
                    if n in centres:
                        near = np.argsort(-(x @ centres[n].T), axis=1, kind="stable")[:, :probes]
                    else:
                        near = np.full((len(at), 1), -n)
                    rank = np.tile(np.arange(near.shape[1]), len(at))
                    take = pa.array(np.repeat(at, near.shape[1]))
                    lists = near.ravel() + starts.get(n, 0)
                    yield pa.RecordBatch.from_arrays([b[key].take(take), b["embedding"].take(take), pa.array(lists.astype(np.int64)), pa.array(rank.astype(np.int32))], [key, "embedding", "list", "rank"])

        kind = dict(rows.dtypes)["embedding"]
        return rows.select(key, "embedding").mapInArrow(run, f"{key} long, embedding {kind}, list long, rank int")

    def search(self, queries: DataFrame, k: int, least: float, probes: int) -> DataFrame:
        """query_id, key, score: of each query (key, embedding) the k nearest points in its `probes` nearest lists."""
        spark, q = queries.sparkSession, own(queries, query_id=F.col(self.key).cast("long"), embedding=F.col("embedding"))
        sizes = F.broadcast(spark.createDataFrame([(s, n) for s, n in self.chunks.items()], "list long, chunks int"))  # one row a list
        asked = self.listed(q, "query_id", probes).join(sizes, "list").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1).cast("array<long>")))
        held = self.rows.join(sizes, "list").select(self.key, "embedding", F.col("list").alias("list"), F.pmod(F.xxhash64(self.key), F.col("chunks")).alias("chunk"))
        return top(meet(asked.select("query_id", "embedding", "list", "chunk"), held, ["list", "chunk"], self.key, k, least), self.key, k)

    def probes_for(self, queries: DataFrame, k: int, least: float, recall: float = 0.95, measured: int = MEASURED) -> int:
        """The fewest lists in which the share `recall` of the true neighbours of some queries lies."""
        some = queries.orderBy(F.xxhash64(self.key), self.key).limit(measured)
        true = exact(self.rows, some, self.key, k, least).join(self.rows.select(self.key, "list"), self.key)
        order = self.listed(own(some, query_id=F.col(self.key).cast("long"), embedding=F.col("embedding")), "query_id", max([1, *(len(c) for c in self.centres.values())]))
        ranks = true.join(order.select("query_id", "list", "rank"), ["query_id", "list"]).groupBy("rank").agg(F.count("*").alias("n")).orderBy("rank").collect()
        total, seen = sum(r["n"] for r in ranks), 0
        for r in ranks:
            seen += r["n"]
            if seen >= recall * total:
                return r["rank"] + 1
        return 1


def spherical(points: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Up to k centres of unit vectors by k-means with cosines, from evenly spaced points."""
    centres = np.unique(points[:: max(1, len(points) // k)][:k], axis=0)
    for _ in range(rounds):
        near = (points @ centres.T).argmax(1)
        sums = np.array([points[near == c].sum(axis=0) for c in np.unique(near)])
        norm = np.linalg.norm(sums, axis=1)
        centres = sums[norm > 0] / norm[norm > 0, None] if (norm > 0).any() else centres
    return centres
