"""Hard negatives: product quantisation with residual norms bounds every score, and exact scores complete each window.

Vectors become whole numbers, floor(256 x). A codebook for every SUB dimensions, fitted on a bounded sample, gives each
row one byte a subspace; the norm of what the codes leave over is stored with them. For an anchor, tables of its products
with all codewords are looked up and summed: that is the score, up to the anchor's norm times the row's residual norm.

Anchors and rows meet as a grid of anchor blocks and row chunks, each cell one task. A task scores the
likeliest rows and leaves out only those whose upper bound is under the k-th score found; whole-number scores of all
others decide. It gives back its best k for each anchor, and the best of those are the result: windows are complete, and the
codebooks decide only how much is scored exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfold.llm.common import cut
from tarnfold.llm.vectors import means

SCALE = 256
#: Dimensions of a subspace, codewords of its book, and rows that the books are fitted on, for each number of dimensions.
SUB, WORDS, SAMPLE = 2, 256, 4096
#: Rows and anchors of a task; at least SPREAD tasks if each has SPREAD_ROWS rows.
CHUNK_ROWS, ANCHOR_ROWS, SPREAD, SPREAD_ROWS = 1 << 16, 1 << 15, 64, 4096
#: Anchors whose tables are held at a time.
TOGETHER = 32
#: Rows that are scored exactly for each one that is asked for, before the others are left out by their bounds.
PROBES = 4
#: Components beyond this could leave 64-bit scores; they are an error.
LARGEST = 1 << 25


def whole(rows: DataFrame) -> DataFrame:
    """id, label, dims, q (8-byte whole numbers) of the rows that take part: a label and a vector of finite components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(2).cast(pa.list_(pa.float64()))
            flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            missing = column.is_null().to_numpy(zero_copy_only=False)
            keep, qs = np.zeros(len(b), bool), []
            for i in range(len(b)):
                v = flat[offsets[i] : offsets[i + 1]]  # a null component is read as NaN
                if missing[i] or not len(v) or not np.isfinite(v).all():
                    continue
                if np.abs(v).max() * SCALE > LARGEST:
                    raise ValueError(f"a component is beyond {LARGEST // SCALE}: scores would not fit 64 bits")
                keep[i] = True
                qs.append(np.floor(SCALE * v).astype("<i8"))
            some = b.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array([len(q) for q in qs], pa.int32()), pa.array([q.tobytes() for q in qs], pa.binary())], ["id", "label", "dims", "q"])

    return rows.mapInArrow(run, "id long, label long, dims int, q binary")


def matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, dims)


def books_of(sample: np.ndarray, sub: int, words: int) -> list[np.ndarray]:
    """For each subspace its codewords, in whole numbers."""
    return [np.rint(means(sample[:, s : s + sub].astype(float), words)).astype(np.int64) for s in range(0, sample.shape[1], sub)]


def encode(q: np.ndarray, books: list[np.ndarray], sub: int) -> tuple[np.ndarray, np.ndarray]:
    """(a byte for each subspace, the residual's norm, not rounded down) of each row."""
    codes, left = np.empty((len(q), len(books)), np.uint8), np.zeros(len(q))
    for s, book in enumerate(books):
        x = q[:, s * sub : s * sub + sub]
        codes[:, s] = ((book**2).sum(1) - 2 * x @ book.T).argmin(1)
        left += ((x - book[codes[:, s]]) ** 2).sum(1)
    return codes, np.sqrt(left) * (1 + 1e-9)


def bounds(anchors: np.ndarray, codes: np.ndarray, residual: np.ndarray, books: list[np.ndarray], sub: int) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of the scores, one row an anchor: sums of looked-up products, less and more the residual's part."""
    about = np.zeros((len(codes), len(anchors)), np.int64)
    for s, book in enumerate(books):
        about += (book @ anchors[:, s * sub : s * sub + sub].T)[codes[:, s]]
    slack = np.ceil(residual[:, None] * (np.sqrt((anchors.astype(float) ** 2).sum(1)) * (1 + 1e-9))).astype(np.int64)
    return np.ascontiguousarray((about - slack).T), np.ascontiguousarray((about + slack).T)


def kth_largest(values: np.ndarray, k: int) -> int | None:
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else None


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first by score, highest first, then by id."""
    return np.lexsort((ids, -score))[:k]


def complete(lower: np.ndarray, upper: np.ndarray, low: int | None, high: int | None, k: int, exact: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Places of all rows that can be among the first k of those that score from low to high (None: without a bound).

    The likeliest PROBES * k by the middle of their bounds are scored by exact(places); a row whose upper bound is under
    the k-th of these scores inside the window has k rows before it.
    """
    may = np.ones(len(lower), bool)
    if low is not None:
        may &= upper >= low
    if high is not None:
        may &= lower <= high
    middle = lower + upper
    likely = np.flatnonzero(may if high is None else may & (middle <= 2 * high))
    if len(likely) > PROBES * k:
        likely = likely[np.argpartition(-middle[likely], PROBES * k)[: PROBES * k]]
    score = exact(likely)
    inside = np.ones(len(score), bool) if low is None and high is None else (score >= low) & (score <= high)
    least = kth_largest(score[inside], k)
    return np.flatnonzero(may if least is None else may & (upper >= least))


def windows(score: int, low: int, high: int) -> tuple[int, int]:
    """The scores n with low * score <= 100 * n <= high * score."""
    return -(-low * score // 100), high * score // 100


class Grid:
    """Rows and anchors, coded, and how they meet."""

    def __init__(self, rows: DataFrame, anchor: Column, sub: int, words: int, sample: int, chunk_rows: int, anchor_rows: int):
        self.sub, self.books = sub, {}
        for dims in [r["dims"] for r in rows.select("dims").distinct().collect()]:
            some = rows.where(F.col("dims") == dims).orderBy(F.xxhash64("q"), "row").limit(sample).select("q").collect()
            self.books[dims] = books_of(np.frombuffer(b"".join(bytes(r["q"]) for r in some), "<i8").reshape(-1, dims), sub, words)
        self.rows = cut(self.coded(rows))
        self.anchors = self.rows.where(anchor)
        n = self.rows.count()
        self.chunks = max(-(-n // chunk_rows), min(SPREAD, -(-n // SPREAD_ROWS)), 1)
        self.blocks = max(1, -(-self.anchors.count() // anchor_rows))

    def coded(self, rows: DataFrame) -> DataFrame:
        books, sub = self.books, self.sub

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                dims = b["dims"].to_numpy()
                for d in np.unique(dims):
                    mine = b.filter(pa.array(dims == d))
                    codes, residual = encode(matrix(mine["q"], d), books[d], sub)
                    yield pa.RecordBatch.from_arrays([*mine.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(residual)], [*mine.schema.names, "codes", "residual"])

        return rows.mapInArrow(run, "id long, label long, dims int, q binary, row long, codes binary, residual double")

    def meet(self, anchors: DataFrame, work: Callable[[dict, pa.Table, np.ndarray, np.ndarray, np.ndarray], list[tuple]], names: list[str]) -> DataFrame:
        """work(anchor, rows, their vectors, lower, upper) for each anchor and each chunk of rows; its rows, all whole numbers."""
        books, sub = self.books, self.sub
        left = anchors.select(*[F.col(c).alias(c) for c in anchors.columns])  # columns of their own: anchors are rows, too
        left = left.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(self.blocks))).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(self.chunks - 1)).cast("array<long>")))
        right = self.rows.withColumn("chunk", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(self.chunks))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(self.blocks - 1)).cast("array<long>")))

        def task(key: tuple, a: pa.Table, r: pa.Table) -> pa.Table:
            out: list[tuple] = []
            if a.num_rows and r.num_rows:
                dims = key[0].as_py()
                x, y = matrix(a["q"], dims), matrix(r["q"], dims)
                codes, residual = np.frombuffer(b"".join(r["codes"].to_pylist()), np.uint8).reshape(r.num_rows, -1), r["residual"].to_numpy()
                who, r = a.drop_columns(["q", "codes", "residual"]).to_pylist(), {c: r[c].to_numpy() for c in ("id", "label", "row")}
                for i in range(0, len(who), TOGETHER):
                    lower, upper = bounds(x[i : i + TOGETHER], codes, residual, books[dims], sub)
                    for k, one in enumerate(who[i : i + TOGETHER]):
                        out += work(one | {"q": x[i + k]}, r, y, lower[k], upper[k])
            return pa.table({n: pa.array([o[k] for o in out], pa.int64()) for k, n in enumerate(names)})

        by = ["dims", "block", "chunk"]
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(task, ", ".join(f"{n} long" for n in names))


def top(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first k of each group by score, then id, with rank from 1."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id", "row")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, anchor: Column | None = None, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
    sub: int = SUB, words: int = WORDS, sample: int = SAMPLE, chunk_rows: int = CHUNK_ROWS, anchor_rows: int = ANCHOR_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: vec_id, embedding, label. anchor: a condition on the column `id`; all rows where it is None. An anchor's positives are its first other
    rows of the same label; a pair's negatives the first rows of another label that score from low to high hundredths of
    the positive. Scores are inner products of floor(256 x); ties go to the smaller vec_id.

    Rows with a null vec_id, label or vector, an empty vector, or a null or non-finite component take no part; a component
    of more than 2 ** 17 is an error. Only vectors of one length are compared. Rows that share a vec_id are rows of their
    own, each with its results. An empty table gives no rows. Other columns are not read.
    """
    named = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "embedding").where("id IS NOT NULL AND label IS NOT NULL")
    rows = cut(whole(named).withColumn("row", F.monotonically_increasing_id()))
    grid = Grid(rows, F.lit(True) if anchor is None else anchor, sub, words, sample, chunk_rows, anchor_rows)

    def same_label(a: dict, r: dict, q: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> list[tuple]:
        own = np.flatnonzero((r["label"] == a["label"]) & (r["row"] != a["row"]))
        own = own[complete(lower[own], upper[own], None, None, positives, lambda at: q[own[at]] @ a["q"])]
        score = q[own] @ a["q"]
        return [(a["row"], r["id"][own[i]], r["row"][own[i]], score[i]) for i in best(score, r["id"][own], positives)]

    def other_label(a: dict, r: dict, q: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> list[tuple]:
        other, out = np.flatnonzero(r["label"] != a["label"]), []
        lower, upper = lower[other], upper[other]
        for p in a["positives"]:
            least, most = windows(p["score"], low, high)
            if least > most:
                continue
            own = complete(lower, upper, least, most, negatives, lambda at: q[other[at]] @ a["q"])
            own, score = other[own], q[other[own]] @ a["q"]
            inside = (score >= least) & (score <= most)
            own, score = own[inside], score[inside]
            out += [(a["row"], p["row"], r["id"][own[i]], r["row"][own[i]], score[i]) for i in best(score, r["id"][own], negatives)]
        return out

    near = cut(top(grid.meet(grid.anchors, same_label, ["anchor", "id", "row", "score"]), ["anchor"], positives))
    lists = near.groupBy(F.col("anchor").alias("row")).agg(F.collect_list(F.struct("id", "row", "score")).alias("positives"))  # `positives` of them at most
    found = top(grid.meet(grid.anchors.join(lists, "row"), other_label, ["anchor", "positive", "id", "row", "score"]), ["anchor", "positive"], negatives)
    pairs = near.select("anchor", F.col("row").alias("positive"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    who = grid.anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    out = found.select("anchor", "positive", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return out.join(pairs, ["anchor", "positive"]).join(who, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
