"""Near-duplicate vectors: a pigeonhole join over subspaces.

Two unit vectors with cosine c are sqrt(2 - 2c) apart, so a threshold is a budget of squared distance. The unit vectors
are rotated and cut into `blocks` of their dimensions; if two are within the budget, then at least one block has no more
than its dimensions' share of it. Each block is joined by range on its own:

* Centres of the block's subspace, fitted on a bounded sample, divide it into cells. A vector is at home in the cell of
  its nearest centre, and a guest in every cell with a smaller number that lies within the range beyond the bisecting
  plane. So any two that are in range of each other meet once, where one is at home.
* Cells with many rows are cut into chunks, and each pair of chunks is a task of its own: no task holds more than two.
* A task finds the pairs within the block's budget, leaves those to another task that an earlier block finds too, and
  verifies the rest by their cosine. It gives back no pairs: a count for each vector, and a forest of its links.

Rotated vectors are rounded to whole numbers, with the rounding added to the budget. So what a pair's first block is does
not depend on the order of sums, and no pair is counted twice or lost. Equal vectors are one node with a weight.

Before that, large groups of near copies are taken out. All vectors within half the range of one of the sample are linked
with each other, so such a ball is counted and not compared, whatever its size. A vector outside of it is linked with
none of the ball or all of it, by its distance from the middle, or, in the narrow shell between, compared with its members.
The sample decides only how much is compared, never what is found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfold.llm.common import cut, small
from tarnfold.llm.simhash import components

THRESHOLD = 0.9
BLOCKS = 4
#: Vectors that centres are fitted on, for each number of dimensions.
SAMPLE = 4096
#: Vectors of the sample that may be the middle of a ball, and members from which on a ball is counted as a whole.
LEADERS, BALL_ROWS = 1024, 512
#: Rows for which a block gets one more cell, and the most cells it gets.
CELL_ROWS, CELLS = 8192, 1024
#: Rows of one side of a task, if they are of 64 dimensions; in proportion fewer if they have more.
CHUNK_ROWS = 32768
#: Rows and columns of what is compared at a time, and pairs that are verified at a time.
TILE, PAIRS = 1024, 1 << 14
#: Rotated unit vectors are rounded to whole numbers of this part.
SCALE = 32767


def packed(values: np.ndarray) -> bytes:
    """The components as 4-byte floats if that loses nothing, or as 8-byte ones."""
    with np.errstate(over="ignore"):
        low = values.astype("<f4")
    return (low if (low == values).all() else values.astype("<f8")).tobytes()


def rows_of(column: pa.Array) -> Iterator[np.ndarray | None]:
    """The vectors of a list column; None for those that are null, zero, or hold null or non-finite components."""
    column = column.cast(pa.list_(pa.float64()))
    flat = column.values.to_numpy(zero_copy_only=False)
    offsets, missing = column.offsets.to_numpy(), column.is_null().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        v = flat[offsets[i] : offsets[i + 1]]  # a null component is read as NaN
        yield None if missing[i] or not v.any() or not np.isfinite(v).all() else v


def unpacked(vectors: list[bytes], dims: int) -> np.ndarray:
    """Unit vectors, one a row."""
    short = np.fromiter(map(len, vectors), np.int64, len(vectors)) == 4 * dims
    out = np.empty((len(vectors), dims))
    out[short] = np.frombuffer(b"".join(v for v, s in zip(vectors, short, strict=True) if s), "<f4").reshape(-1, dims)
    out[~short] = np.frombuffer(b"".join(v for v, s in zip(vectors, short, strict=True) if not s), "<f8").reshape(-1, dims)
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.sqrt(np.einsum("ij,ij->i", out, out))[:, None]


@dataclass
class Space:
    """How vectors of one number of dimensions are rotated, cut into blocks and dealt to cells."""

    rotation: np.ndarray
    edges: list[int]
    budgets: list[float]
    centres: list[np.ndarray]

    @classmethod
    def fit(cls, dims: int, rows: int, sample: list[bytes], threshold: float, blocks: int, cell_rows: int, cells: int) -> Space:
        blocks = min(blocks, dims)
        edges = [dims * b // blocks for b in range(blocks + 1)]
        signs = np.random.default_rng(dims)
        self = cls(np.linalg.qr(signs.standard_normal((dims, dims)))[0], edges, [], [])
        points = self.rotated(unpacked(sample, dims)).astype(float)
        for b in range(blocks):
            own = edges[b + 1] - edges[b]
            exact = np.sqrt((2 - 2 * threshold) * own / dims) * SCALE
            self.budgets.append((exact * (1 + 1e-9) + np.sqrt(own)) ** 2)  # two roundings of a half in each dimension
            self.centres.append(means(points[:, edges[b] : edges[b + 1]], min(cells, -(-rows // cell_rows))))
        return self

    def rotated(self, units: np.ndarray) -> np.ndarray:
        return np.rint(units @ self.rotation * SCALE).astype("<i2")

    def places(self, rotated: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each block: (block, row, cell, guest) of every place that the rows take."""
        for b, centres in enumerate(self.centres):
            x = rotated[:, self.edges[b] : self.edges[b + 1]].astype(float)
            far = (x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)
            home = far.argmin(1)
            gaps = np.sqrt(((centres[:, None] - centres) ** 2).sum(2))
            beyond = far - far[np.arange(len(x)), home][:, None]  # twice the way to the plane, times the gap
            guest = beyond <= 2 * gaps[home] * np.sqrt(self.budgets[b]) * (1 + 1e-6) + 1
            guest &= np.arange(len(centres)) < home[:, None]
            row, cell = np.nonzero(guest)
            yield b, np.concatenate([np.arange(len(x)), row]), np.concatenate([home, cell]), np.arange(len(x) + len(row)) >= len(x)


def means(points: np.ndarray, k: int, rounds: int = 5) -> np.ndarray:
    """Up to k different centres of the points, by a few rounds of k-means from evenly spaced rows."""
    centres = np.unique(points[:: max(1, len(points) // k)][:k], axis=0)
    for _ in range(rounds):
        near = ((centres**2).sum(1) - 2 * points @ centres.T).argmin(1)
        centres = np.unique([points[near == c].mean(axis=0) for c in np.unique(near)], axis=0)
    return centres


class Forest:
    """Which rows of a task are connected; the smallest row of each tree is its root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.up[a], self.up[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))
            while (self.up[self.up] != self.up).any():
                self.up = self.up[self.up]


class Links:
    """Links of the rows of a task: how many each has, by weight, and which are connected."""

    def __init__(self, weight: np.ndarray):
        self.weight, self.n, self.forest = weight, np.zeros(len(weight), np.int64), Forest(len(weight))

    def add(self, p: np.ndarray, q: np.ndarray) -> None:
        for a, b in ((p, q), (q, p)):
            self.n += np.bincount(a, self.weight[b], len(self.n)).astype(np.int64)
        self.forest.join(p, q)

    def table(self, node: np.ndarray) -> pa.Table:
        some = self.n > 0
        return pa.table({"node": node[some], "n": self.n[some], "root": node[self.forest.up[some]]})


def near_pairs(left: np.ndarray, right: np.ndarray, first: int, within: bool, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows whose product of left and right is `least` or more, some at a time: the first `first` rows with those
    after them, and with each other if `within`."""
    for i in range(0, first, TILE):
        a = min(i + TILE, first)
        for j in range(i if within else first, len(left), TILE):
            near = left[i:a] @ right[j : j + TILE].T >= least
            if not near.any():
                continue
            p, q = np.nonzero(near)
            p, q = p + i, q + j
            if j < first:
                p, q = p[q > p], q[q > p]
            for k in range(0, len(p), PAIRS):
                yield p[k : k + PAIRS], q[k : k + PAIRS]


def linked(units: np.ndarray, p: np.ndarray, q: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that are linked, by their cosines."""
    good = np.einsum("ij,ij->i", units[p], units[q]) >= threshold
    return p[good], q[good]


def compare(space: Space, block: int, units: np.ndarray, rotated: np.ndarray, weight: np.ndarray, first: int, within: bool, threshold: float) -> Links:
    """Links of the pairs in range of each other in `block` that no earlier block finds."""
    out = Links(weight)
    lo, hi = space.edges[block], space.edges[block + 1]
    x = rotated[:, lo:hi].astype("f4") / SCALE
    limit, half = space.budgets[block] / SCALE**2, (x**2).sum(axis=1, keepdims=True) / 2
    one = np.ones_like(half)
    # left times right is half of what the squared distance falls short of the budget
    left, right = np.hstack([x, -half, one]), np.hstack([x, one, limit / 2 - half])
    for p, q in near_pairs(left, right, first, within, -1e-5):
        apart = (rotated[p].astype(float) - rotated[q]) ** 2  # whole numbers: sums are exact in any order
        for b in range(block + 1):
            inside = apart[:, space.edges[b] : space.edges[b + 1]].sum(axis=1) <= space.budgets[b]
            stay = inside if b == block else ~inside
            p, q, apart = p[stay], q[stay], apart[stay]
        out.add(*linked(units, p, q, threshold))
    return out


def keyed(rows: DataFrame) -> DataFrame:
    """vec_id, v (packed), dims of every row; v is null where a vector links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vs = list(rows_of(b.column(1)))
            v = pa.array([None if x is None else packed(x) for x in vs], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), v, pa.array([0 if x is None else len(x) for x in vs], pa.int32())], ["vec_id", "v", "dims"])

    return rows.mapInArrow(run, "vec_id long, v binary, dims int")


def tasks(chunks: DataFrame, placed: DataFrame) -> DataFrame:
    """placed with i, j and side of every task that a row is part of.

    A cell has h chunks of those at home and g of guests. Task (i, j) compares home chunk i with home chunk j, or with
    guest chunk j - h; task (i, i) is for home chunk i with itself and the first guest chunk.
    """
    rows = placed.join(chunks, ["dims", "block", "cell"]).withColumn("c", F.expr("pmod(xxhash64(node, block), IF(guest, g, h))"))
    one = "struct(CAST({} AS bigint) AS i, CAST({} AS bigint) AS j, {} AS side)"
    home = f"transform(sequence(0, h - 1), x -> {one.format('least(c, x)', 'greatest(c, x)', 'IF(c <= x, 0, 1)')})"
    guests = f"IF(g > 1, transform(sequence(1, g - 1), x -> {one.format('c', 'h + x', '0')}), array())"
    guest = f"transform(sequence(0, h - 1), x -> {one.format('x', 'IF(c = 0, x, h + c)', '1')})"
    return rows.withColumn("t", F.explode(F.expr(f"IF(guest, {guest}, concat({home}, {guests}))"))).select("*", "t.i", "t.j", "t.side").drop("t", "c", "h", "g")


def block_links(nodes: DataFrame, spaces: dict[int, Space], threshold: float, chunk_rows: int) -> DataFrame:
    """node, n, root of the links between nodes, by the joins of the blocks."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b["dims"].to_numpy()
            for d in np.unique(dims):
                mine = b.filter(pa.array(dims == d))
                rotated = spaces[d].rotated(unpacked(mine["v"].to_pylist(), int(d)))
                q = pa.array([r.tobytes() for r in rotated], pa.binary())
                for block, row, cell, guest in spaces[d].places(rotated):
                    for k in range(0, len(row), 4096):
                        at = pa.array(row[k : k + 4096])
                        own = [mine["node"].take(at), mine["weight"].take(at), mine["dims"].take(at), mine["v"].take(at), q.take(at)]
                        place_ = [pa.array(np.full(len(at), block, np.int32)), pa.array(cell[k : k + 4096].astype(np.int32)), pa.array(guest[k : k + 4096])]
                        yield pa.RecordBatch.from_arrays([*own, *place_], ["node", "weight", "dims", "v", "q", "block", "cell", "guest"])

    placed = cut(nodes.select("node", "weight", "dims", "v").mapInArrow(place, "node long, weight long, dims int, v binary, q binary, block int, cell int, guest boolean"))
    sizes = placed.groupBy("dims", "block", "cell").agg(F.count_if(~F.col("guest")).alias("home"), F.count_if("guest").alias("away"))
    # a cell where nobody is at home has nothing to compare
    chunks = cut(sizes.where("home > 0").select("dims", "block", "cell", in_chunks("home", chunk_rows).alias("h"), F.greatest(F.lit(1), in_chunks("away", chunk_rows)).alias("g")))

    def task(key: tuple, t: pa.Table) -> pa.Table:
        dims, block, _, i, j = (k.as_py() for k in key)
        t, space = t.sort_by("side"), spaces[dims]
        rotated = np.frombuffer(b"".join(t["q"].to_pylist()), "<i2").reshape(-1, dims)
        first = int((t["side"].to_numpy() == 0).sum())
        return compare(space, block, unpacked(t["v"].to_pylist(), dims), rotated, t["weight"].to_numpy(), first, i == j, threshold).table(t["node"].to_numpy())

    return tasks(small(chunks, chunks.count()), placed).groupBy("dims", "block", "cell", "i", "j").applyInArrow(task, LINKS)


LINKS = "node long, n long, root long"


def in_chunks(rows: str, chunk_rows: int) -> Column:
    """Into how many chunks so many rows are cut: a chunk is of `chunk_rows` rows of 64 dimensions."""
    per = F.greatest(F.lit(1), (F.lit(chunk_rows * 64) / F.greatest(F.col("dims"), F.lit(64))).cast("long"))
    return F.ceil(F.col(rows) / per).cast("int")


@dataclass
class Balls:
    """Balls of one number of dimensions: number, middle, radius, summed weight and one of the members of each."""

    number: np.ndarray
    middle: np.ndarray
    radius: np.ndarray
    weight: np.ndarray
    member: np.ndarray


def in_balls(nodes: DataFrame, leaders: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """nodes with ball, the number of the nearest leader, and how far that is; ball is null beyond half the range."""
    most = np.sqrt((2 - 2 * threshold) / 4) * (1 - 1e-6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, ball, far = b["dims"].to_numpy(), np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                cosines = unpacked(b["v"].take(pa.array(at)).to_pylist(), int(d)) @ leaders[d].T
                ball[at] = cosines.argmax(1)
                far[at] = np.sqrt(np.maximum(2 - 2 * cosines.max(1), 0)) + 1e-9
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ball, mask=far > most), pa.array(far)], [*b.schema.names, "ball", "far"])

    return nodes.mapInArrow(run, "node long, weight long, dims int, v binary, ball int, far double")


def ball_links(assigned: DataFrame, balls: dict[int, Balls], threshold: float, chunk_rows: int) -> DataFrame:
    """node, n, root of the links of the balls' members, with each other and with all other nodes.

    assigned: in_balls(), where ball is null for those of no ball here.
    """
    spark, reach = assigned.sparkSession, np.sqrt(2 - 2 * threshold)
    stats = [(d, int(k), int(w), int(m)) for d, x in balls.items() for k, w, m in zip(x.number, x.weight, x.member, strict=True)]
    of_ball = F.broadcast(spark.createDataFrame(stats, "dims int, ball int, total long, member long"))  # LEADERS rows for each number of dimensions
    inside = assigned.join(of_ball, ["dims", "ball"])

    def shells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of every node, the balls that it may be linked with, and whether it is with all members."""
        for b in batches:
            dims, own = b["dims"].to_numpy(), b["ball"].fill_null(-1).to_numpy()
            for d, x in balls.items():
                at = np.flatnonzero(dims == d)
                if not len(at):
                    continue
                far = np.sqrt(np.maximum(2 - 2 * unpacked(b["v"].take(pa.array(at)).to_pylist(), d) @ x.middle.T, 0))
                # two balls meet by the members of the one with the larger number
                other = (own[at, None] < 0) | (own[at, None] > x.number)
                row, k = np.nonzero(other & (far <= reach + x.radius + 1e-6))
                take = pa.array(at[row])
                every = pa.array(far[row, k] + x.radius[k] <= reach - 1e-6)
                yield pa.RecordBatch.from_arrays([*(b[c].take(take) for c in ("node", "weight", "dims", "v")), pa.array(x.number[k].astype(np.int32)), every], ["node", "weight", "dims", "v", "ball", "every"])

    near = cut(assigned.select("node", "weight", "dims", "v", "ball").mapInArrow(shells, "node long, weight long, dims int, v binary, ball int, every boolean"))
    whole = near.where("every")
    more = whole.groupBy("dims", "ball").agg(F.sum("weight").alias("more"))
    members = inside.join(F.broadcast(more), ["dims", "ball"], "left").select("node", (F.col("total") - F.col("weight") + F.coalesce("more", F.lit(0))).alias("n"), F.col("member").alias("root"))
    outside = whole.join(of_ball, ["dims", "ball"]).select("node", F.col("total").alias("n"), F.col("member").alias("root"))
    part = near.where("NOT every")
    sizes = part.groupBy("dims", "ball").agg(F.count("*").alias("away")).join(inside.groupBy("dims", "ball").agg(F.count("*").alias("home")), ["dims", "ball"])
    chunks = F.broadcast(sizes.select("dims", "ball", in_chunks("home", chunk_rows).alias("h"), in_chunks("away", chunk_rows).alias("g")))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1).cast("array<long>"))
    left = inside.join(chunks, ["dims", "ball"]).withColumn("i", F.pmod(F.xxhash64("node"), F.col("h"))).withColumn("j", every("g"))
    right = part.join(chunks, ["dims", "ball"]).withColumn("j", F.pmod(F.xxhash64("node"), F.col("g"))).withColumn("i", every("h"))
    columns = ["dims", "ball", "i", "j", "node", "weight", "v"]
    both = left.select(*columns, F.lit(0).alias("side")).union(right.select(*columns, F.lit(1).alias("side")))

    def task(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("side")
        units, out = unpacked(t["v"].to_pylist(), key[0].as_py()), Links(t["weight"].to_numpy())
        low = units.astype("f4")
        for p, q in near_pairs(low, low, int((t["side"].to_numpy() == 0).sum()), False, threshold - 1e-5):
            out.add(*linked(units, p, q, threshold))
        return out.table(t["node"].to_numpy())

    compared = both.groupBy("dims", "ball", "i", "j").applyInArrow(task, LINKS)
    return members.union(outside).union(compared)


def links_of(
    nodes: DataFrame, threshold: float = THRESHOLD, blocks: int = BLOCKS, sample: int = SAMPLE, cell_rows: int = CELL_ROWS, cells: int = CELLS, chunk_rows: int = CHUNK_ROWS,
    leaders: int = LEADERS, ball_rows: int = BALL_ROWS,
) -> DataFrame:
    """node, n (the summed weights of nodes that it links with), root (a node that it is connected to), several rows a node.

    nodes: node, v, dims, weight; a written table. All links are within one number of dimensions.
    """
    counts = {r["dims"]: r["count"] for r in nodes.groupBy("dims").count().collect()}
    some = {}
    for dims in counts:
        rows = nodes.where(F.col("dims") == dims).orderBy(F.xxhash64("v"), "node").limit(sample).select("v").collect()
        some[dims] = [bytes(r["v"]) for r in rows]
    spaces = {d: Space.fit(d, n, some[d], threshold, blocks, cell_rows, cells) for d, n in counts.items()}
    middles = {d: unpacked(x[:leaders], d) for d, x in some.items()}
    assigned = cut(in_balls(nodes.select("node", "weight", "dims", "v"), middles, threshold))
    stats = assigned.where("ball IS NOT NULL").groupBy("dims", "ball").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.sum("weight").alias("weight"), F.min("node").alias("member"))
    large = stats.where(F.col("n") >= ball_rows).orderBy("dims", "ball").collect()  # one row a leader at most
    balls = {}
    for d in {r["dims"] for r in large}:
        mine = [r for r in large if r["dims"] == d]
        column = lambda c, mine=mine: np.array([r[c] for r in mine])
        balls[d] = Balls(column("ball"), middles[d][column("ball")], column("far"), column("weight"), column("member"))
    if not balls:
        return block_links(nodes, spaces, threshold, chunk_rows)
    keys = F.broadcast(nodes.sparkSession.createDataFrame([(d, int(k)) for d, x in balls.items() for k in x.number], "dims int, ball int").withColumn("large", F.lit(True)))
    marked = cut(assigned.join(keys, ["dims", "ball"], "left").withColumn("ball", F.when(F.col("large"), F.col("ball"))).select("node", "weight", "dims", "v", "ball"))
    return ball_links(marked, balls, threshold, chunk_rows).union(block_links(marked.where("ball IS NULL"), spaces, threshold, chunk_rows))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding).

    A vector that is null, empty or zero, or that holds a null or a component that is not finite, links with nothing; nor
    does any with one of another length. Rows that share a vec_id are vectors of their own: they count for each other's
    links, but the shared id alone does not connect them. component_id is the smallest vec_id that is reached; one that is
    null is larger than all, and such a row is never kept. Equal vectors are compared once, and linked with each other.
    An empty table gives no rows. Other columns are not read.
    """
    rows = cut(keyed(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")).withColumn("key", key_of()))
    by_vector = rows.where("v is not null").groupBy("key").agg(F.first("v").alias("v"), F.first("dims").alias("dims"), F.count("*").alias("weight"), F.min("vec_id").alias("least"))
    nodes = cut(by_vector.withColumn("node", F.monotonically_increasing_id()))
    found = cut(links_of(nodes, threshold, **options))
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    labels = cut(components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a <> b").distinct()))
    least = nodes.select("node", "least").join(labels, F.col("node") == F.col("v"), "left").select("node", "least", F.coalesce("label", "node").alias("label"))
    smallest = least.groupBy("label").agg(F.min("least").alias("component_id"))
    of_node = least.join(smallest, "label").join(counts, "node", "left").select("node", "component_id", F.coalesce("n", F.lit(0)).alias("n"))
    of_key = cut(nodes.select("node", "key", "weight").join(of_node, "node").select("key", "component_id", (F.col("n") + F.col("weight") - 1).alias("n_links")))
    out = rows.select("vec_id", "key", "v").join(of_key, "key", "left")
    alone = F.col("v").isNull()
    own = F.when(alone, F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept"))


def key_of() -> Column:
    """128 bits of a packed vector; rows without one have keys of their own, so that they do not meet in one task."""
    other = F.when(F.col("v").isNull(), F.monotonically_increasing_id())
    return F.struct(F.xxhash64("v", other).alias("a"), F.xxhash64(other, "v", F.lit(1)).alias("b"))
