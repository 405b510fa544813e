"""Mixing sources to target weights by Pfair scheduling of source blocks.

Documents of a source are cut into blocks of about equal bytes. With weight w (as a part of the sum of weights), the
source's block j, from 1, has release floor((j - 1) / w) and deadline ceil(j / w); one block a slot, the released
block with the earliest deadline first. As the weights sum to one, every block meets its deadline, so at any slot
each source has had less than one block more or fewer than its weight asks for. Weights are whole numbers of
`RESOLUTION`, finer than the doubles they come from, and no schedule is repeated: t slots add t / RESOLUTION blocks to
that bound, under 10^-15 for 100 TB.

When a source has no block left, a new phase begins in which the others share its weight. A slot's source depends on
all slots before it, so the order is worked out block by block, in one task that holds one row a source and a piece of
the order; it takes some microseconds a block, and `block` sets how many there are. Documents never pass through it:
they are cut into blocks, and meet their slots, in tasks of CHUNK blocks. The driver holds one number a source.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnfold.llm.common import cut, row_of, small
from tarnfold.llm.sharding import size_of

#: Slots that are worked out at a time.
PERIOD = 1000
RESOLUTION = 1 << 80
BLOCK = 1 << 20
ALPHA = 0.7
#: Blocks that one task cuts: the unit by which a large source is divided.
CHUNK = 4


def shares(weights: dict[str, float], period: int) -> dict[str, int]:
    """Whole numbers of 1 or more that sum to the period, nearest to the weights by largest remainder.

    A weight of less than one of the period counts as one. The period has at least one for each source.
    """
    exact, free, out = {s: Fraction(w) for s, w in sorted(weights.items())}, period, {}
    total = sum(exact.values())
    for s in sorted(exact, key=exact.get):  # the least first: what one is given more, the others have less
        if exact[s] * free >= total and exact[s]:
            break
        out[s], free, total = 1, free - 1, total - exact[s]
    rest = {s: w * free / total for s, w in exact.items() if s not in out}
    if not rest:  # only where no weight asks for anything
        return {s: 1 + free // len(out) + (k < free % len(out)) for k, s in enumerate(sorted(out))}
    out |= {s: int(x) for s, x in rest.items()}
    for s in sorted(rest, key=lambda s: (int(rest[s]) - rest[s], s))[: period - sum(out.values())]:
        out[s] += 1
    return out


def earliest(share: dict[str, int]) -> Iterator[str]:
    """Earliest deadline first, without end: the source of each slot."""
    period = sum(share.values())
    waiting = [(0, s, 1) for s in sorted(share)]  # a source's next block only: it is due before those after it
    ready: list[tuple[int, str, int]] = []
    for t in itertools.count():
        while waiting and waiting[0][0] <= t:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-j * period // share[s]), s, j))
        deadline, s, j = heapq.heappop(ready)
        assert deadline > t
        heapq.heappush(waiting, (j * period // share[s], s, j + 1))
        yield s


def one_period(share: dict[str, int]) -> list[str]:
    """Earliest deadline first over one period: the source of each slot."""
    return list(itertools.islice(earliest(share), sum(share.values())))


def phases(blocks: dict[str, int], weights: dict[str, float], period: int) -> Iterator[tuple[int, dict[str, int], list[str], dict[str, int]]]:
    """(first slot, blocks that went before by source, sources of the next slots, their blocks by source), until all are placed.

    A phase is given in pieces of `period` slots, or twice as many as it has sources. What went before names the
    sources of the phase: each phase has fewer than the one before.
    """
    done, slot = dict.fromkeys(blocks, 0), 0
    while left := {s: n - done[s] for s, n in blocks.items() if n > done[s]}:
        order, most = earliest(shares({s: weights[s] for s in left}, RESOLUTION)), max(period, 2 * len(left))
        s = next(order)
        while left[s]:  # up to the first block that is not there
            piece, took = [], dict.fromkeys(left, 0)
            while left[s] and len(piece) < most:
                piece.append(s)
                took[s] += 1
                left[s] -= 1
                s = next(order)
            yield slot, {x: done[x] for x in left}, piece, took
            for x, n in took.items():
                done[x] += n
            slot += len(piece)


def slots_of(spark: SparkSession, blocks: dict[str, int], weights: dict[str, float], period: int) -> DataFrame:
    """source, block, phase, slot of every block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            phase, sources = -1, None
            for slot, before, piece, _ in phases(blocks, weights, period):
                if len(before) != sources:
                    phase, sources = phase + 1, len(before)
                block = []
                for s in piece:
                    block.append(before[s])
                    before[s] += 1
                yield pd.DataFrame({"source": piece, "block": block, "phase": phase, "slot": range(slot, slot + len(piece))})

    return spark.range(0, 1, 1, 1).mapInPandas(run, "source string, block long, phase int, slot long")


def source_of(docs: DataFrame) -> Column:
    return F.coalesce(docs["source"].cast("string"), F.lit(""))


def tie_of(docs: DataFrame) -> Column:
    """What orders rows in their source, as if by chance. Copies of a row differ in it, so that they spread like others."""
    return F.xxhash64(docs["doc_id"], docs["text"], F.monotonically_increasing_id())


class Blocks:
    """How sources divide into blocks of near equal bytes: by hash into chunks, and each chunk into whole blocks.

    rows: source, size, tie. No task holds a whole source; the driver holds one row a source.
    """

    def __init__(self, rows: DataFrame, block: int, chunk: int):
        spark = rows.sparkSession
        totals = rows.groupBy("source").agg(F.sum("size").alias("bytes")).collect()
        self.bytes = {r["source"]: r["bytes"] for r in totals}
        chunks = spark.createDataFrame([(s, max(1, round(n / block / chunk))) for s, n in self.bytes.items()] or [("", 1)], "source string, chunks long")
        self.chunks = small(chunks, len(totals))
        sizes = self.chunked(rows).groupBy("source", "chunk").agg(F.sum("size").alias("chunk_bytes"))
        counted = sizes.withColumn("n", F.greatest(F.round(F.col("chunk_bytes") / block), F.lit(1)).cast("long"))
        by = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        self.counted = cut(counted.withColumn("first", F.coalesce(F.sum("n").over(by), F.lit(0))))
        self.n = {r["source"]: r["n"] for r in self.counted.groupBy("source").agg(F.sum("n").alias("n")).collect()}

    def chunked(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.chunks, "source").withColumn("chunk", F.pmod(F.xxhash64("tie", F.lit(1)), F.col("chunks"))).drop("chunks")

    def of(self, rows: DataFrame) -> DataFrame:
        """rows with block, from 0 in each source, in the order of tie. Each chunk is sorted by itself."""
        order = Window.partitionBy("source", "chunk").orderBy("tie", "size")
        before = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
        # by source and chunk, as the window after it: no exchange between
        joined = self.chunked(rows).join(self.counted, ["source", "chunk"])
        place = F.least(F.floor(before * F.col("n") / F.col("chunk_bytes")), F.col("n") - 1)
        return joined.withColumn("block", (F.col("first") + place).cast("long")).drop("chunk", "chunk_bytes", "n", "first")


def weights_of(sizes: dict[str, int], weights: dict[str, float] | None, alpha: float) -> dict[str, float]:
    """The weight of every source of the table: as given, on any scale, or its bytes to the power alpha if none is given."""
    if weights is None:
        return {s: float(n) ** alpha for s, n in sizes.items()}
    if lacking := sorted(set(sizes) - set(weights)):
        raise ValueError(f"no weight for the sources {lacking[:10]}: give all or none")
    if wrong := sorted(s for s in sizes if not 0 <= weights[s] < float("inf")):
        raise ValueError(f"weights of 0 or more are needed, not those of {wrong[:10]}")
    return {s: float(weights[s]) for s in sizes}


def placed(rows: DataFrame, compact: DataFrame, weights: dict[str, float] | None, alpha: float, block: int, period: int, chunk: int) -> tuple[DataFrame, int]:
    """rows (source, size, tie and others) with block, slot and phase, null for sources of weight 0; how many slots there are.

    compact: the same rows, with these three columns alone.
    """
    blocks = Blocks(compact, block, chunk)
    weight = weights_of(blocks.bytes, weights, alpha)
    n = {s: n for s, n in blocks.n.items() if weight[s]}
    cells = blocks.of(rows)
    if not n:
        return cells.withColumn("slot", F.lit(None).cast("long")).withColumn("phase", F.lit(None).cast("int")), 0
    timed = cut(slots_of(rows.sparkSession, n, {s: weight[s] for s in n}, period))
    return cells.join(small(timed, sum(n.values())), ["source", "block"], "left"), sum(n.values())


def schedule(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, block: int = BLOCK, period: int = PERIOD, chunk: int = CHUNK) -> DataFrame:
    """doc_id, source, size, block, slot, phase of every row.

    weights: of all sources, on any scale, or None: then a source weighs its bytes to the power alpha. A source without
    one is an error; one of weight 0 gets no slot: its rows have null slots. All other rows are placed, each once:
    weights hold until a source is used up. A null source is the source ''. Repeated rows and rows without doc_id are
    placed each for itself. A text longer than a block spans the block where it begins, so blocks after it may have no
    row of their own: their slots stay empty. A null text has size 16. An empty table gives no rows. Other columns are
    not read.
    """
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), source_of(docs).alias("source"), size_of(F.col("text")).alias("size"), tie_of(docs).alias("tie")))
    out, _ = placed(rows, rows.select("source", "size", "tie"), weights, alpha, block, period, chunk)
    return out.select("doc_id", "source", "size", "block", "slot", "phase")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, block: int = BLOCK, period: int = PERIOD, chunk: int = CHUNK, partition_bytes: int = 64 << 20) -> DataFrame:
    """docs in the order of their slots: written files follow it. Each row once, with docs's columns, as schedule() places it.

    Rows of sources of weight 0 are left out. Every row goes to its own slot, whatever its doc_id. docs must give the same
    rows in the same partitions when it is read again, as written tables do; otherwise blocks may differ a little in size.
    Texts cross two exchanges: into blocks, and into the order of the slots. A text of any length is one row; an empty
    table gives no rows. docs may have further columns of any names, which stay as they are.
    """
    mine = F.struct(source_of(docs).alias("source"), size_of(docs["text"]).alias("size"), tie_of(docs).alias("tie")).alias("_m")
    compact = cut(docs.select(mine).select("_m.*"))
    rows = docs.select(row_of(docs).alias("_row"), mine).select("_row", "_m.*")
    total = int(compact.agg(F.sum("size")).first()[0] or 0)
    out, slots = placed(rows, compact, weights, alpha, block, period, chunk)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // partition_bytes))
    # slots are of about equal bytes, so equal stretches of them make equal parts
    part = F.least(F.floor(F.col("slot") * parts / max(1, slots)), F.lit(parts - 1)).cast("int")
    ordered = out.where("slot is not null").repartitionById(parts, part).sortWithinPartitions("slot", "tie")
    return ordered.select("_row.*")
