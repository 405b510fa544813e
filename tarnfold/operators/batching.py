"""Greedy fill of batches, of any number of items a group, without going through them one by one.

Prefix sums of tokens give each item the one that would begin the next batch if a batch began with it: its jump. Items
are cut into chunks of many batches each, with a margin of one batch from the chunk after, so all jumps of a chunk are
known inside it. Only items within one batch of a chunk's start can be the first that begins a batch there; for each of
those a chunk tells where the jumps leave it. Pointer doubling over these few marks the ones that the group's first item
leads to, and then each chunk numbers its own batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfold.session import cut

#: Batches of a chunk, and rows that a task sorts.
CHUNK, SORT_ROWS = 64, 1 << 20


def in_order(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """rows with at, which follows the order over all of them: sorted by ranges, whatever the size of a group."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // SORT_ROWS))
    return cut(rows.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order).withColumn("at", F.monotonically_increasing_id()))


def prefix_sums(rows: DataFrame, tokens: str) -> DataFrame:
    """rows (g, at, tokens) with before: the tokens of the group's rows before. No task holds more of a group than one range."""
    part = F.shiftright("at", 33).alias("part")
    sums = rows.groupBy("g", part).agg(F.sum(tokens).alias("own"))
    by = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("g", "part", F.coalesce(F.sum("own").over(by), F.lit(0)).alias("start"))
    run = Window.partitionBy("g", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("part", part).withColumn("run", F.coalesce(F.sum(tokens).over(run), F.lit(0))).join(starts, ["g", "part"]).withColumn("before", F.col("start") + F.col("run")).drop("part", "run", "start")


def jumps(before: np.ndarray, tokens: np.ndarray, budget: int) -> np.ndarray:
    """For each item the first one after it that no longer fits a batch that it begins; the number of items if all fit."""
    return np.maximum(np.searchsorted(before + tokens, before + budget, side="right"), np.arange(1, len(before) + 1))


def entries(budget: int, reach: int, width: int):
    """For each item of a chunk with which it may be entered: where its jumps leave the chunk, after how many batches."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        at, before, own = t["at"].to_numpy(), t["before"].to_numpy(), int((t["side"].to_numpy() == 0).sum())
        to = jumps(before, t["tokens"].to_numpy(), budget)
        left, count = to.copy(), np.ones(len(to), np.int64)
        for i in range(own - 1, -1, -1):
            if to[i] < own:
                left[i], count[i] = left[to[i]], 1 + count[to[i]]
        can = np.flatnonzero(before[:own] - key[1].as_py() * width <= reach)
        ends = left[can] >= len(at)
        to_at = pa.array(at[np.minimum(left[can], len(at) - 1)], mask=ends)
        one = lambda k: pa.array([key[k].as_py()] * len(can), t.schema.field("g" if k == 0 else "chunk").type)
        return pa.table({"g": one(0), "chunk": one(1), "at": at[can], "to": to_at, "n": count[can]})

    return run


def numbered(budget: int):
    """The batch of each item of a chunk: enter is the item that begins the first batch there, null if none does."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        at, batch = t["at"].to_numpy(), np.full(t.num_rows, t["first"][0].as_py() - 1)
        enter = t["enter"][0].as_py()
        if enter is not None:
            to, i = jumps(t["before"].to_numpy(), t["tokens"].to_numpy(), budget), int(np.searchsorted(at, enter))
            while i < len(at):
                batch[i:] += 1
                i = int(to[i])
        return pa.table({"at": at, "batch": batch})

    return run


def reached(table: DataFrame, first: DataFrame) -> DataFrame:
    """at of all items that the jumps lead to from the first ones. table: at, to."""
    seen, hop = cut(first), cut(table.where("to IS NOT NULL").select("at", "to"))
    while not hop.isEmpty():
        new = seen.join(hop, "at").select(F.col("to").alias("at"))
        seen = cut(seen.union(new))
        hop = cut(hop.join(hop.select(F.col("at").alias("to"), F.col("to").alias("next")), "to").select("at", F.col("next").alias("to")))
    return seen


def batches(items: DataFrame, tokens: str, budget: int, most: int, *keys: str, chunk: int = CHUNK) -> DataFrame:
    """items with batch, from 0 in each value of the keys: greedy fill in order of seq.

    A batch takes items until the next would bring it over the budget; an item over the budget is a batch by itself. Items
    without tokens (null) and those over `most` are left out. Items with one seq go by their tokens. Items of 0 tokens stay
    with those before them. A group may be of any size: it is cut into chunks of about `chunk` batches.
    """
    reach = max(1, budget, most)  # tokens from an item to the one that it jumps to, at most
    width = max(2, chunk) * reach
    rows = items.where(F.col(tokens) <= most).withColumn("_g", F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]) if keys else F.struct(F.lit(0).alias("k0")))
    placed = in_order(rows, ["_g"], [F.col("seq"), F.col(tokens)])
    each = prefix_sums(placed.select(F.xxhash64("_g").alias("g"), "at", F.col(tokens).cast("long").alias("tokens")), "tokens")
    each = cut(each.withColumn("chunk", F.floor(F.col("before") / width)))
    margin = each.where((F.col("chunk") > 0) & (F.col("before") - F.col("chunk") * width <= reach)).withColumn("chunk", F.col("chunk") - 1)
    both = each.withColumn("side", F.lit(0)).unionByName(margin.withColumn("side", F.lit(1)))
    table = cut(both.groupBy("g", "chunk").applyInArrow(entries(budget, reach, width), "g long, chunk long, at long, to long, n long"))
    used = reached(table, each.groupBy("g").agg(F.min("at").alias("at")).select("at"))
    into = table.join(used, "at", "left_semi").select("g", "chunk", F.col("at").alias("enter"), "n")
    chunks = each.select("g", "chunk").distinct().join(into, ["g", "chunk"], "left")
    by = Window.partitionBy("g").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    first = chunks.select("g", "chunk", "enter", F.coalesce(F.sum(F.coalesce("n", F.lit(0))).over(by), F.lit(0)).alias("first"))
    done = each.join(first, ["g", "chunk"]).groupBy("g", "chunk").applyInArrow(numbered(budget), "at long, batch long")
    return placed.join(done, "at").select(*[F.col(f"`{c}`") for c in items.columns], F.col("batch").cast("int").alias("batch"))
