"""Sums over the subtrees of a graph of parents and children.

A node's total is its own value and the totals of its children, once for each edge. Where every node has one parent, the
graph is a forest, and sums are made by pointer doubling: in round k each node adds what the nodes 2 ** k below it have
summed up, so a chain of n nodes takes log2(n) rounds, each an aggregation and a join of one row a node.

Nodes with several parents are cut off as trees of their own. What they sum up to is settled from the last ones upwards
and added at each of their parents; then the forest is summed up again. Single parents that form a cycle are found by
pointers that never end, and are cut likewise. Only nodes from which a cycle can be reached depend on the way that was
taken to them: their walks are followed one by one, over those nodes alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfold.session import cut


def doubled(forest: DataFrame, values: Sequence[str], rounds: int) -> tuple[DataFrame, DataFrame]:
    """(id, top, the values summed over each subtree; id of nodes that the pointers of a cycle end at).

    forest: id, ptr (the parent, or null), values. rounds: enough for the longest chain.
    """
    state = cut(forest.withColumn("top", F.coalesce("ptr", "id")))
    for _ in range(rounds):
        open_ = state.where("ptr IS NOT NULL")
        if open_.isEmpty():
            break
        added = open_.groupBy(F.col("ptr").alias("id")).agg(*[F.sum(v).alias(f"{v}_more") for v in values])
        up = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("next"), F.col("top").alias("above"))
        sums = [(F.col(v) + F.coalesce(f"{v}_more", F.lit(0))).alias(v) for v in values]
        state = cut(state.join(added, "id", "left").join(up, "ptr", "left").select("id", F.col("next").alias("ptr"), F.coalesce("above", "top").alias("top"), *sums))
    return state.select("id", "top", *values), state.where("ptr IS NOT NULL").select(F.col("ptr").alias("id")).distinct()


def subtree_sums(nodes: DataFrame, edges: DataFrame, values: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(id and the values summed over all walks down from it, id of the nodes from which a cycle can be reached).

    nodes: id, values, each id once; edges: parent, child, both among the nodes, an edge as often as it counts. The sums
    of nodes that reach a cycle say nothing.
    """
    edges = cut(edges.where("parent <> child"))
    parents = edges.groupBy("child").agg(F.count("*").alias("n"))
    single = cut(edges.join(parents.where("n = 1"), "child").select(F.col("child").alias("id"), F.col("parent").alias("ptr")))
    rounds = nodes.count().bit_length() + 1
    sums, cyclic = doubled(nodes.join(single, "id", "left"), values, rounds)
    on_cycle = cut(cyclic)
    special = cut(parents.where("n > 1").select(F.col("child").alias("id")).union(on_cycle))
    if special.isEmpty():
        return sums, special
    single = single.join(on_cycle, "id", "left_anti")
    if not on_cycle.isEmpty():
        sums, _ = doubled(nodes.join(single, "id", "left"), values, rounds)
    jumps = cut(edges.join(special.withColumnRenamed("id", "child"), "child", "left_semi"))
    # From each special node's tree to the special nodes below it.
    below = cut(jumps.join(sums.select(F.col("id").alias("parent"), "top"), "parent").select(F.col("top").alias("id"), "child").join(special, "id", "left_semi"))
    todo, settled = cut(special.join(sums, "id").select("id", *values)), None
    while True:
        waits = below if settled is None else below.join(settled.select(F.col("id").alias("child")), "child", "left_anti")
        free = todo.join(waits, "id", "left_anti")
        if settled is not None:
            more = below.join(settled.withColumnRenamed("id", "child"), "child").groupBy("id").agg(*[F.sum(v).alias(f"{v}_more") for v in values])
            free = free.join(more, "id", "left").select("id", *[(F.col(v) + F.coalesce(f"{v}_more", F.lit(0))).alias(v) for v in values])
        free = cut(free)
        if free.isEmpty():
            break
        settled = free if settled is None else cut(settled.union(free))
        todo = cut(todo.join(free, "id", "left_anti"))
    # The forest once more: what hangs on each parent is its own, and edges to unsettled nodes are counted.
    known = nodes.limit(0).select("id", *values) if settled is None else settled
    hung = jumps.join(known.withColumnRenamed("id", "child"), "child", "left").groupBy(F.col("parent").alias("id"))
    more = hung.agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(f"{v}_more") for v in values], F.count_if(F.col(values[0]).isNull()).alias("loose"))
    whole = nodes.join(more, "id", "left").select("id", *[(F.col(v) + F.coalesce(f"{v}_more", F.lit(0))).alias(v) for v in values], F.coalesce("loose", F.lit(0)).alias("loose"))
    sums, _ = doubled(whole.join(single, "id", "left"), [*values, "loose"], rounds)
    return sums.select("id", *values), cut(sums.where("loose > 0").select("id"))


def walks(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """root, id, path of all walks down from the roots that visit no id twice. edges: parent, child."""
    level = cut(roots.select(F.col("id").alias("root"), F.col("id"), F.array("id").alias("path")))
    out = level
    while not level.isEmpty():
        new = level.join(edges, level["id"] == edges["parent"]).where(~F.array_contains("path", F.col("child")))
        level = cut(new.select("root", F.col("child").alias("id"), F.array_append("path", F.col("child")).alias("path")))
        out = out.union(level)
    return out


def totals(rows: DataFrame, edges: DataFrame, roots: DataFrame, cost: Column) -> DataFrame:
    """root, own, total, nodes (the ids on all walks from it, itself included): costs of a root and all below it.

    rows: id and what cost is made of, each id once; an id without a row costs 0. No walk visits an id twice; a child with
    two parents counts under both. A null id is none. Each root gives one row, however often it is named.
    """
    roots = cut(roots.select("id").where("id IS NOT NULL").distinct())
    edges = cut(edges.select("parent", "child").where("parent IS NOT NULL AND child IS NOT NULL AND parent <> child"))
    ids = rows.select("id").where("id IS NOT NULL").union(edges.select("parent")).union(edges.select("child")).union(roots).distinct()
    own = rows.select("id", F.coalesce(cost, F.lit(0)).cast("double").alias("cost"))
    nodes = cut(ids.join(own, "id", "left").select("id", F.coalesce("cost", F.lit(0.0)).alias("cost"), F.lit(1).cast("long").alias("n")))
    sums, looped = subtree_sums(nodes, edges, ["cost", "n"])
    own = nodes.select("id", F.col("cost").alias("own"))
    out = roots.join(looped, "id", "left_anti").join(sums, "id").join(own, "id").select(F.col("id").alias("root"), "own", F.col("cost").alias("total"), F.col("n").alias("nodes"))
    lost = cut(roots.join(looped, "id", "left_semi"))
    if lost.isEmpty():
        return out
    child = looped.withColumnRenamed("id", "child")
    inner = cut(edges.join(child, "child", "left_semi"))  # from which a cycle can be reached: so can it from the parent
    outer = edges.join(child, "child", "left_anti").join(looped.withColumnRenamed("id", "parent"), "parent", "left_semi")
    hung = outer.join(sums.withColumnRenamed("id", "child"), "child").groupBy(F.col("parent").alias("id")).agg(F.sum("cost").alias("c"), F.sum("n").alias("m"))
    each = cut(own.join(looped, "id", "left_semi").join(hung, "id", "left").select("id", (F.col("own") + F.coalesce("c", F.lit(0.0))).alias("c"), (1 + F.coalesce("m", F.lit(0))).alias("m")))
    followed = walks(inner, lost).join(each, "id").groupBy("root").agg(F.sum("c").alias("total"), F.sum("m").alias("nodes"))
    return out.union(followed.join(own.withColumnRenamed("id", "root"), "root").select("root", "own", "total", "nodes"))
