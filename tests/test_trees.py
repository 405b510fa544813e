import random

import pytest
from pyspark.sql import functions as F

from tarnfold.operators import history


def brute(costs, edges, root, seen=()):
    """(own, children, n) along all walks that visit no id twice."""
    total, n = 0.0, 0
    for p, c in edges:
        if p == root and c not in (*seen, root):
            own, below, m = brute(costs, edges, c, (*seen, root))
            total, n = total + own + below, n + 1 + m
    return costs.get(root) or 0.0, total, n


def check(spark, costs, edges, roots):
    rows = spark.createDataFrame(list(costs.items()), "id string, total_cost double")
    e = spark.createDataFrame(edges, "parent string, child string")
    got = {r.root: (r.own, r.children, r.n_subtasks) for r in history.tree_costs(rows, e, spark.createDataFrame([(r,) for r in roots], "id string")).collect()}
    want = {r: brute(costs, edges, r) for r in roots}
    assert got.keys() == want.keys()
    for r, (own, children, n) in want.items():
        assert got[r] == (own, pytest.approx(children), n), (r, got[r], want[r])


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed):
    """Trees, nodes with two parents, doubled edges, cycles with trees above and below, missing rows and null costs."""
    rng = random.Random(seed)
    ids, edges = [f"t{i}" for i in range(26)], []
    for i in range(1, 26):
        edges.append((f"t{rng.randrange(max(0, i - 6), i)}", f"t{i}"))
    edges += [(f"t{i}", f"t{j}") for i, j in (sorted(rng.sample(range(26), 2)) for _ in range(seed * 2))]
    if seed:
        edges += [edges[3], ("t5", "t5"), ("u", "t4"), ("t20", "gone")]
    if seed > 1:
        edges += [(f"t{rng.randrange(13, 26)}", f"t{rng.randrange(13)}") for _ in range(seed - 1)]
    costs = {i: rng.choice([None, 1.0, 2.5, 4.0]) for i in ids if rng.random() < 0.9}
    check(spark, costs, edges, [*ids, "u", "gone", "nowhere"])


def test_pure_cycles(spark):
    """Every node has one parent, and no node is a root."""
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "x"), ("x", "y"), ("p", "q"), ("q", "p"), ("s", "s")]
    check(spark, dict.fromkeys("abcxypqs", 1.0), edges, "abcxypqs")


def test_a_long_chain_and_a_wide_star(spark):
    n = 10_000
    chain = spark.range(n).select(F.col("id").alias("parent"), (F.col("id") + 1).alias("child"))
    rows = spark.range(n + 1).withColumn("total_cost", F.lit(1.0))
    got = {r.root: (r.total, r.n_subtasks) for r in history.tree_costs(rows, chain, spark.range(0, n + 1, 2500)).collect()}
    assert got == {k: (n + 1.0 - k, n - k) for k in range(0, n + 1, 2500)}
    n = 200_000
    star = spark.range(1, n + 1).select(F.lit(0).cast("long").alias("parent"), F.col("id").alias("child"))
    (r,) = history.tree_costs(spark.range(n + 1).withColumn("total_cost", F.lit(0.5)), star, spark.range(1)).collect()
    assert (r.own, r.children, r.n_subtasks) == (0.5, n / 2, n)
