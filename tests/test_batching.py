import random

import pytest

from tarnfold.operators import batching


def brute(items, budget, most):
    """(group, seq, tokens) -> the same with batch, one item after another."""
    out, state = [], {}
    for g, s, t in sorted(items, key=lambda x: (x[0] or "", x[1], x[2] or 0)):
        if t is None or t > most:
            continue
        batch, total, any_ = state.get(g, (0, 0, False))
        if any_ and total + t > budget:
            batch, total = batch + 1, 0
        state[g] = batch, total + t, True
        out.append((g, s, t, batch))
    return sorted(out, key=repr)


def check(spark, items, budget, most, **options):
    df = spark.createDataFrame([(g, s, t, 1, 2) for g, s, t in items], "k string, seq long, tokens int, at int, chunk int")
    got = sorted(((r.k, r.seq, r.tokens, r.batch) for r in batching.batches(df.withColumnRenamed("at", "other"), "tokens", budget, most, "k", **options).collect()), key=repr)
    assert got == brute(items, budget, most)


@pytest.mark.parametrize("chunk", [2, 3, 64])
def test_against_the_greedy_loop(spark, chunk):
    """A hot group over very many chunks, small ones, a null one, items of 0 tokens, over the budget, and left out."""
    rng = random.Random(chunk)
    items = [("hot", i, rng.choice([0, 1, 5, 30, 60, 99, 100, 101, 130, 200])) for i in range(1500)]
    items += [(rng.choice(["a", "b", None]), i, rng.choice([None, 1, 40, 100, 500])) for i in range(200)]
    items += [("ones", i, 1) for i in range(900)] + [("zeros", i, 0) for i in range(20)] + [("lone", 1, 7)]
    check(spark, items, 100, 150, chunk=chunk)


def test_batches_longer_than_a_chunk_of_items(spark):
    check(spark, [("k", i, 50) for i in range(400)], 10_000, 8191)
    check(spark, [("k", i, 50) for i in range(100)], 50, 60, chunk=2)
    check(spark, [], 100, 100)
