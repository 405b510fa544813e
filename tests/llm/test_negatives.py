import math

import numpy as np
import pytest

from tarnfold.llm import negatives

KINDS = "vec_id long, embedding array<{}>, label int, id long, row long, q int, score long, rank string"


def table(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, lab, 1, 2, 3, 4, "r") for i, v, lab in rows], KINDS.format(kind))


def brute(rows, is_anchor, positives=5, negatives=10):
    rows = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out, score = [], lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    for k, (i, a, lab) in enumerate(rows):
        if not is_anchor(i):
            continue
        others = sorted((-score(a, v), j, same == lab) for m, (j, v, same) in enumerate(rows) if m != k and len(v) == len(a))
        for p, j, _ in [x for x in others if x[2]][:positives]:
            some = [(n, m) for n, m, same in others if not same and 30 * -p <= 100 * -n <= 90 * -p][:negatives]
            out += [(i, j, r, m, -p, -n) for r, (n, m) in enumerate(some, 1)]
    return sorted(out)


def check(spark, rows, every=10, kind="double", **options):
    got = negatives.hard_negatives(table(spark, rows, kind), negatives.F.col("id") % every == 0, **options).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, lambda i: i % every == 0)
    return got


def vectors(n, dims, seed, labels=10):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims)) + 0.7 * rng.standard_normal((labels, dims))[rng.integers(0, labels, n)]
    x /= np.linalg.norm(x, axis=1)[:, None]
    return [(i, v.tolist(), int(lab)) for i, (v, lab) in enumerate(zip(x, rng.integers(0, labels, n), strict=True))]


@pytest.mark.parametrize("dims, options", [(64, {}), (64, {"sub": 16, "words": 4, "chunk_rows": 50, "anchor_rows": 7}), (7, {"sub": 3, "chunk_rows": 90}), (2, {"sub": 1, "words": 3})])
def test_against_brute_force(spark, dims, options):
    assert len(check(spark, vectors(400, dims, dims), **options)) > 100


def test_ties_and_a_hot_label(spark):
    """Few different vectors, so nearly all scores are ties; one label holds two thirds of the rows."""
    rng = np.random.default_rng(1)
    kinds = rng.standard_normal((9, 8)).round(1)
    rows = [(int(i), kinds[k % 9].tolist(), 0 if k % 3 else k % 4) for k, i in enumerate(rng.permutation(300))]
    assert len(check(spark, rows, words=4)) > 100
    check(spark, [(i, [0.5, 0.5], i % 2) for i in range(60)])


def test_odd_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.2], 1), (10, [0.9, 0.3], 1), (20, [1.0, -1.0, 2.0], 1), (30, None, 1), (40, [1.0, None], 1), (50, [nan, 1.0], 1), (60, [], 1), (70, [1.0, 1.0], None), (None, [1.0, 1.0], 1)]
    rows += [(1, [0.5, 0.1], 2), (2, [0.6, 0.2], 2), (3, [0.6, 0.2], 2), (80, [0.0, 0.0], 1), (81, [0.0, 0.0], 3), (10, [0.9, 0.3], 1), (5, [-1.0, -0.5], 1)]
    got = check(spark, rows)
    assert {r.anchor_id for r in got} >= {0, 10, 80}
    assert negatives.hard_negatives(table(spark, [])).count() == 0
    with pytest.raises(Exception, match="64 bits"):
        check(spark, [(1, [1e9], 1)])


def test_bounds_hold_and_prune():
    """Every exact score lies between its bounds, whatever the books, and most rows need no exact score."""
    rows = np.floor(256 * np.array([v for _, v, _ in vectors(3000, 64, 2)])).astype(np.int64)
    for words, share in ((256, 0.05), (3, 1.0)):
        books = negatives.books_of(rows[:2000], 2, words)
        lower, upper = negatives.bounds(rows[:40], *negatives.encode(rows, books, 2), books, 2)
        exact = rows[:40] @ rows.T
        assert (lower <= exact).all() and (exact <= upper).all()
        for low, high, k in ((None, None, 5), (5000, 15000, 10), (40000, 60000, 10), (-3000, 3000, 10)):
            left = []
            for i in range(40):
                at = negatives.complete(lower[i], upper[i], low, high, k, lambda x, i=i: exact[i][x])
                good = np.flatnonzero((exact[i] >= (low or -(1 << 40))) & (exact[i] <= (high or 1 << 40)))
                assert set(good[np.lexsort((good, -exact[i][good]))[:k]]) <= set(at)
                left.append(len(at))
            assert low is not None or np.mean(left) <= share * len(rows)
