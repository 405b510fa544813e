import numpy as np
import pytest

from tarnfold.llm import vectors

KINDS = "vec_id long, embedding array<{}>, label int, node long, v int, key string, n long, weight int"


def table(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, 0, 1, 2, "k", 3, 4) for i, v in rows], KINDS.format(kind))


def brute(rows, threshold=0.9):
    """(vec_id, n_links, component_id, kept) of every row, by comparing all with all."""
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    links = [[] for _ in rows]
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1], float) / np.abs(rows[k][1]).max() for k in (i, j))
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= threshold:
                    links[i].append(j)
                    links[j].append(i)
    out, comp = [], [None] * len(rows)
    for i in range(len(rows)):
        if comp[i] is None:
            seen, todo = {i}, [i]
            while todo:
                for k in links[todo.pop()]:
                    if k not in seen:
                        seen.add(k)
                        todo.append(k)
            least = min((rows[k][0] for k in seen if rows[k][0] is not None), default=None)
            for k in seen:
                comp[k] = (least,)
        out.append((rows[i][0], len(links[i]), comp[i][0], rows[i][0] is not None and rows[i][0] == comp[i][0]))
    return sorted(out, key=repr)


def check(spark, rows, kind="double", **options):
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(table(spark, rows, kind), **options).collect()), key=repr)
    assert got == brute(rows, options.get("threshold", 0.9))
    return got


def planted(n, dims, seed, spread):
    """Balls and chains of near vectors around the threshold, exact copies, copies of another length, and single ones."""
    rng, out = np.random.default_rng(seed), []
    while len(out) < n:
        c = rng.standard_normal(dims)
        for _ in range(rng.integers(1, 9)):
            out.append(c * rng.choice([1, 1, 3.5]))
            c = c + rng.standard_normal(dims) * rng.choice(spread)
    ids = rng.permutation(len(out)) * 3
    return [(int(i), [float(x) for x in v]) for i, v in zip(ids, out, strict=True)]


@pytest.mark.parametrize("dims, blocks, cell_rows, chunk_rows", [(64, 4, 30, 1 << 15), (64, 8, 100, 40), (16, 2, 25, 7), (3, 4, 20, 11), (1, 4, 50, 1 << 15), (100, 3, 400, 30)])
def test_against_brute_force(spark, dims, blocks, cell_rows, chunk_rows):
    """Many cells, guests, and cells cut into many chunks: each link is counted once."""
    rows = planted(260, dims, dims, [0.0, 0.1, 0.3, 0.45, 0.5])
    got = check(spark, rows, blocks=blocks, cell_rows=cell_rows, chunk_rows=chunk_rows)
    assert check(spark, rows, blocks=blocks, cell_rows=cell_rows, chunk_rows=chunk_rows, leaders=60, ball_rows=3) == got
    assert sum(r[1] for r in got) > 100 and sum(r[3] for r in got) < len(rows)


def test_other_thresholds(spark):
    for threshold in (0.3, 0.99, 1 - 1e-6):
        check(spark, planted(120, 24, 5, [0.0, 0.05, 0.4, 1.5]), threshold=threshold, cell_rows=20)


def test_pairs_at_the_threshold(spark):
    """Pairs a hair above and below it, in every direction."""
    rng, rows = np.random.default_rng(3), []
    for k in range(120):
        a, b = rng.standard_normal((2, 64))
        a /= np.linalg.norm(a)
        b -= a * (a @ b)
        b /= np.linalg.norm(b)
        c = 0.9 + (1e-7 if k % 2 else -1e-7)
        rows += [(2 * k, a.tolist()), (2 * k + 1, (c * a + np.sqrt(1 - c * c) * b).tolist())]
    got = check(spark, rows, cell_rows=30)
    assert sum(r[1] for r in got) == 120


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.1]), (None, None)]
    rows += [(7, [0.0, -1.0]), (7, [0.0, -1.0]), (12, [-0.0, -5.0]), (13, [1e300, 1e300]), (14, [1e-300, 1e-300]), (15, [5e-324, 5e-324]), (16, [3.4e38, -3.4e38])]
    got = check(spark, rows)
    assert (8, 2, 7, False) in got and (None, 0, None, False) in got
    assert vectors.near_duplicates(table(spark, [])).count() == 0
    check(spark, [(None, [1.0, 2.0]), (None, [1.0, 2.0])])
    check(spark, [(i, [1.0, float(i % 2)]) for i in range(50)], "float")


def test_hot_group(spark):
    """A third of the rows are near copies of one vector, and as many exact copies: counted, with no pairs given back."""
    rng = np.random.default_rng(9)
    c = rng.standard_normal(32)
    rows = [(i, (c + (0.02 * rng.standard_normal(32) if i % 3 else 0)).tolist() if i % 3 < 2 else rng.standard_normal(32).tolist()) for i in range(900)]
    got = {r[0]: r for r in check(spark, rows, cell_rows=100, chunk_rows=64)}
    assert got[0][1] == got[1][1] == 599 and got[1][2] == 0
    for leaders, ball_rows in ((1024, 100), (200, 2)):
        assert check(spark, rows, cell_rows=100, chunk_rows=64, leaders=leaders, ball_rows=ball_rows) == sorted(got.values(), key=repr)


def test_balls_and_their_shells(spark):
    """Broad groups around each other: balls that are linked as a whole, by some members, and not at all; several lengths."""
    rng = np.random.default_rng(12)
    rows = []
    for dims in (8, 20):
        c = rng.standard_normal(dims)
        c /= np.linalg.norm(c)
        for k in range(240):
            side = rng.standard_normal(dims)
            side -= c * (c @ side)
            rows.append((1000 * dims + k, (c + side / np.linalg.norm(side) * rng.choice([0, 0.05, 0.2, 0.3, 0.45, 0.6])).tolist()))
    got = check(spark, rows, leaders=40, ball_rows=2, chunk_rows=16)
    assert check(spark, rows) == got and max(r[1] for r in got) > 100
