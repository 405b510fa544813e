import functools
import random
import time

from tarnfold.operators import evals


def plain(points):
    """Every point against all points and all labels so far."""
    order = sorted(range(len(points)), key=functools.cmp_to_key(lambda a, b: points[b][1] - points[a][1] if abs(points[b][1] - points[a][1]) > 1 else points[a][0] - points[b][0]))
    done, out = [], {}
    for i in order:
        cost, score, name = points[i]
        best = "top"
        for side in ("top", "bottom", "right", "left"):
            label = any(s == side and abs(cost - c) < 4 and abs(score - v) < 5 for c, v, s in done)
            point = False
            for c, v, other in points:
                if other != name:
                    point |= side == "top" and abs(cost - c) < 3 and v > score and v - score < 6
                    point |= side == "bottom" and abs(cost - c) < 3 and v < score and score - v < 6
                    point |= side == "left" and abs(score - v) < 3 and c < cost and cost - c < 4
                    point |= side == "right" and abs(score - v) < 3 and c > cost and c - cost < 4
            if not label and not point:
                best = side
                break
        out[i] = best
        done.append((cost, score, best))
    return [out[i] for i in range(len(points))]


def test_labels_against_all_pairs():
    rng = random.Random(4)
    for n in [0, 1, 2, 5, 20, 60] * 15:
        points = [(rng.uniform(0, 25), rng.choice([rng.uniform(40, 60), float(rng.randrange(40, 60))]), f"m{k}") for k in range(n)]
        assert evals.placed_labels(points) == plain(points)


def test_plots_are_placed_each_for_itself(spark):
    rows = [("a", "x", 1.0, 50.0), ("a", "y", 1.5, 50.5), ("b", "x", 1.0, 50.0)]
    out = {(r.plot, r.label): r.position for r in evals.label_positions(spark.createDataFrame(rows, "plot string, label string, cost double, score double")).collect()}
    assert out[("b", "x")] == "top" and out[("a", "x")] != out[("a", "y")]


def test_labels_on_edges_and_of_one_name():
    """Whole and half numbers, so points lie on the edges of what is in the way, and names that come again."""
    rng = random.Random(5)
    for n in [1, 3, 10, 40, 120] * 12:
        wide = rng.choice([6, 20, 60])
        points = [(rng.randrange(-wide, wide) / 2, rng.randrange(-wide, wide) / 2, rng.choice("abcdefgh"[: rng.choice([1, 2, 8])])) for _ in range(n)]
        assert evals.placed_labels(points) == plain(points)


def test_a_dense_plot_takes_no_square_of_its_points():
    rng = random.Random(6)
    points = [(rng.uniform(0, 50), float(k % 101), f"m{k}") for k in range(40_000)]
    begin = time.monotonic()
    out = evals.placed_labels(points)
    assert time.monotonic() - begin < 15 and {"top", "bottom", "left"} <= set(out)
