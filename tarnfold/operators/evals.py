"""Evaluation runs: totals, scores, dashboards, filters and leaderboards.

Tables: runs (id, model, description, settings, created_at ...), tasks (id, run_id, language, passed, started_at,
finished_at ...), metrics (task_id, tokens_in, tokens_out, cost, duration, tool_usage map). `passed` has three values:
null counts as failed in a run's totals, as neither in its page, and in the denominator of scores.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import math
from collections.abc import Callable, Sequence
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANGUAGES = ["go", "java", "javascript", "python", "rust"]
SUMS = ["tokens_in", "tokens_out", "tokens_context", "cache_writes", "cache_reads", "cost", "duration"]


def count_if(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0)).cast("long")


def finish_run(tasks: DataFrame, metrics: DataFrame) -> DataFrame:
    """Per run: sums over tasks that have metrics, and how many passed and did not (null is not passed)."""
    sums = [F.sum(c).alias(c) for c in SUMS if c in metrics.columns]
    joined = tasks.join(metrics, tasks["id"] == metrics["task_id"]).groupBy("run_id")
    return joined.agg(*sums, count_if(F.col("passed")).alias("passed"), count_if(~F.coalesce("passed", F.lit(False))).alias("failed"))


def tool_usage(tasks: DataFrame, metrics: DataFrame, how: str = "sum") -> DataFrame:
    """run_id, tool, attempts, failures: merged maps of tool -> struct(attempts, failures), by sum or, idempotently, by max."""
    f = {"sum": F.sum, "max": F.max}[how]
    each = tasks.join(metrics, tasks["id"] == metrics["task_id"], "left").select("run_id", F.explode("tool_usage").alias("tool", "u"))
    return each.groupBy("run_id", "tool").agg(f("u.attempts").alias("attempts"), f("u.failures").alias("failures"))


def usage_map(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, tool, attempts, failures) back to one map for the keys, tools in order."""
    entry = F.struct("tool", F.struct("attempts", "failures").alias("u"))
    return rows.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("tool_usage"))


def language_scores(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("run_id", "language").agg((count_if(F.col("passed")).cast("double") / F.count("*")).alias("score"))


def pivot_scores(scores: DataFrame, languages: Sequence[str] = LANGUAGES) -> DataFrame:
    return scores.groupBy("run_id").pivot("language", list(languages)).agg(F.first("score")).fillna(0.0)


def run_stats(tasks: DataFrame) -> DataFrame:
    """Counts of a run's page: null is neither passed nor failed; the rate has one decimal and is null with none completed."""
    p, n = count_if(F.col("passed")), count_if(~F.col("passed"))
    rate = F.round(100 * F.try_divide(p.cast("double"), (p + n).cast("double")), 1)
    return tasks.groupBy("run_id").agg(p.alias("passed"), n.alias("failed"), (p + n).alias("completed"), (F.count("*") - p - n).alias("remaining"), rate.alias("pass_rate"))


def elapsed_ms(created: Column, finished: Column, now: Column) -> Column:
    """From creation to the last finish, never negative; to now where nothing finished."""
    end = F.greatest(F.coalesce(finished, now), created)
    return F.unix_millis(end.cast("timestamp")) - F.unix_millis(created.cast("timestamp"))


def task_status(passed: Column, started: Column, finished: Column) -> Column:
    return F.when(passed, "passed").when(~passed, "failed").when(started.isNotNull() & finished.isNull(), "running").otherwise("waiting")


def status_groups(tasks: DataFrame, status: Column, order: str) -> DataFrame:
    """run_id, status, ids: the tasks of a status in their original order."""
    ids = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("_o"), "id"))), lambda x: x["id"])
    return tasks.withColumn("status", status).groupBy("run_id", "status").agg(ids.alias("ids"))


def tool_groups(ranking: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """group, attempts, failures, success_rate, n_tools of named tool groups; a tool can be in several."""
    spark = ranking.sparkSession
    names = spark.createDataFrame([(g, t) for g, ts in groups.items() for t in ts], "group string, tool string")
    return ranking.join(F.broadcast(names), "tool").groupBy("group").agg(
        F.sum("attempts").alias("attempts"), F.sum("failures").alias("failures"),
        success_rate(F.sum("attempts"), F.sum("failures")).alias("success_rate"), F.count("*").alias("n_tools"),
    )


def success_rate(attempts: Column, failures: Column) -> Column:
    return F.coalesce(F.try_divide(100.0 * (attempts - failures), attempts), F.lit(0.0))


def within(created: Column, frame: str, now: datetime) -> Column:
    """Whether a row is of the last 24h, 7d, 30d or 90d (kept when exactly that old); all keeps every row."""
    spans = {"24h": timedelta(hours=24), "7d": timedelta(days=7), "30d": timedelta(days=30), "90d": timedelta(days=90)}
    return F.lit(True) if frame == "all" else created >= F.lit(now - spans[frame])


def one_of(c: Column, chosen: Sequence) -> Column:
    """A multi-select: nothing chosen is no filter; null is never chosen."""
    return c.isNotNull() & c.isin(list(chosen)) if chosen else F.lit(True)


def json_field(settings: Column, path: str) -> Column:
    return F.get_json_object(settings, f"$.{path}")


def sort_runs(runs: DataFrame, column: str, descending: bool = True) -> DataFrame:
    """By a column or by `percent`, which is 0 for an empty run; ties by id, newest first."""
    keys = {"percent": F.coalesce(F.try_divide(F.col("passed").cast("double"), F.col("passed") + F.col("failed")), F.lit(0.0))}
    key = keys.get(column, F.col(column))
    return runs.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_first(), F.col("id").desc())


def leaderboard(runs: DataFrame, scores: DataFrame) -> DataFrame:
    """Runs with their score (null for none at all), label and language scores, most passed first."""
    label = F.coalesce(F.nullif(F.col("description"), F.lit("")), F.col("model"))
    out = runs.withColumn("label", label).withColumn("score", F.try_divide(F.col("passed").cast("double"), F.col("passed") + F.col("failed")))
    return out.join(scores.withColumnRenamed("run_id", "id"), "id", "left").orderBy(F.desc("passed"), "id")


def enrich(runs: DataFrame, catalogue: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A run's own value, else the model catalogue's, else null."""
    theirs = catalogue.select(F.col("model").alias("_model"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = runs.join(theirs, runs["model"] == F.col("_model"), "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.col(f"_{c}")) for c in columns}).drop("_model", *[f"_{c}" for c in columns])


def expand_suite(languages: DataFrame, exercises: DataFrame, iterations: int) -> DataFrame:
    """Tasks of a suite: every exercise of its language, `iterations` times. exercises: language, exercise."""
    return languages.join(exercises, "language").withColumn("iteration", F.explode(F.sequence(F.lit(1), F.lit(iterations))))


def live_usage(tasks: DataFrame, stored: DataFrame, live: DataFrame) -> DataFrame:
    """A finished task has its stored usage, another one the live, and the stored where there is no live one; duration 0 is missing."""
    s, v = stored.alias("s"), live.alias("v")
    joined = tasks.alias("t").join(s, F.col("t.id") == F.col("s.task_id"), "left").join(v, F.col("t.id") == F.col("v.task_id"), "left")
    done = F.col("t.finished_at").isNotNull()
    pick = lambda c: F.when(done, F.coalesce(F.col(f"s.{c}"), F.col(f"v.{c}"))).otherwise(F.coalesce(F.col(f"v.{c}"), F.col(f"s.{c}")))
    clock = F.unix_millis(F.col("t.finished_at").cast("timestamp")) - F.unix_millis(F.col("t.started_at").cast("timestamp"))
    duration = F.coalesce(F.nullif(F.col("s.duration"), F.lit(0)), F.nullif(F.col("v.duration"), F.lit(0)), clock)
    return joined.select("t.id", pick("tokens_in").alias("tokens_in"), pick("tokens_out").alias("tokens_out"), pick("cost").alias("cost"), duration.alias("duration"))


def neighbours(points: DataFrame, cost_within: float, score_within: float) -> DataFrame:
    """Pairs of plotted points that are near in cost and score, by cells of cost: each point meets its own cell and those beside."""
    cell = F.floor(F.col("cost") / cost_within)
    a = points.select(F.col("id").alias("a"), F.col("cost").alias("cost_a"), F.col("score").alias("score_a"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    b = points.select(F.col("id").alias("b"), F.col("cost").alias("cost_b"), F.col("score").alias("score_b"), cell.alias("cell"))
    near = (F.abs(F.col("cost_a") - F.col("cost_b")) < cost_within) & (F.abs(F.col("score_a") - F.col("score_b")) < score_within)
    return a.join(b, "cell").where((F.col("a") < F.col("b")) & near).select("a", "b")


#: Sides of a label in the order in which they are tried; cost and score within which labels, or a label and a
#: point on its side, are in each other's way.
SIDES = ["top", "bottom", "right", "left"]
LABEL_COST, LABEL_SCORE, POINT_ACROSS, POINT_UP, POINT_ASIDE = 4, 5, 3, 6, 4


def before(a: tuple, b: tuple) -> float:
    """The order in which labels are placed: the higher score first, but scores within one of each other by cost."""
    return b[1] - a[1] if abs(b[1] - a[1]) > 1 else a[0] - b[0]


def least_of_others(values: np.ndarray, label: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """For each row, the least of values[first:stop] with another label than the row's own.

    The least of 1, 2, 4 ... values from each place on, and the least of another label than that one; two such stretches
    cover a range.
    """
    out, length, width = np.full(len(values), np.inf), stop - first, 1
    best, owner, second = values, label, np.full(len(values), np.inf)
    while True:
        rows = np.flatnonzero((length >= width) & (length < 2 * width))
        for at in (first[rows], stop[rows] - width):
            out[rows] = np.minimum(out[rows], np.where(owner[at] != label[rows], best[at], second[at]))
        if not (length >= 2 * width).any():
            return out
        left, same = best[:-width] <= best[width:], owner[:-width] == owner[width:]
        loser = np.where(same, np.inf, np.maximum(best[:-width], best[width:]))
        rest = np.where(same, np.minimum(second[:-width], second[width:]), np.where(left, second[:-width], second[width:]))
        best, owner, second = np.minimum(best[:-width], best[width:]), np.where(left, owner[:-width], owner[width:]), np.minimum(loser, rest)
        width *= 2


def first_place(passes: Callable[[np.ndarray], np.ndarray], first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """For each row, the first place of first to stop from which on `passes` is true, by halves."""
    while (first < stop).any():
        middle = np.where(first < stop, (first + stop) // 2, 0)
        ok = passes(middle)
        first, stop = np.where((first < stop) & ~ok, middle + 1, first), np.where((first < stop) & ok, middle, stop)
    return first


def in_the_way(across: np.ndarray, along: np.ndarray, label: np.ndarray, wide: float, far: float, strip: float) -> np.ndarray:
    """Whether a point of another label is less than `wide` across, and further along, but by less than `far`.

    Points are sorted across in strips along, of half of `far` to all of it; of the own strip the furthest point counts, of the next two the nearest.
    """
    strips = np.floor(along / strip)
    order = np.lexsort((across, strips))
    a, b, s, own = across[order], along[order], strips[order], label[order]
    found = np.zeros(len(a), bool)
    for step in (0, 1, 2):
        begin, end = np.searchsorted(s, s + step, "left"), np.searchsorted(s, s + step, "right")
        first = first_place(lambda at: a[at] - a > -wide, begin, end)
        stop = first_place(lambda at: a[at] - a >= wide, first, end)
        found |= least_of_others(b, own, first, stop) - b < far if step else least_of_others(-b, own, first, stop) < -b
    out = np.empty_like(found)
    out[order] = found
    return out


class Labels:
    """Labels placed on one side, in cells of 2 by 4, so two in one cell always overlap.

    Of a cell's labels, only those count that are the nearest to one of its corners: no other is nearer both ways.
    """

    def __init__(self) -> None:
        self.cells: dict[tuple[int, int], dict[tuple[int, int], list[tuple[float, float]]]] = {}

    @staticmethod
    def cell(x: float, y: float) -> tuple[int, int]:
        return math.floor(x / 2), math.floor(y / 4)

    def add(self, x: float, y: float) -> None:
        corners = self.cells.setdefault(self.cell(x, y), {(1, 1): [], (1, -1): [], (-1, 1): [], (-1, -1): []})
        for (right, up), steps in corners.items():
            u, v = right * x, up * y
            n = bisect.bisect_right(steps, (u, math.inf))
            if n and steps[n - 1][1] <= v:
                continue
            n = last = bisect.bisect_left(steps, (u, -math.inf))
            while last < len(steps) and steps[last][1] >= v:
                last += 1
            steps[n:last] = [(u, v)]

    def overlap(self, x: float, y: float) -> bool:
        column, row = self.cell(x, y)
        if (column, row) in self.cells:
            return True
        for c, r in itertools.product(range(-2, 3), range(-2, 3)):
            if corners := self.cells.get((column + c, row + r)):
                right, up = 1 if c >= 0 else -1, 1 if r >= 0 else -1
                steps = corners[right, up]
                n = bisect.bisect_left(steps, True, key=lambda p, u=right * x: p[0] - u >= LABEL_COST)
                if n and steps[n - 1][1] - up * y < LABEL_SCORE:
                    return True
        return False


def placed(cost: np.ndarray, score: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The side (its number) of each label (by number): the first that is free of points and of labels placed before, else the top.

    Points are looked up for all at once, and labels one by one, each in logarithmic time however dense a plot is.
    """
    if not (np.isfinite(cost).all() and np.isfinite(score).all()):
        raise ValueError("a point without a place")
    up, aside = (POINT_ACROSS, POINT_UP, 4.0), (POINT_ACROSS, POINT_ASIDE, 2.0)
    taken = [in_the_way(cost, score, label, *up), in_the_way(cost, -score, label, *up), in_the_way(score, cost, label, *aside), in_the_way(score, -cost, label, *aside)]
    points, free, there = list(zip(cost.tolist(), score.tolist(), strict=True)), ~np.array(taken), [Labels() for _ in SIDES]
    # labels that go to the top as nothing is free matter only near a point whose top is
    tops = {Labels.cell(*points[i]) for i in np.flatnonzero(free[0])}
    near_tops = {(c + x, r + y) for c, r in tops for x in range(-2, 3) for y in range(-2, 3)}
    some, out = free.any(axis=0), np.zeros(len(points), np.int8)
    for i in sorted(range(len(points)), key=functools.cmp_to_key(lambda a, b: before(points[a], points[b]))):
        x, y = points[i]
        side = next((k for k in range(len(SIDES)) if free[k, i] and not there[k].overlap(x, y)), 0) if some[i] else 0
        if side or Labels.cell(x, y) in near_tops:
            there[side].add(x, y)
        out[i] = side
    return out


def placed_labels(points: list[tuple[float, float, str]]) -> list[str]:
    """The side of each label (cost, score, label)."""
    numbers: dict[str, int] = {}
    label = np.array([numbers.setdefault(p[2], len(numbers)) for p in points], np.int64)
    cost, score = (np.array([p[k] for p in points], np.float64) for k in (0, 1))
    return [SIDES[k] for k in placed(cost, score, label)]


def label_positions(points: DataFrame) -> DataFrame:
    """plot, label, position of every point (plot, label, cost, score): one plot is one task, as its labels go one by one."""

    def run(plot: pa.Table) -> pa.Table:
        plot = plot.sort_by([("label", "ascending"), ("cost", "ascending"), ("score", "ascending")])
        cost, score = (plot[c].fill_null(math.nan).to_numpy() for c in ("cost", "score"))
        side = placed(cost, score, pc.rank(plot["label"], tiebreaker="dense").to_numpy().astype(np.int64))
        return plot.select(["plot", "label"]).append_column("position", pa.array(SIDES).take(pa.array(side)))

    types = dict(points.dtypes)
    rows = points.select("plot", "label", F.col("cost").cast("double").alias("cost"), F.col("score").cast("double").alias("score"))
    return rows.groupBy("plot").applyInArrow(run, f"plot {types['plot']}, label {types['label']}, position string")


def config_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """name, change (added, removed, changed, same) between two sets of (name, config JSON)."""
    o, n = old.select("name", F.col("config").alias("old")), new.select("name", F.col("config").alias("new"))
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("changed")
    return o.withColumn("_o", F.lit(1)).join(n.withColumn("_n", F.lit(1)), "name", "full_outer").select("name", change.alias("change"))


def first_by_priority(items: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """One row a key: the first in the order. Overrides of commands, modes, skills and servers are this."""
    w = Window.partitionBy(key).orderBy(*order)
    return items.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def in_place_override(builtin: DataFrame, custom: DataFrame, key: str, position: str) -> DataFrame:
    """Custom rows replace built-in ones where those stand; new ones come after all."""
    b, c = builtin.alias("b"), custom.alias("c")
    cols = [x for x in builtin.columns if x not in (key, position)]
    last = F.lit(1 << 40)
    picked = [F.when(F.col(f"c.{key}").isNotNull(), F.col(f"c.{x}")).otherwise(F.col(f"b.{x}")).alias(x) for x in cols]
    out = b.join(c, F.col(f"b.{key}") == F.col(f"c.{key}"), "full_outer")
    return out.select(F.coalesce(f"b.{key}", f"c.{key}").alias(key), *picked, F.coalesce(F.col(f"b.{position}"), last + F.col(f"c.{position}")).alias(position))


def adjacent(posts: DataFrame, order: Sequence[Column], key: str) -> DataFrame:
    """Each post with the one before and after it in the order. One list of posts: a small table."""
    w = Window.orderBy(*order)
    return posts.withColumn("previous", F.lag(key).over(w)).withColumn("next", F.lead(key).over(w))


def page(rows: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """A page from 1, clamped to those there are."""
    pages = max(1, -(-rows.count() // size))
    return rows.orderBy(*order).offset((min(max(1, number), pages) - 1) * size).limit(size)


def daily_usage(events: DataFrame, at: str, tokens: str, cost: str) -> DataFrame:
    """date, tasks, tokens, cost a day, and a row with a null date for the totals. Days without events are not filled."""
    return events.rollup(F.to_date(at).alias("date")).agg(F.count("*").alias("tasks"), F.sum(tokens).alias("tokens"), F.round(F.sum(cost), 2).alias("cost"))
