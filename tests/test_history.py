from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from tarnfold.operators import evals, history
from tarnfold.sources import files


def costs(spark, rows, edges, root):
    r = spark.createDataFrame(rows, "id string, total_cost double")
    e = spark.createDataFrame(edges, "parent string, child string")
    return history.tree_costs(r, e, spark.createDataFrame([(root,)], "id string")).first()


def test_tree_costs(spark):
    c = costs(spark, [("p", 1.0), ("c", 0.5), ("g", 0.25)], [("p", "c"), ("c", "g")], "p")
    assert (c.own, c.children, c.total, c.n_subtasks) == (1.0, 0.75, 1.75, 2)
    c = costs(spark, [("a", 1.0), ("b", 0.5)], [("a", "b"), ("b", "a")], "a")
    assert (c.children, c.total) == (0.5, 1.5)
    assert costs(spark, [("p", 1.0)], [("p", "nonexistent")], "p").total == 1.0
    c = costs(spark, [("r", 2.5), ("x", 1.2), ("x1", 0.3), ("x2", 0.15), ("y", 0.8)], [("r", "x"), ("x", "x1"), ("x", "x2"), ("r", "y")], "r")
    assert round(c.children, 9) == 2.45 and round(c.total, 9) == 4.95
    c = costs(spark, [("p", 1.0), ("a", 0.5), ("b", 0.3), ("n", 0.1)], [("p", "a"), ("p", "b"), ("a", "n"), ("b", "n")], "p")
    assert round(c.total, 9) == 2.0
    assert costs(spark, [("a", None)], [("zz", "a")], "missing").total == 0.0


def test_groups(spark):
    rows = spark.createDataFrame([("parent-1", 12, None), ("child-1", 13, "parent-1"), ("child-2", 14, "parent-1"), ("orphan", 1, "gone")], "id string, ts long, parent_task_id string")
    assert {r.id: r.subtasks for r in history.groups(rows).collect()} == {"parent-1": ["child-2", "child-1"], "orphan": []}


def test_recent_and_search(spark):
    now = datetime(2024, 1, 10, tzinfo=UTC)
    ms = int(now.timestamp() * 1000)
    rows = spark.createDataFrame([(f"{i}", ms - i * 3_600_000, "t", "w") for i in range(300)], "id string, ts long, task string, workspace string")
    assert history.recent(rows, now).count() == 169  # 7 days of hours, both ends
    assert history.recent(rows.where("ts < 1") .union(rows.limit(3)), now).count() == 3
    assert history.of_workspace(rows.union(spark.createDataFrame([("x", 0, "t", "w"), ("y", 5, "", "w")], rows.schema)), "w").count() == 300


def test_merge_with_presence(spark):
    rows = spark.createDataFrame([("a", "x", 1)], "id string, task string, n int")
    changes = spark.createDataFrame([("a", None, 2, ["task", "n"]), ("b", "new", None, ["task"])], "id string, task string, n int, _present array<string>")
    assert sorted(map(tuple, history.merge_rows(rows, changes).collect())) == [("a", None, 2), ("b", "new", None)]


RUNS = "id int, task_metrics_id int, model string"
TASKS = "id int, run_id int, task_metrics_id int, passed boolean"
METRICS = "id int, cost float"
ERRORS = "id int, run_id int, task_id int, error string"


@pytest.fixture
def warehouse(spark):
    make = spark.createDataFrame
    return (
        make([(1, 10, "m"), (2, None, "n")], RUNS), make([(1, 1, 11, True), (2, 1, None, None), (3, 2, 12, False)], TASKS),
        make([(10, 0.1), (11, 0.2), (12, 0.3), (13, 0.4)], METRICS), make([(1, 1, 1, "e"), (2, 1, None, "f"), (3, 2, 3, "g"), (4, None, 1, "h")], ERRORS),
    )


def test_delete_and_copy(spark, warehouse):
    left = files.delete_runs(*warehouse, spark.createDataFrame([(1,)], "id int"))
    assert {k: sorted(r.id for r in v.collect()) for k, v in left.items()} == {"runs": [2], "tasks": [3], "metrics": [12, 13], "errors": [3]}
    assert files.delete_runs(*warehouse, spark.createDataFrame([], "id int"))["runs"].count() == 2
    new = files.copy_run(*warehouse, 1, {"run": 100, "task": 200, "metrics": 300})
    run, tasks = new["runs"].first(), new["tasks"].orderBy("id").collect()
    assert (run.id, run.model, run.task_metrics_id) == (101, "m", 301)
    assert [(t.id, t.run_id, t.task_metrics_id, t.passed) for t in tasks] == [(201, 101, 302, True), (202, 101, None, None)]
    assert sorted((r.id, round(r.cost, 3)) for r in new["metrics"].collect()) == [(301, 0.1), (302, 0.2)]
    assert sorted((r.run_id, r.task_id, r.error) for r in new["errors"].collect() if r.task_id) == [(101, 201, "e")] and new["errors"].count() == 2
    with pytest.raises(files.RecordNotFound):
        files.copy_run(*warehouse, 9, {"run": 1, "task": 1, "metrics": 1})


def test_keyed_writes(spark, warehouse, tmp_path):
    runs = warehouse[0]
    out = files.update(runs, spark.createDataFrame([(1, "z")], "id int, model string"))
    assert {r.id: r.model for r in out.collect()} == {1: "z", 2: "n"}
    with pytest.raises(files.RecordNotFound):
        files.update(runs, spark.createDataFrame([(7, "z")], "id int, model string"))
    assert files.find_first(runs, id=2).model == "n"
    with pytest.raises(files.RecordNotFound):
        files.find_first(runs, id=3)
    ids = files.with_ids(spark.range(50).withColumnRenamed("id", "k").repartition(3), 100, ["k"])
    assert sorted((r.k, r.id) for r in ids.collect()) == [(i, 101 + i) for i in range(50)]
    t = files.VersionedTable(spark, str(tmp_path / "t"))
    for n in range(4):
        t.write(spark.range(n))
    assert t.read().count() == 3 and len(t.versions()) == 2


def test_finish_run(spark):
    tasks = spark.createDataFrame([(1, 1, True), (2, 1, True), (3, 1, None), (4, 1, False)], "id int, run_id int, passed boolean")
    m = [(1, 100_000, 2000, 102_000, 0.05, 45_000, {"read_file": (3, 0), "apply_diff": (3, 1)}), (2, 75_000, 1000, 76_000, 0.04, 30_000, {"read_file": (3, 0), "apply_diff": (2, 0)}), (3, 0, 0, 0, 0.0, 0, None)]
    metrics = spark.createDataFrame(m, "task_id int, tokens_in int, tokens_out int, tokens_context int, cost double, duration int, tool_usage map<string,struct<attempts:bigint,failures:bigint>>")
    r = evals.finish_run(tasks, metrics).first()
    assert (r.tokens_in, r.tokens_out, r.tokens_context, round(r.cost, 6), r.duration, r.passed, r.failed) == (175_000, 3000, 178_000, 0.09, 75_000, 2, 1)
    got = {x.tool: (x.attempts, x.failures) for x in evals.tool_usage(tasks, metrics).collect()}
    assert got == {"read_file": (6, 0), "apply_diff": (5, 1)}
    scores = {(x.run_id, x.language): x.score for x in evals.language_scores(tasks.withColumn("language", F.lit("go"))).collect()}
    assert scores == {(1, "go"): 0.5}
    stats = evals.run_stats(tasks).first()
    assert (stats.passed, stats.failed, stats.completed, stats.remaining, stats.pass_rate) == (2, 1, 3, 1, 66.7)


def test_errors_without_a_run_or_task_are_dealt_over_all_tasks(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        runs = spark.range(8).selectExpr("id", "id AS task_metrics_id")
        tasks = spark.range(8).selectExpr("id", "id AS run_id", "id AS task_metrics_id")
        errors = spark.range(8000).selectExpr("id", "CASE WHEN id < 8 THEN id END AS run_id", "CASE WHEN id BETWEEN 8 AND 15 THEN id - 8 END AS task_id")
        left = files.delete_runs(runs, tasks, spark.range(8), errors, spark.createDataFrame([(1,), (3,)], "id long"))["errors"]
        dealt = [r["count"] for r in left.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(dealt) == 7996 and max(dealt) < 4000
        assert sorted(r["id"] for r in left.where("id < 16").collect()) == [x for x in range(16) if x not in (1, 3, 9, 11)]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
