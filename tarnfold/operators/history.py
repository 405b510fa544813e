"""Task history: keyed stores, reconciliation, search, subtask trees and their costs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfold.operators import trees


def merge_rows(rows: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Shallow merge: fields of changes that are there win; `_present` (array of names), if there, also lets nulls win."""
    cols = [c for c in rows.columns if c != key]
    a, b = rows.alias("a"), changes.alias("b")
    has = "_present" in changes.columns
    pick = lambda c: F.when(F.array_contains("b._present", c), F.col(f"b.{c}")).otherwise(F.coalesce(f"b.{c}", f"a.{c}")) if has else F.coalesce(f"b.{c}", f"a.{c}")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    return joined.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *[(pick(c) if c in changes.columns else F.col(f"a.{c}")).alias(c) for c in cols])


def reconcile(stored: DataFrame, disk: DataFrame, key: str = "id") -> DataFrame:
    """What is on disk: stored rows of it, and disk rows that were not stored. Stored rows without a place on disk go."""
    return stored.join(disk, key, "left_semi").unionByName(disk.join(stored, key, "left_anti"), allowMissingColumns=True)


def migrate(stored: DataFrame, old: DataFrame, folders: DataFrame, key: str = "id") -> DataFrame:
    """Old rows that have a folder and are not stored yet are added."""
    return stored.unionByName(old.join(folders, key, "left_semi").join(stored, key, "left_anti").select(stored.columns))


def sessions(index: DataFrame, task_rows: DataFrame, folders: DataFrame) -> DataFrame:
    """Rows of the index, and of task files that it lacks, with a folder; newest first."""
    rows = index.unionByName(task_rows.join(index, "id", "left_anti"), allowMissingColumns=True)
    return rows.join(folders, "id", "left_semi").orderBy(F.desc("ts"), "id")


def of_workspace(rows: DataFrame, workspace: str | None) -> DataFrame:
    """Rows with a time and a task; of one workspace, if named."""
    out = rows.where((F.coalesce(F.col("ts"), F.lit(0)) != 0) & (F.coalesce("task", F.lit("")) != ""))
    return out.where(F.col("workspace") == workspace) if workspace is not None else out


def order_of(how: str) -> list[Column]:
    tokens = sum((F.coalesce(F.col(c), F.lit(0)) for c in ("tokens_in", "tokens_out", "cache_writes", "cache_reads")), F.lit(0))
    keys = {"newest": [F.desc("ts")], "oldest": [F.asc("ts")], "mostExpensive": [F.coalesce("total_cost", F.lit(0.0)).desc()], "mostTokens": [tokens.desc()], "mostRelevant": [F.desc("score"), F.desc("ts")]}
    return [*keys[how], F.col("id")]


def recent(rows: DataFrame, now: datetime, many: int = 100, days: int = 7) -> DataFrame:
    """With `many` rows or more within the last days, all of those; else the newest `many`."""
    new = rows.where(F.col("ts") >= int(now.timestamp() * 1000) - days * 86_400_000)
    return (new if new.count() >= many else rows.orderBy(F.desc("ts"), "id").limit(many)).orderBy(F.desc("ts"), "id")


def groups(rows: DataFrame) -> DataFrame:
    """Roots with their direct subtasks, newest first: id, subtasks. A row whose parent is not there is a root."""
    ids = rows.select(F.col("id").alias("parent_task_id")).distinct()
    child = rows.join(ids, "parent_task_id", "left_semi")
    lists = child.groupBy("parent_task_id").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("ts")).alias("t"), "id"))), lambda x: x["id"]).alias("subtasks"))
    roots = rows.join(child.select("id"), "id", "left_anti")
    return roots.select("id", "ts").join(lists, F.col("id") == F.col("parent_task_id"), "left").select("id", "ts", F.coalesce("subtasks", F.array().cast("array<string>")).alias("subtasks"))


def tree_costs(rows: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """root, own, children, total, n_subtasks: costs of a task and all below it; what is not in rows costs 0."""
    out = trees.totals(rows, edges, roots, F.col("total_cost"))
    return out.select("root", "own", (F.col("total") - F.col("own")).alias("children"), "total", (F.col("nodes") - 1).alias("n_subtasks"))


def file_records(log: DataFrame) -> DataFrame:
    """A context log (path, seq, three dates): the last entry of a path is active, earlier ones stale; dates carry the latest so far."""
    w = Window.partitionBy("path").orderBy("seq")
    dates = [c for c in log.columns if c.endswith("_date")]
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("record_state", F.when(F.lead("seq").over(w).isNull(), "active").otherwise("stale")).withColumns({c: F.max(c).over(run) for c in dates})


def files_read(log: DataFrame, read_date: str) -> DataFrame:
    """Paths once, the most recently read first."""
    return log.where(F.col(read_date).isNotNull()).groupBy("path").agg(F.max(read_date).alias("last_read")).orderBy(F.desc("last_read"), "path")


def append_child(rows: DataFrame, new: DataFrame) -> DataFrame:
    """child_ids with a further id, once. new: id, child."""
    return rows.join(new, "id", "left").withColumn("child_ids", F.when(F.col("child").isNull(), F.col("child_ids")).otherwise(F.array_union(F.coalesce("child_ids", F.array().cast("array<string>")), F.array("child")))).drop("child")
