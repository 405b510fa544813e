"""Tools, telemetry, file changes, budgets and the vector store's interface."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnfold.operators import index
from tarnfold.sources.buckets import BucketedTable
from tarnfold.sources.files import RecordNotFound, VersionedTable


@dataclass
class CustomTool:
    """A function from a row's value to a string, with a description and parameters."""

    name: str
    description: str
    execute: Callable[..., str]
    parameters: dict[str, str] = field(default_factory=dict)


class ToolRegistry:
    """Custom tools by name; later ones override earlier ones; what is no tool is told apart with its errors."""

    def __init__(self) -> None:
        self.tools: dict[str, CustomTool] = {}
        self.errors: dict[str, list[str]] = {}

    def register(self, tool: CustomTool) -> bool:
        problems = []
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_-]*", tool.name or ""):
            problems.append("name")
        if not tool.description:
            problems.append("description")
        if not callable(tool.execute):
            problems.append("execute")
        if problems:
            self.errors[str(tool.name)] = problems
            return False
        self.tools[tool.name] = tool
        return True

    def unregister(self, name: str) -> bool:
        return self.tools.pop(name, None) is not None

    def listing(self, spark: SparkSession) -> DataFrame:
        rows = [(t.name, t.description, t.parameters) for t in sorted(self.tools.values(), key=lambda t: t.name)]
        return spark.createDataFrame(rows, "name string, description string, parameters map<string,string>")

    def function(self, name: str) -> Callable[[Column], Column]:
        """The tool as a function over a column of strings, batch by batch."""
        execute = self.tools[name].execute

        @F.pandas_udf("string")
        def run(s: pd.Series) -> pd.Series:
            return s.map(lambda x: str(execute(x)), na_action="ignore")

        return run

    def to_sql(self, spark: SparkSession) -> None:
        """Every tool as a function of the session's SQL."""
        for name in self.tools:
            spark.udf.register(name, self.function(name))


def allowed_tools(groups: Column, included: Column, excluded: Column, disabled: Column) -> Column:
    """Tools of the mode's groups and those included, without those excluded or disabled, sorted."""
    return F.array_sort(F.array_except(F.array_except(F.array_union(groups, included), excluded), disabled))


def telemetry(events: DataFrame, include: Sequence[str] | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    """Events that a subscription takes: those included, or all but those excluded."""
    return events.where(F.col("event_name").isin(list(include))) if include is not None else events.where(~F.col("event_name").isin(list(exclude)))


def merged_properties(provider: Column, event: Column, left_out: Sequence[str] = ()) -> Column:
    """A provider's properties with the event's over them, without some keys."""
    both = F.map_concat(F.map_filter(provider, lambda k, _: ~F.array_contains(F.map_keys(event), k)), event)
    return F.map_filter(both, lambda k, _: ~k.isin(list(left_out))) if left_out else both


CHANGE = "tool string, path string, added int, removed int, batchDiffs array<struct<path:string,added:int,removed:int>>"
EDITS = ["editedExistingFile", "appliedDiff", "newFileCreated"]


def file_changes(log: DataFrame) -> DataFrame:
    """task_id, seq, path, added, removed of approved, whole edit messages (JSON in text); batches one row a file."""
    whole = log.where(F.coalesce(F.col("is_answered"), F.lit(False)) & ~F.coalesce(F.col("partial"), F.lit(False)))
    parsed = whole.withColumn("c", F.from_json("text", CHANGE)).where(F.col("c.tool").isin(EDITS))
    own = F.array(F.struct(F.col("c.path").alias("path"), F.col("c.added").alias("added"), F.col("c.removed").alias("removed")))
    each = parsed.select("task_id", "seq", F.explode(F.coalesce("c.batchDiffs", own)).alias("x"))
    return each.select("task_id", "seq", "x.path", F.coalesce("x.added", F.lit(0)).alias("added"), F.coalesce("x.removed", F.lit(0)).alias("removed")).where("path is not null")


def change_totals(changes: DataFrame) -> DataFrame:
    """path, added, removed by path, and with a null path over all."""
    return changes.rollup("path").agg(F.sum("added").alias("added"), F.sum("removed").alias("removed"))


def queue_stats(queue: DataFrame) -> DataFrame:
    """Size, times, retries and errors of queued requests, and the number of each type as a map."""
    per = queue.groupBy("type").agg(F.count("*").alias("n"), F.min("ts").alias("oldest"), F.max("ts").alias("newest"), F.sum("retries").alias("retries"), F.count("last_error").alias("with_error"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long"))
    by_type = F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n"))))
    return per.agg(total("n").alias("size"), F.min("oldest").alias("oldest"), F.max("newest").alias("newest"), total("retries").alias("retries"), total("with_error").alias("with_error"), by_type.alias("by_type"))


def restore_checkpoints(rewound: DataFrame, saved: DataFrame) -> DataFrame:
    """Rows with the checkpoint that was saved for their task and ts, where they have none."""
    s = saved.select("task_id", "ts", F.col("checkpoint").alias("_saved"))
    return rewound.join(s, ["task_id", "ts"], "left").withColumn("checkpoint", F.coalesce("checkpoint", "_saved")).select(rewound.columns)


def character_budget(parts: DataFrame, budget: int = 50_000, least: int = 200) -> DataFrame:
    """Parts of a task in order while they fit; the one that does not is cut if `least` characters or more are left."""
    w = Window.partitionBy("task_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    left = budget - F.coalesce(F.sum(F.length("text")).over(w), F.lit(0))
    rows = parts.withColumn("_left", left).where((F.length("text") <= F.col("_left")) | (F.col("_left") >= least))
    return rows.withColumn("text", F.when(F.length("text") > F.col("_left"), F.left("text", F.col("_left").cast("int"))).otherwise(F.col("text"))).drop("_left")


def number_hunks(lines: DataFrame) -> DataFrame:
    """Lines (path, seq, line) of unified diffs with old_no and new_no from their hunk's header."""
    head = r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@"
    w = Window.partitionBy("path").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("_head", F.col("line").rlike(head)).withColumn("_hunk", F.sum(F.col("_head").cast("int")).over(w))
    h = Window.partitionBy("path", "_hunk").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    start = lambda i: F.first(F.when(F.col("_head"), F.regexp_extract("line", head, i).cast("int")), ignorenulls=True).over(h)
    count = lambda sign: F.sum((~F.col("_head") & ~F.col("line").startswith(sign)).cast("int")).over(h)
    numbered = rows.where("_hunk > 0").withColumn("_o", start(1) + count("+") - 1).withColumn("_n", start(2) + count("-") - 1).where("not _head")
    return numbered.select("path", "seq", "line", F.when(~F.col("line").startswith("+"), F.col("_o")).alias("old_no"), F.when(~F.col("line").startswith("-"), F.col("_n")).alias("new_no"))


def definitions(captures: DataFrame, least_lines: int = 4) -> DataFrame:
    """Captures (path, start, end, text) as a listing: each stretch once, long enough, by first line."""
    w = Window.partitionBy("path", "start", "end").orderBy(F.length("text"), "text")
    kept = captures.where(F.col("end") - F.col("start") + 1 >= least_lines).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return kept.orderBy("path", "start", "end")


def natural_key(path: Column) -> Column:
    """A sort key in which numbers inside a path compare by value."""
    padded = F.regexp_replace(F.lower(path), r"(\d+)", "000000000000000000$1")
    return F.regexp_replace(padded, r"0+(\d{18})(?!\d)", "$1")


def token_counter(ranks_path: str, pattern: str, factor: float = 1.5):
    """A column function: ids of a byte-pair vocabulary file times a factor, up. Files have base64 tokens and ranks."""

    @F.pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        import base64
        import math

        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("counter", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return s.map(lambda t: math.ceil(len(enc.encode_ordinary(t)) * factor), na_action="ignore").astype("Int64")

    return run


class VectorStore:
    """Points (id, path, start_line, end_line, content, segment_hash, embedding) in a table bucketed by path: a write makes
    new files for the buckets of the paths that it touches, and of no others."""

    COLUMNS = "id string, path string, start_line int, end_line int, content string, segment_hash string, embedding array<float>"

    def __init__(self, spark: SparkSession, folder: str, dims: int):
        self.spark, self.dims = spark, dims
        self.table, self.state = BucketedTable(spark, f"{folder}/points", "id", "path"), VersionedTable(spark, f"{folder}/state")

    def initialize(self) -> bool:
        """Make the table, or anew if its vectors have another length; whether it is new."""
        try:
            row = self.table.read().select(F.size("embedding").alias("n")).limit(1).collect()
            if not row or row[0]["n"] == self.dims:
                return False
        except RecordNotFound:
            pass
        self.clear()
        return True

    def clear(self) -> None:
        self.table.write(self.spark.createDataFrame([], self.COLUMNS))
        self.mark(False)

    def upsert(self, points: DataFrame) -> None:
        self.table.upsert(points)

    def delete_paths(self, paths: DataFrame) -> None:
        """Points of just these files, not of files below such a path."""
        self.table.delete(paths, "path")

    def replace_files(self, paths: DataFrame, new: DataFrame) -> None:
        """All points of the given paths go and new ones come, in one version: what a change feed does."""
        self.table.change(paths.select("path").union(new.select("path")), lambda rows: index.replace_files(rows, paths, new.select(rows.columns)))

    def search(self, vector: Sequence[float], k: int = 50, least: float = 0.4, prefix: str | None = None) -> DataFrame:
        from tarnfold.operators.search import has_prefix

        points = self.table.read().where("path is not null and content is not null and start_line is not null and end_line is not null")
        return index.vector_search(points, vector, k, least, has_prefix(F.col("path"), prefix) if prefix else None)

    def mark(self, complete: bool) -> None:
        self.state.write(self.spark.createDataFrame([(complete,)], "complete boolean"))

    def has_data(self) -> bool:
        """Whether an index was completed; for one without a state, whether it has points."""
        try:
            return bool(self.state.read().first()["complete"])
        except RecordNotFound:
            return not self.table.read().isEmpty()
