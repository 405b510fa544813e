"""Streaming plans over event tables: sources, live state, debouncing, change application and sinks.

Event time and watermarks are this library's addition: the order of arrival is the `seq` of an event.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.operators.index import replace_files
from tarnfold.session import cut


def read_events(spark: SparkSession, path: str, schema: str, form: str = "json", files_per_batch: int = 100) -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.format(form).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)


def latest(events: DataFrame, key: str, *values: str, order: str = "seq") -> DataFrame:
    """The last values of each key: live state, for update or complete mode."""
    return events.groupBy(key).agg(F.max_by(F.struct(*values), order).alias("x")).select(key, "x.*")


def usage(events: DataFrame) -> DataFrame:
    """Token totals of a task: later events overwrite earlier ones."""
    return latest(events.where(F.col("event_name").isin("taskTokenUsageUpdated", "taskCompleted")), "task_id", "tokens_in", "tokens_out", "cost")


def tool_maxima(events: DataFrame) -> DataFrame:
    """Attempts and failures of a tool by maximum, so events may repeat."""
    each = events.select("task_id", F.explode("tool_usage").alias("tool", "u"))
    return each.groupBy("task_id", "tool").agg(F.max("u.attempts").alias("attempts"), F.max("u.failures").alias("failures"))


def debounce(changes: DataFrame, gap: str = "500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """One batch of changes a stretch without a gap, the last change of each path in it: path, event_type, event_ts."""
    return (
        changes.withWatermark("event_ts", late)
        .groupBy("path", F.session_window("event_ts", gap))
        .agg(F.max_by("event_type", "event_ts").alias("event_type"), F.max("event_ts").alias("event_ts"))
        .select("path", "event_type", "event_ts")
    )


def once_per_time(messages: DataFrame, late: str = "1 hour") -> DataFrame:
    """Whole messages, the first of each task and ts."""
    return messages.where(~F.coalesce("partial", F.lit(False))).withWatermark("event_ts", late).dropDuplicatesWithinWatermark(["task_id", "ts"])


def alive(beats: DataFrame, ttl: str = "10 seconds", now=None) -> DataFrame:
    """Runners whose last beat is not older than their time to live."""
    seen = beats.groupBy("run_id", "runner").agg(F.max("event_ts").alias("seen"))
    return seen.where(F.col("seen") + F.expr(f"INTERVAL {ttl}") >= (F.current_timestamp() if now is None else F.lit(now)))


def last_states(log: DataFrame, most: int) -> DataFrame:
    """The newest states of a key, as many as kept."""
    from pyspark.sql import Window

    w = Window.partitionBy("key").orderBy(F.desc("seq"))
    return log.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def apply_changes(read: Callable[[], DataFrame], write: Callable[[DataFrame], None], chunk: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: points of deleted and changed files go, points of created and changed ones come, whole files at a time.

    read and write give and take the table of points; write must not overwrite what read still reads from.
    """

    def run(batch: DataFrame, _: int) -> None:
        last = batch.groupBy("path").agg(F.max_by(F.struct("event_type", "content"), "seq").alias("x")).select("path", "x.*")
        write(replace_files(read(), last, chunk(last.where("event_type <> 'delete'"))))

    return run


def feed(store, chunk: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """The same for a store whose replace_files(paths, new) takes both at once, in one version: only what the files of a
    batch touch is written."""

    def run(batch: DataFrame, _: int) -> None:
        last = cut(batch.groupBy("path").agg(F.max_by(F.struct("event_type", "content"), "seq").alias("x")).select("path", "x.*"))
        store.replace_files(last.select("path"), chunk(last.where("event_type <> 'delete'")))

    return run


def spill_to(folder: str, key: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over what folds.spilling() gives: what is to be written goes to files folder/key/at, one a key and batch.

    A batch that is done again writes the same files again, so after a restart all bytes are there once.
    """

    def write(group: tuple, t: pa.Table) -> pa.Table:
        fs, base = (pafs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")) if folder.startswith("file:") or "://" not in folder else pafs.FileSystem.from_uri(folder)
        t = t.sort_by("at")
        name, data = f"{base}/{quote(str(group[0].as_py()), safe='')}", "".join(t["data"].to_pylist()).encode()
        fs.create_dir(name, recursive=True)
        with fs.open_output_stream(f"{name}/{t['at'][0].as_py():015d}") as out:
            out.write(data)
        return pa.table({"bytes": [len(data)]})

    def run(batch: DataFrame, _: int) -> None:
        rows = batch.where("data IS NOT NULL").select(F.col(key).cast("string").alias("key"), "at", "data")
        rows.groupBy("key").applyInArrow(write, "bytes long").write.format("noop").mode("overwrite").save()

    return run


def spilled(spark: SparkSession, folder: str) -> DataFrame:
    """key, at, content of all files that spill_to() has written; a key's stream is its contents in the order of at."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    part = lambda i: F.element_at(F.split("path", "/"), i)
    return files.select(F.url_decode(F.url_decode(part(-2))).alias("key"), part(-1).cast("long").alias("at"), "content")


def to_json(events: DataFrame, path: str, checkpoint: str, leave_out: tuple[str, ...] = ("message",)):
    """A stream of events as JSON lines, without events of some names."""
    kept = events.where(~F.col("event_name").isin(list(leave_out)))
    return kept.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
