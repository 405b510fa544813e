"""Readers and writers: tables, JSON rows and logs, file listings, documents, and keyed writes."""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnfold.session import cut


class RecordNotFound(LookupError):
    """A point lookup found no row."""


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def jdbc(spark: SparkSession, url: str, name: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16, **options: str) -> DataFrame:
    """A database table, in ranges of a key if its bounds are given."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return reader.load()


def find_first(df: DataFrame, **values):
    """The first row with these values, or RecordNotFound."""
    for k, v in values.items():
        df = df.where(F.col(k) == F.lit(v))
    row = df.limit(1).collect()
    if not row:
        raise RecordNotFound(str(values))
    return row[0]


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; rows that cannot be read are left out."""
    parsed = F.from_json("value", schema + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    return spark.read.text(path).where("trim(value) <> ''").select(parsed.alias("x")).select("x.*").where("_corrupt is null").drop("_corrupt")


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that are a JSON array each, with seq, the place in it; a file that is none gives no rows."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    parsed = text.select("file", F.from_json("value", f"array<struct<{schema}>>").alias("x"))
    return parsed.select("file", F.posexplode("x").alias("seq", "x")).select("file", "seq", "x.*")


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, size, modified of all files under a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def folder_size(spark: SparkSession, path: str) -> int:
    return list_files(spark, path).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]


def read_lines(files: DataFrame, first: int = 0, last: int | None = None) -> DataFrame:
    """path, line_no (from 0), line of the rows first to last, both included."""
    if first < 0 or last is not None and last < first:
        raise ValueError(f"no range of lines: {first} to {last}")
    rows = files.select("path", F.posexplode(F.split("content", "\n")).alias("line_no", "line")).where(F.col("line_no") >= first)
    return rows if last is None else rows.where(F.col("line_no") <= last)


def notebook_text(content: str) -> str:
    """Markdown and code cells of a notebook."""
    cells = json.loads(content).get("cells", [])
    own = ["".join(c["source"]) if isinstance(c["source"], list) else c["source"] for c in cells if c.get("cell_type") in ("markdown", "code") and c.get("source")]
    return "\n".join(own) + "\n" * bool(own)


def sheet_text(content: bytes, rows_max: int = 50_000) -> str:
    """Visible sheets as lines of tab-separated cells; needs openpyxl."""
    try:
        import openpyxl
    except ImportError as e:
        raise RuntimeError("reading spreadsheets needs openpyxl") from e
    out = []
    for sheet in openpyxl.load_workbook(io.BytesIO(content), data_only=True).worksheets:
        if sheet.sheet_state == "visible":
            out.append(f"--- Sheet: {sheet.title} ---")
            for n, row in enumerate(sheet.iter_rows(values_only=True)):
                if n == rows_max:
                    out.append(f"[... truncated at row {n} ...]")
                    break
                out.append("\t".join("" if v is None else v.isoformat()[:10] if hasattr(v, "isoformat") else str(v) for v in row).rstrip("\t"))
    return "\n".join(out)


def document_text(content: bytes) -> str:
    """Paragraphs of a word processor's document: the text runs of its XML."""
    import zipfile
    from xml.etree import ElementTree

    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(f"{w}t")) for p in root.iter(f"{w}p"))


def extract(path: str, content: bytes, lines_max: int) -> tuple[str | None, int, int, bool, str | None]:
    """text, total lines, shown lines, truncated, error."""
    try:
        if path.endswith(".ipynb"):
            text = notebook_text(content.decode())
        elif path.endswith(".xlsx"):
            text = sheet_text(content)
        elif path.endswith(".docx"):
            text = document_text(content)
        elif b"\0" in content[:8192]:
            return None, 0, 0, False, "binary file"
        else:
            text = content.decode(errors="replace")
    except (ValueError, RuntimeError, KeyError, OSError, SyntaxError) as e:
        return None, 0, 0, False, str(e)
    rows = text.split("\n")
    return "\n".join(rows[:lines_max]), len(rows), min(len(rows), lines_max), len(rows) > lines_max, None


def extract_text(spark: SparkSession, path: str, lines_max: int = 2000, glob: str = "*") -> DataFrame:
    """path, text, total_lines, shown_lines, truncated, error of all files under a folder; what cannot be read has an error."""
    schema = "path string, text string, total_lines int, shown_lines int, truncated boolean, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *extract(p, bytes(c), lines_max)) for p, c in zip(b["path"], b["content"], strict=True)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", "content").mapInPandas(run, schema)


def posts(spark: SparkSession, path: str, fields: Sequence[str]) -> DataFrame:
    """Markdown files with front matter: the fields and body; two posts of one slug are an error."""
    text = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True)
    front = F.regexp_extract("value", r"(?s)\A---\n(.*?)\n---\n", 1)
    one = lambda f: F.nullif(F.regexp_extract(front, rf"(?m)^{f}:\s*[\"']?(.*?)[\"']?\s*$", 1), F.lit(""))
    out = text.select(*[one(f).alias(f) for f in fields], F.regexp_replace("value", r"(?s)\A---\n.*?\n---\n", "").alias("body"))
    if "slug" in fields and (twice := out.groupBy("slug").count().where("count > 1").limit(1).collect()):
        raise ValueError(f"two posts have the slug {twice[0]['slug']}")
    return out


def with_ids(rows: DataFrame, after: int, order: Sequence[str], key: str = "id") -> DataFrame:
    """Rows with new ids after the last one, in an order, without one task for all: a number in each partition of a
    sorted range, on top of the partitions before."""
    spark = rows.sparkSession
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    ordered = cut(ordered.withColumn("_n", F.monotonically_increasing_id() - F.shiftleft(F.col("_p").cast("long"), 33)))
    base, bases = after, []
    for r in ordered.groupBy("_p").count().orderBy("_p").collect():  # a row a partition
        bases.append((r["_p"], base))
        base += r["count"]
    return ordered.join(F.broadcast(spark.createDataFrame(bases, "_p int, _base long")), "_p").withColumn(key, F.col("_base") + F.col("_n") + 1).drop("_p", "_n", "_base")


def update(rows: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Partial update: what changes has and is not null wins. A change without a row is an error."""
    if missing := changes.join(rows, key, "left_anti").limit(1).collect():
        raise RecordNotFound(f"{key} = {missing[0][key]}")
    new = changes.select(key, *[F.col(c).alias(f"_{c}") for c in changes.columns if c != key])
    out = rows.join(new, key, "left")
    return out.select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if f"_{c}" in out.columns else F.col(c) for c in rows.columns])


def without(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose column is none of the keys. Null is no key: such rows go by their id, so they are not all in one task."""
    own = keys.select(F.col(column).alias("_key"))
    return rows.join(own, F.col(column).isNotNull() & (F.coalesce(column, "id") == F.col("_key")), "left_anti")


def delete_runs(runs: DataFrame, tasks: DataFrame, metrics: DataFrame, errors: DataFrame, ids: DataFrame) -> dict[str, DataFrame]:
    """The four tables without some runs (ids: id) and all that belongs to them."""
    gone = ids.select(F.col("id").alias("run_id")).distinct()
    own = tasks.join(gone, "run_id", "left_semi")
    used = own.select(F.col("task_metrics_id").alias("id")).union(runs.join(ids, "id", "left_semi").select(F.col("task_metrics_id").alias("id"))).where("id is not null").distinct()
    of_task = own.select(F.col("id").alias("task_id"))
    return {
        "runs": runs.join(ids, "id", "left_anti"),
        "tasks": without(tasks, gone, "run_id"),
        "metrics": metrics.join(used, "id", "left_anti"),
        "errors": without(without(errors, gone, "run_id"), of_task, "task_id"),
    }


def copy_run(runs: DataFrame, tasks: DataFrame, metrics: DataFrame, errors: DataFrame, run_id: int, next_ids: dict[str, int]) -> dict[str, DataFrame]:
    """Rows of a run's deep copy, with new ids after those given and every reference moved to them. All columns are copied."""
    run = runs.where(F.col("id") == run_id)
    if run.isEmpty():
        raise RecordNotFound(f"run {run_id}")
    own = tasks.where(F.col("run_id") == run_id)
    ids = lambda df, kind: df.select("id").distinct().withColumn(f"new_{kind}", (F.row_number().over(Window.orderBy("id")) + next_ids[kind]).cast("int")).withColumnRenamed("id", f"old_{kind}")  # noqa: E731  of one run
    used = own.select(F.col("task_metrics_id").alias("id")).union(run.select(F.col("task_metrics_id").alias("id"))).where("id is not null")
    m, t, r = ids(used, "metrics"), ids(own, "task"), F.lit(next_ids["run"] + 1)

    def move(df: DataFrame, column: str, names: DataFrame, kind: str) -> DataFrame:
        return df.join(names, df[column] == names[f"old_{kind}"], "left").withColumn(column, F.col(f"new_{kind}")).drop(f"old_{kind}", f"new_{kind}")

    mine = errors.where(F.col("run_id") == run_id)
    return {
        "runs": move(run.withColumn("id", r), "task_metrics_id", m, "metrics").select(runs.columns),
        "tasks": move(move(own.withColumn("run_id", r), "task_metrics_id", m, "metrics"), "id", t, "task").select(tasks.columns),
        "metrics": move(metrics.join(m.select(F.col("old_metrics").alias("id")), "id", "left_semi"), "id", m, "metrics").select(metrics.columns),
        "errors": move(mine.withColumn("run_id", r), "task_id", t, "task").select(errors.columns),
    }


def failed_logs(tasks: DataFrame, logs: DataFrame) -> DataFrame:
    """Log files of tasks that did not pass (null is not a failure); none at all is an error."""
    out = tasks.where(~F.col("passed")).join(logs, ["language", "exercise", "iteration"])
    if out.isEmpty():
        raise RecordNotFound("no logs of failed tasks")
    return out


class VersionedTable:
    """A table of Parquet versions in one folder: a write claims a new version; readers see the last whole one.

    Of two writers at the same time that want the same version, one gets it, and the other fails.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        jvm = spark.sparkContext._jvm
        self.folder = jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs = self.folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.join = lambda name: jvm.org.apache.hadoop.fs.Path(self.folder, name)

    def versions(self) -> list[int]:
        if not self.fs.exists(self.folder):
            return []
        return sorted(int(s.getPath().getName()[1:]) for s in self.fs.listStatus(self.folder) if s.getPath().getName().startswith("v") and self.fs.exists(self.join(s.getPath().getName() + "/_SUCCESS")))

    def read(self) -> DataFrame:
        v = self.versions()
        if not v:
            raise RecordNotFound(self.path)
        return self.spark.read.parquet(f"{self.path}/v{v[-1]}")

    def write(self, df: DataFrame) -> None:
        """A version counts once Spark's committer has marked it as complete. A claim stays, so a failed write's number is not used again."""
        names = [s.getPath().getName() for s in self.fs.listStatus(self.folder)] if self.fs.exists(self.folder) else []
        version = 1 + max([int(n.lstrip(".v")) for n in names if re.fullmatch(r"\.?v\d+", n)], default=0)
        self.fs.create(self.join(f".v{version}"), False).close()  # fails if it is there
        df.write.parquet(f"{self.path}/v{version}")
        for old in self.versions()[: -self.keep]:
            self.fs.delete(self.join(f"v{old}"), True)


def key_values(spark: SparkSession, path: str) -> DataFrame:
    """key, value (as JSON text) of a JSON object in a file; nothing where there is none."""
    parsed = F.from_json("value", "map<string,string>")
    return spark.read.text(path, wholetext=True).select(F.explode(parsed).alias("key", "value"))
