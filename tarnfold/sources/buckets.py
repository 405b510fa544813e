"""A keyed table in buckets: a write makes new versions of the buckets that it changes, and of no others.

A manifest names, for every bucket, the version whose files hold it. Readers take the last manifest and so see whole
versions; writers make files first and the manifest last. Of two writers that start from one version, one gets the next.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnfold.session import cut
from tarnfold.sources.files import RecordNotFound

BUCKETS = 256
MARK = "_bucket"


class Conflict(Exception):
    """Another writer was first."""


class BucketedTable:
    """Rows by key in `buckets` parts by the hash of `by` (the key itself if it is None), under one folder.

    by: columns that are the same for all rows of a key, if whole groups of keys are to be replaced together. Files of
    versions that no kept manifest names are deleted by vacuum().
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "id", by: str | None = None, buckets: int = BUCKETS, keep: int = 2):
        self.spark, self.path, self.key, self.by, self.buckets, self.keep = spark, path.rstrip("/"), key, by or key, buckets, keep
        self.jvm = spark.sparkContext._jvm
        self.folder = self.at("")
        self.fs = self.folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def versions(self) -> list[int]:
        if not self.fs.exists(self.folder):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self.folder)]
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"v(\d+)\.json", n)))

    def manifest(self, version: int | None = None) -> dict:
        """version, schema, buckets (number as text -> version of its files)."""
        known = self.versions()
        if not known:
            raise RecordNotFound(self.path)
        version = known[-1] if version is None else version
        lines = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{version}.json")
        stream = self.fs.open(lines)
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def files(self, manifest: dict, some: set[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schema"])
        paths = [f"{self.path}/data/v{v}/{MARK}={b}" for b, v in manifest["buckets"].items() if some is None or int(b) in some]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        return self.files(self.manifest(version))

    def bucket(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(MARK, F.pmod(F.xxhash64(self.by), F.lit(self.buckets)).cast("int"))

    def commit(self, start: int, schema: T.StructType, buckets: dict[str, int], rows: DataFrame | None) -> int:
        """Write rows (with MARK) as the files of version start + 1, and its manifest. The claim keeps a second writer away."""
        version = start + 1
        while self.fs.exists(self.at(f".claim-v{version}")) and not self.versions()[-1:] >= [version]:
            version += 1  # claims of writers that never ended
        try:
            self.fs.create(self.at(f".claim-v{version}"), False).close()
        except Exception as e:
            raise Conflict(f"version {version} of {self.path}") from e
        written: set[int] = set()
        if rows is not None:
            rows.repartition(MARK).write.partitionBy(MARK).parquet(f"{self.path}/data/v{version}")
            names = [s.getPath().getName() for s in self.fs.listStatus(self.at(f"data/v{version}"))]
            written = {int(n.split("=")[1]) for n in names if n.startswith(f"{MARK}=")}
        if self.versions()[-1:] != ([start] if start else []):
            raise Conflict(f"{self.path} has moved on from version {start}")
        text = json.dumps({"version": version, "schema": schema.jsonValue(), "buckets": buckets | {str(b): version for b in sorted(written)}})
        out = self.fs.create(self.at(f".v{version}.json"), True)
        out.write(bytearray(text.encode()))
        out.close()
        if not self.fs.rename(self.at(f".v{version}.json"), self.at(f"v{version}.json")):
            raise Conflict(f"version {version} of {self.path}")
        return version

    def write(self, rows: DataFrame) -> int:
        """rows are the whole table."""
        start = (self.versions() or [0])[-1]
        return self.commit(start, rows.schema, {}, self.bucket(rows))

    def change(self, changed: DataFrame, make: Callable[[DataFrame], DataFrame]) -> int:
        """make(rows of all buckets that changed's rows are in) is put in their place; no other bucket is read or written.

        changed: a table with the columns `by` that the change touches. At most one number a bucket comes to the driver.
        """
        now = self.manifest()
        hit = {r[MARK] for r in self.bucket(changed.select(self.by).distinct()).select(MARK).distinct().collect()}
        if not hit:
            return now["version"]
        rest = {b: v for b, v in now["buckets"].items() if int(b) not in hit}
        return self.commit(now["version"], T.StructType.fromJson(now["schema"]), rest, self.bucket(make(self.files(now, hit))))

    def upsert(self, new: DataFrame, order: str | None = None) -> int:
        """new rows in place of those with their keys; of several with one key the last in the order (None: any one).

        If buckets go by other columns than the key, a key whose columns have changed leaves its old bucket, too: the keys
        alone of all buckets are read for that.
        """
        last = Window.partitionBy(self.key).orderBy(*([F.desc(order)] if order else []), F.lit(0))
        new = cut(new.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n"))
        keys = new.select(self.key)
        touched = new.select(self.by)
        if self.by != self.key:
            touched = touched.union(self.read().select(self.key, self.by).join(keys, self.key, "left_semi").select(self.by))
        return self.change(touched, lambda rows: rows.join(keys, self.key, "left_anti").select(rows.columns).unionByName(new.select(rows.columns)))

    def delete(self, gone: DataFrame, column: str | None = None) -> int:
        """Rows whose `column` (the key if it is None) is among those of gone go. By another column than `by`, its values
        are looked up in all buckets first, reading these two columns alone."""
        column = column or self.key
        gone = gone.select(column).distinct()
        touched = gone if column == self.by else self.read().select(*{column, self.by}).join(gone, column, "left_semi")
        return self.change(touched, lambda rows: rows.join(gone, column, "left_anti").select(rows.columns))

    def vacuum(self) -> list[int]:
        """Delete old manifests but the last `keep`, and the files of buckets that none of those names. No reader may be older."""
        kept = self.versions()[-self.keep :]
        used = {(int(b), v) for k in kept for b, v in self.manifest(k)["buckets"].items()}
        for old in set(self.versions()) - set(kept):
            self.fs.delete(self.at(f"v{old}.json"), False)
        if not self.fs.exists(self.at("data")):
            return kept
        for version in self.fs.listStatus(self.at("data")):
            number = int(version.getPath().getName()[1:])
            if number > kept[-1]:
                continue  # of a writer that has not ended
            for part in self.fs.listStatus(version.getPath()):
                name = part.getPath().getName()
                if name.startswith(f"{MARK}=") and (int(name.split("=")[1]), number) not in used:
                    self.fs.delete(part.getPath(), True)
        return kept
