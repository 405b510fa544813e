"""Folders as a Spark source: their files as a table, read folder by folder, and their changes as a stream.

    spark.dataSource.register(FolderSource)
    spark.read.format("folder").option("path", "/work").load()
    spark.readStream.format("folder").option("path", "/work").option("snapshots", "/shared/snapshots").load()

The table has path (below the folder), is_dir, size and modified of everything that is not ignored. An ignored folder is
not entered. The stream compares listings: each one is a snapshot, a file of its own in `snapshots`, and a batch holds
what differs between two of them: files created, changed (in size or time) and deleted. Folders are no part of it.

Folders are those that the machine mounts, as an agent's work folder is; the driver and all executors must see them.
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

TABLE = "path string, is_dir boolean, size long, modified long"
CHANGES = "path string, event_type string, size long, modified long"
#: Folders that are dealt out to tasks: more of them, as the walk goes deeper, until there are so many.
PARTS = 64
#: Changes of a task.
CHANGES_A_TASK = 10_000


def listing(root: str, folder: str, ignored: tuple[str, ...]) -> list[tuple[str, bool, int, int]]:
    """What a folder holds itself: (path below the root, is_dir, size, modified in milliseconds). Links are not followed.

    A folder that is gone or may not be read holds nothing; so does one entry that goes meanwhile.
    """
    out = []
    try:
        with os.scandir(os.path.join(root, folder)) as found:
            for e in found:
                path = f"{folder}/{e.name}" if folder else e.name
                if any(fnmatch.fnmatchcase(e.name, p) or fnmatch.fnmatchcase(path, p) for p in ignored):
                    continue
                try:
                    is_dir, stat = e.is_dir(follow_symlinks=False), e.stat(follow_symlinks=False)
                except OSError:
                    continue
                out.append((path, is_dir, 0 if is_dir else stat.st_size, stat.st_mtime_ns // 1_000_000))
    except OSError:
        return []
    return sorted(out)


def walk(root: str, folder: str, ignored: tuple[str, ...]) -> Iterator[tuple[str, bool, int, int]]:
    """Everything below a folder, level by level."""
    todo = [folder]
    for f in todo:
        for row in listing(root, f, ignored):
            if row[1]:
                todo.append(row[0])
            yield row


@dataclass
class Below(InputPartition):
    """Rows that the driver has seen on its way, or a folder to be walked."""

    folder: str | None
    rows: list[tuple]


@dataclass
class Changed(InputPartition):
    rows: list[tuple]


def options_of(options: dict) -> tuple[str, tuple[str, ...]]:
    if "path" not in options:
        raise ValueError("the folder source needs the option path")
    return options["path"].rstrip("/") or "/", tuple(x for x in options.get("ignored", "").split(",") if x)


class FolderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.ignored = options_of(options)
        self.parts = int(options.get("parts", PARTS))

    def partitions(self) -> list[InputPartition]:
        """Upper levels are listed here, until there are `parts` folders; each is then walked by a task."""
        level, seen = [""], []
        while level and len(level) < self.parts:
            rows = [r for f in level for r in listing(self.root, f, self.ignored)]
            seen += rows
            level = [r[0] for r in rows if r[1]]
        return [Below(None, seen), *[Below(f, []) for f in level]]

    def read(self, partition: Below) -> Iterator[tuple]:
        yield from partition.rows if partition.folder is None else walk(self.root, partition.folder, self.ignored)


class FolderStream(DataSourceStreamReader):
    """Offsets are names of snapshots, that of nothing being the empty name."""

    def __init__(self, options: dict):
        self.root, self.ignored = options_of(options)
        if "snapshots" not in options:
            raise ValueError("a stream of changes needs the option snapshots: a folder that outlives it")
        self.snapshots = options["snapshots"]
        os.makedirs(self.snapshots, exist_ok=True)

    def initialOffset(self) -> dict:
        return {"snapshot": ""}

    def latestOffset(self) -> dict:
        """A listing, written once under the name of its content."""
        text = "\n".join(json.dumps([p, s, m]) for p, d, s, m in sorted(walk(self.root, "", self.ignored)) if not d)
        name = hashlib.sha256(text.encode()).hexdigest()[:32]
        if not os.path.exists(to := f"{self.snapshots}/{name}"):
            with open(f"{to}.new", "w", encoding="utf-8") as f:
                f.write(text)
            os.replace(f"{to}.new", to)
        return {"snapshot": name}

    def snapshot(self, name: str) -> dict[str, tuple[int, int]]:
        if not name:
            return {}
        with open(f"{self.snapshots}/{name}", encoding="utf-8") as f:
            return {p: (s, m) for p, s, m in map(json.loads, filter(None, f.read().split("\n")))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        a, b = self.snapshot(start["snapshot"]), self.snapshot(end["snapshot"])
        rows = [(p, "create" if p not in a else "change", *b[p]) for p in sorted(b) if a.get(p) != b[p]]
        rows += [(p, "delete", None, None) for p in sorted(a.keys() - b.keys())]
        return [Changed(rows[i : i + CHANGES_A_TASK]) for i in range(0, len(rows), CHANGES_A_TASK)] or [Changed([])]

    def read(self, partition: Changed) -> Iterator[tuple]:
        yield from partition.rows

    def commit(self, end: dict) -> None:
        """Older snapshots stay until the stream is started anew from its checkpoint: a batch may be asked for again."""


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return CHANGES if self.options.get("changes", "").lower() == "true" else TABLE

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FolderStream(self.options)
