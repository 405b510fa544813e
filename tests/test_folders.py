import os
import shutil

import pytest

from tarnfold.sources import folders


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "root"
    for i in range(60):
        d = root / f"d{i % 7}" / f"e{i % 3}" / ("node_modules" if i % 11 == 0 else f"f{i % 5}")
        d.mkdir(parents=True, exist_ok=True)
        (d / f"n{i}.txt").write_text("x" * i)
    (root / "top.log").write_text("log")
    (root / "empty").mkdir()
    os.symlink(root / "d0", root / "link")
    return root


@pytest.fixture
def source(spark):
    spark.dataSource.register(folders.FolderSource)
    return spark


def brute(root, ignored):
    out = []
    for at, dirs, names in os.walk(root):
        dirs[:] = [d for d in dirs if d not in ignored]
        for n in [*dirs, *names]:
            p = os.path.join(at, n)
            if n not in ignored and not n.endswith(".log"):
                out.append((os.path.relpath(p, root), os.path.isdir(p) and not os.path.islink(p), 0 if os.path.isdir(p) and not os.path.islink(p) else os.lstat(p).st_size))
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 5, 64, 1000])
def test_table_against_os_walk(source, tree, parts):
    df = source.read.format("folder").option("path", str(tree)).option("ignored", "node_modules,*.log").option("parts", parts).load()
    assert sorted((r.path, r.is_dir, r.size) for r in df.collect()) == brute(tree, {"node_modules"})
    assert source.read.format("folder").option("path", str(tree / "gone")).load().count() == 0


def test_changes_of_three_snapshots(source, tree, tmp_path):
    """Created, changed and deleted files between runs of one stream; folders and ignored files are no part of it."""

    def run():
        stream = source.readStream.format("folder").option("path", str(tree)).option("ignored", "node_modules,*.log,link").option("snapshots", str(tmp_path / "snaps")).option("changes", "true").load()
        q = stream.writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(once=True).start()
        q.awaitTermination(120)
        rows = {(r.path, r.event_type) for r in source.read.schema(folders.CHANGES).json(str(tmp_path / "out")).collect()}
        new, seen[:] = rows - {x for s in seen for x in s}, [*seen, rows]
        return new

    seen = []
    files = {p for p, d, _ in brute(tree, {"node_modules", "link"}) if not d}
    assert run() == {(p, "create") for p in files}
    (tree / "new.txt").write_text("a")
    (tree / "d1/e1/f1/n1.txt").write_text("other")
    (tree / "some.log").write_text("b")
    shutil.rmtree(tree / "d2")
    gone = {p for p in files if p.startswith("d2/")}
    assert gone and run() == {("new.txt", "create"), ("d1/e1/f1/n1.txt", "change")} | {(p, "delete") for p in gone}
    assert run() == set()
    (tree / "new.txt").unlink()
    assert run() == {("new.txt", "delete")}
