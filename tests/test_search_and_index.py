import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnfold.operators import evals, index, search
from tarnfold.sources import files


def test_chunks_of_lines():
    out = index.chunk_lines("p", ["normal", "a" * 2000, "normal"], "test_type", base=100)
    assert [(b[2], b[3], len(b[5])) for b in out] == [("test_type_segment", 101, 1000)] * 2
    many = index.chunk_lines("p", [f"{i}: some line of text that is here" for i in range(100)], "x")
    assert all(100 <= len(b[5]) <= 1150 for b in many)
    rows = sorted(n for b in many for n in range(b[3], b[4] + 1))
    assert rows == list(range(1, 101))
    # a small rest takes lines from the block before it
    tail = index.chunk_lines("p", ["x" * 100] * 12, "x")
    assert [len(b[5]) >= 200 for b in tail] == [True, True]


def test_chunks_of_markdown(spark):
    text = "intro " * 20 + "\n# One\n" + "body " * 30 + "\n```\n# no header\n```\nTwo\n===\n" + "more " * 300 + "\n# Short\nx"
    rows = spark.createDataFrame([("a.md", text), ("b.swift", "short"), ("c.swift", None)], "path string, content string")
    got = index.chunks(rows).collect()
    names = [r.identifier for r in got]
    assert names[0] is None and "One" in names and "Two" in names and "Short" not in names and "no header" not in names
    assert len({r.segment_hash for r in got}) == len(got) and all(50 <= len(r.content) <= 1150 for r in got)


def test_hash_diff(spark):
    f = lambda x: spark.createDataFrame(x, "path string, file_hash string")
    got = dict(map(tuple, index.hash_diff(f([("a", "h1"), ("b", "h2"), ("c", "h3")]), f([("a", "h1"), ("b", "hX"), ("d", "h4")])).collect()))
    assert got == {"a": "same", "b": "modified", "c": "deleted", "d": "new"}


def test_point_ids(spark):
    import uuid

    got = spark.createDataFrame([("abc",), ("é",)], "h string").select(index.point_id(F.col("h"))).collect()
    assert [r[0] for r in got] == [str(uuid.uuid5(index.NAMESPACE, x)) for x in ("abc", "é")]


def test_vectors_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, [0.0] * 16)], "id int, embedding array<float>")
    cos = (x @ x[7]) / np.linalg.norm(x, axis=1) / np.linalg.norm(x[7])
    got = [r.id for r in index.vector_search(df, x[7].tolist(), 10, 0.1).collect()]
    assert got == [i for i in np.argsort(-cos)[:10].tolist() if cos[i] >= 0.1]


def test_batches(spark):
    items = spark.createDataFrame([("k", i, t) for i, t in enumerate([60, 50, 9000, 40, 10])], "k string, seq int, tokens int")
    got = {r.seq: r.batch for r in index.batches(items, "tokens", 100, 8191, "k").collect()}
    assert got == {0: 0, 1: 1, 3: 1, 4: 1}


@pytest.mark.parametrize("hits,groups", [((3, 5), [(2, 6)]), ((3, 9), [(2, 4), (8, 10)])])
def test_context_groups(spark, hits, groups):
    f = spark.createDataFrame([("f", "\n".join("hit" if i in hits else "no" for i in range(1, 12)))], "path string, content string")
    lines = search.lines_of(f)
    got = search.regex_search(lines, "hit").groupBy("group").agg(F.min("line_no"), F.max("line_no")).orderBy("group").collect()
    assert [tuple(r)[1:] for r in got] == groups
    assert [r.byte_offset for r in lines.orderBy("line_no").limit(2).collect()] == [0, 3]


def test_paths(spark):
    paths = ["src/a/x.ts", "node_modules/m.js", "src/.git/c", "build/dependencies/y", "a/out/z", "ok.md", "src/b.log"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    kept = [r.path for r in df.where(~search.ignored(F.col("path"))).collect()]
    assert kept == ["src/a/x.ts", "ok.md", "src/b.log"]
    for prefix, n in ((".", 7), ("./", 7), ("./src", 3), ("src/a", 1), ("sr", 0)):
        assert df.where(search.has_prefix(F.col("path"), prefix)).count() == n
    by = lambda *ps: [r.path for r in df.where(search.ignored_by(F.col("path"), ps)).collect()]
    assert by("*.log", "# note", "/src/a/", "!b.log") == ["src/a/x.ts"] and by("**/z") == ["a/out/z"]
    listed = search.listing(search.with_ancestors(df), 4).collect()
    assert [r.path for r in listed] == ["a", "build", "node_modules", "src"]


def test_rules(spark):
    rules = spark.createDataFrame([("git", True), ("git push", False), ("*", True), ("npm ", True), ("NPM ", False)], "prefix string, allow boolean")
    cmds = spark.createDataFrame([("git status",), ("GIT PUSH x",), ("npm i",), ("ls",), ("",)], "command string")
    got = dict(map(tuple, search.longest_prefix(cmds, rules).collect()))
    assert got == {"git status": "approve", "GIT PUSH x": "deny", "npm i": "deny", "ls": "approve", "": "approve"}
    none = search.longest_prefix(cmds, rules.where("prefix like 'git%'"))
    assert dict(map(tuple, none.collect()))["ls"] == "ask"
    parts = spark.createDataFrame([(1, "git a"), (1, "git push"), (2, "git $(x)"), (3, "git b"), (4, "ls")], "id int, part string")
    got = dict(map(tuple, search.chain_decision(parts, rules.where("prefix like 'git%'")).collect()))
    assert got == {1: "deny", 2: "ask", 3: "approve", 4: "ask"}


def test_fuzzy_and_versions(spark):
    rows = spark.createDataFrame([("src/app.ts",), ("apps.ts",), ("a/p/p",), ("zzz",)], "path string")
    assert [r.path for r in search.fuzzy(rows, "path", "app").collect()] == ["apps.ts", "src/app.ts", "a/p/p"]
    v = spark.createDataFrame([("m", "1.2.0"), ("m", "1.10.0-rc1"), ("m", "2.0.0")], "name string, version string")
    assert search.settings_as_of(v, "1.11.0").first().version == "1.10.0-rc1"
    lines = spark.createDataFrame([(i, x) for i, x in enumerate(["h1", "s1", "Fix a", "me", "d1", "h2", "s2", "Add b", "you", "d2"])], "pos int, line string")
    assert search.commits(lines, "fix").first().hash == "h1" and search.commits(lines, "h2").first().subject == "Add b"
    d = spark.createDataFrame([("p", 0, 3, "e"), ("p", 1, 1, "w"), ("q", 0, 9, "f")], "path string, severity int, line int, message string")
    got = {r.path: (r.messages, r.omitted) for r in search.diagnostics(d, [0, 1], 2).collect()}
    assert got == {"p": (["e"], 1), "q": (["f"], 1)}


def test_overrides(spark):
    b = spark.createDataFrame([("code", "x", 0), ("ask", "y", 1)], "slug string, label string, pos long")
    c = spark.createDataFrame([("new", "n", 0), ("ask", "mine", 1)], "slug string, label string, pos long")
    got = [(r.slug, r.label) for r in evals.in_place_override(b, c, "slug", "pos").orderBy("pos").collect()]
    assert got == [("code", "x"), ("ask", "mine"), ("new", "n")]
    assert [r.id for r in evals.page(spark.range(7), [F.col("id")], 9, 3).collect()] == [6]
    near = evals.adjacent(spark.range(3), [F.col("id")], "id").orderBy("id").collect()
    assert [(r.previous, r.next) for r in near] == [(None, 1), (0, 2), (1, None)]


def test_files(spark, tmp_path):
    d = tmp_path / "d"
    d.mkdir()
    (d / "a.txt").write_text("one\ntwo\nthree")
    (d / "n.ipynb").write_text(json.dumps({"cells": [{"cell_type": "markdown", "source": ["# T"]}, {"cell_type": "raw", "source": ["no"]}, {"cell_type": "code", "source": "x = 1"}]}))
    (d / "b.bin").write_bytes(b"\0\1")
    with zipfile.ZipFile(d / "w.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:r><w:t>Hel</w:t></w:r><w:r><w:t>lo</w:t></w:r></w:p><w:p/></w:document>')
    got = {r.path.rsplit("/", 1)[1]: r for r in files.extract_text(spark, str(d), lines_max=2).collect()}
    assert (got["a.txt"].text, got["a.txt"].truncated, got["a.txt"].total_lines) == ("one\ntwo", True, 3)
    assert got["n.ipynb"].text == "# T\nx = 1" and got["b.bin"].error == "binary file" and got["w.docx"].text == "Hello\n"
    assert files.folder_size(spark, str(d)) == sum(p.stat().st_size for p in d.iterdir())
    (tmp_path / "log").mkdir()
    (tmp_path / "log/x.json").write_text('[{"ts": 1, "role": "user"}, {"ts": 2, "role": "assistant"}]')
    (tmp_path / "log/y.json").write_text('{"no": "array"}')
    rows = files.json_array(spark, str(tmp_path / "log"), "ts: bigint, role: string").collect()
    assert [(r.seq, r.ts, r.role) for r in rows if r.role] == [(0, 1, "user"), (1, 2, "assistant")]
    (tmp_path / "r.json").write_text('{"id": "a", "ts": 1}\nbroken\n')
    assert files.json_rows(spark, str(tmp_path / "r.json"), "id string, ts long").count() == 1
    with pytest.raises(ValueError):
        files.read_lines(spark.createDataFrame([], "path string, content string"), 3, 1)
    (tmp_path / "blog").mkdir()
    for n in "ab":
        (tmp_path / f"blog/{n}.md").write_text(f'---\nslug: same\ntitle: "T {n}"\n---\nBody {n}\n')
    with pytest.raises(ValueError):
        files.posts(spark, str(tmp_path / "blog"), ["slug", "title"])
    assert {r.title for r in files.posts(spark, str(tmp_path / "blog"), ["title"]).collect()} == {"T a", "T b"}


def test_listings(spark):
    lines = spark.createDataFrame([(i, f"l{i}") for i in range(6)], "pos int, line string")
    assert [r.line for r in search.git_status(lines, 3).collect()] == ["l0", "l1", "l2", "l3", "... 2 more files"]
    assert search.git_status(lines, 9).count() == 6
    e = spark.createDataFrame([("x/go", True), ("x/.git", True), ("x/a.txt", False)], "path string, is_dir boolean")
    assert [r.name for r in search.directories(e).collect()] == ["go"]
    m = spark.createDataFrame([("a", False, ["text"]), ("b", True, None), ("c", None, ["image"])], "model string, deprecated boolean, output_modalities array<string>")
    assert [r.model for r in search.model_list(m).collect()] == ["a"] and {r.model for r in search.model_list(m, "b").collect()} == {"a", "b"}
    s = spark.createDataFrame([(2, "y", "c"), (0, "x", "a"), (1, "y", "b")], "o int, section string, v string")
    assert [tuple(r) for r in search.by_section(s, "section", "o", "v").collect()] == [("x", ["a"]), ("y", ["b", "c"])]


def test_key_values(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"a": 1, "b": {"c": 2}}')
    assert dict(map(tuple, files.key_values(spark, str(tmp_path / "m.json")).collect())) == {"a": "1", "b": '{"c":2}'}


def brute_window(text, query):
    """The shortest window that holds the query in order: all starts and ends are tried."""
    import itertools

    t, q = text.lower(), [c for c in query.lower() if not c.isspace()]
    best = None
    for at in itertools.product(*[[i for i, c in enumerate(t) if c == w] for w in q]):
        if all(a < b for a, b in itertools.pairwise(at)):
            key = (at[-1] - at[0], at[-1], at)
            best = min(best, key) if best else key
    return best and list(best[2])


def test_tightest_windows_against_all_alignments(spark):
    import random

    rng = random.Random(7)
    texts = ["".join(rng.choice("abcX. ") for _ in range(rng.randrange(12))) for _ in range(150)] + ["", "İi", "aBcaabbc"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for query in ("abc", "aa", "b", "A x", "cab."):
        got = {r.t: r.x for r in rows.select("t", search.tightest(F.col("t"), query).alias("x")).collect()}
        for t in set(texts) - {"İi"}:
            want = brute_window(t, query)
            assert (got[t] is None) == (want is None), (t, query)
            if want:
                assert got[t].end - got[t].start == want[-1] - want[0] + 1 and got[t].positions[0] == got[t].start and got[t].positions[-1] == got[t].end - 1
                assert [t.lower()[p] for p in got[t].positions] == [c for c in query.lower() if c != " "]


def test_best_windows_and_their_marks(spark):
    from tarnfold.functions import texts

    rows = spark.createDataFrame([("a--b--ab",), ("axb",), ("a<b>",), ("zzz",), (None,)], "path string")
    out = search.fuzzy_best(rows, "path", "ab").collect()
    assert [(r.path, r.score, r.start) for r in out] == [("a--b--ab", 2, 6), ("axb", 3, 0), ("a<b>", 3, 0)]
    marked = search.fuzzy_best(rows, "path", "ab").select(texts.highlight(F.col("path"), search.spans(F.col("positions"))).alias("m"))
    assert [r.m for r in marked.collect()][:2] == ['a--b--<span class="hit">ab</span>', '<span class="hit">a</span>x<span class="hit">b</span>']
    assert search.fuzzy_best(rows, "path", "  ").count() == 0
