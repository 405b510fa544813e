import json
import uuid

import duckdb
import pytest
from pyspark.sql import functions as F

from tarnfold import plans
from tarnfold.operators import index
from tarnfold.streaming import folds, streams


def run(fold, events):
    state, out = None, []
    for i, e in enumerate(events):
        state, rows = fold(json.loads(json.dumps(state)), {"seq": i} | e)
        out += rows
    return out


def test_dedup():
    fresh = lambda events, most=10: [x[1] for x in run(folds.deduper(most), [{"ts": t, "payload": p} for t, p in events])]
    assert fresh([(123, "p"), (123, "p")]) == [True, False]
    assert fresh([(123, "a"), (123, "b")]) == [True, True]
    assert fresh([(1, "x"), (2, "x"), (3, "x"), (1, "x")], 2) == [True] * 4


def test_small_folds():
    texts = lambda *xs: [{"payload": x} for x in xs]
    assert run(folds.text_delta, texts("He", "Hello", "new")) == [(0, "He"), (1, "llo"), (2, "new")]
    assert run(folds.structured_delta, texts('{"a":1}', '{"a":1,"b":2}', "x"))[1:] == [(1, ',"b":2'), (2, "x")]
    assert run(folds.lines, texts("a\nb", "c\n\nd", None)) == [(0, "a"), (1, "bc"), (1, ""), (2, "d")]
    assert run(folds.tagged("think"), texts("a<th", "ink>b</thi", "nk>c<", None)) == [(0, False, "a"), (1, True, "b"), (2, False, "c"), (3, False, "<")]
    assert run(folds.preview(6), texts("abcd", "efgh"))[-1] == (1, "abc", 2, "fgh")
    assert [x[1] for x in run(folds.lifecycle, [{"event_name": n} for n in ("taskStarted", "x", "taskCompleted", "taskStarted")])] == ["running", "finished"]
    assert run(folds.throttle(2000), [{"ts": t, "payload": p} for t, p in ((0, 1), (500, 2), (900, 3), (2500, 3), (9000, 3))]) == [(0, 1), (2000, 3)]


def test_stretches_are_closed_in_their_line():
    texts = lambda *xs: [{"payload": x} for x in xs]
    text = "a<think>b</think>c<think>d\ne</think><think>f<think>g</think><think>h"
    want = "a c<think>d\ne</think> <think>h".replace(" ", ""), "bf<think>g"
    for n in (1, 2, 5, 100):
        got = run(folds.tagged_in_lines("think"), texts(*[text[i : i + n] for i in range(0, len(text), n)], None))
        assert ("".join(t for _, inside, t in got if not inside), "".join(t for _, inside, t in got if inside)) == want


def test_stretches_with_line_breaks_are_as_in_sql(spark, tmp_path):
    """Dots do not match line breaks in the query's SQL; a conversation without a key or any text has its row, too."""
    said = {0: ["ab", "c\nd", "e", "f"], 1: ["a\nb", "cd", "e\n", "\nf", "g", "h\n"], 2: ["", ""], 3: ["ab"], None: ["ab", "cd"], 4: ["<thin", "k>x", "", "\n"]}
    rows = [(k, i, t) for k, ts in said.items() for i, t in enumerate(ts)]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = [tuple(r) for r in plans.QUERIES["tagged_stretches"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(con.execute(plans.SQL["tagged_stretches"]).fetchall(), key=repr)


def test_tool_calls():
    e = lambda **x: {"id": None, "name": None, "arguments": None, "done": False} | x
    got = run(folds.tool_calls, [e(id="1", arguments='{"a'), e(name="read"), e(arguments='":1}'), e(done=True)])
    assert got == [(1, "start", "read"), (1, "delta", '{"a'), (2, "delta", '":1}'), (3, "end", "read")]


def test_queues():
    add = lambda r: {"op": "add", "request": r, "status": 0}
    got = run(folds.retry_queue(2), [add("a"), add("b"), add("c"), *({"op": "attempt", "request": None, "status": s} for s in (429, 503, 200, 404))])
    assert [x[1:] for x in got] == [("a", "dropped"), ("b", "paused"), ("b", "retried"), ("c", "sent"), ("b", "refused")]
    got = run(folds.message_queue, [{"op": o, "id": i, "payload": p} for o, i, p in (("add", 1, "x"), ("add", 2, "y"), ("update", 2, "z"), ("remove", 1, None), ("dequeue", None, None), ("dequeue", None, None))])
    assert got == [(4, 2, "z")]


@pytest.fixture
def folder(tmp_path, spark):
    def of(batches, schema):
        d = tmp_path / uuid.uuid4().hex
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(d / f"b{i}"))
        return streams.read_events(spark, str(d / "*"), schema)

    return of


def drain(df, mode="append"):
    name = "q" + uuid.uuid4().hex
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_stream_and_replay_agree(spark, folder):
    rows = [(f"t{i % 3}", i, f"{i // 6}") for i in range(60)]
    schema = "task_id string, seq long, payload string"
    fold = lambda s, e: (e["payload"], [] if s == e["payload"] else [(e["seq"],)])
    want = sorted(map(tuple, folds.replay(spark.createDataFrame(rows, schema), ["task_id"], fold, "seq long").collect()))
    got = sorted(map(tuple, drain(folds.follow(folder([rows[:30], rows[30:]], schema), ["task_id"], fold, "seq long"))))
    assert got == want and len(want) == 30


def test_live_state(folder):
    rows = [("t", "taskTokenUsageUpdated", 1, 5, 5, 0.1), ("t", "taskCompleted", 2, 9, 9, 0.2), ("u", "other", 3, 1, 1, 0.0)]
    got = drain(streams.usage(folder([rows], "task_id string, event_name string, seq long, tokens_in long, tokens_out long, cost double")), "complete")
    assert [tuple(r) for r in got] == [("t", 9, 9, 0.2)]


def test_debounce(spark):
    rows = spark.createDataFrame([("p", "create", 0.0), ("p", "delete", 0.3), ("p", "create", 5.0)], "path string, event_type string, s double").withColumn("event_ts", F.timestamp_millis((F.col("s") * 1000).cast("long")))
    assert sorted(r.event_type for r in streams.debounce(rows).collect()) == ["create", "delete"]


def test_changes_are_applied_by_file(spark, tmp_path):
    from tarnfold.operators.tools import VectorStore

    store = VectorStore(spark, str(tmp_path / "s"), 8)
    assert store.initialize() and not store.initialize() and not store.has_data()
    text = "some words that are long enough to be a chunk of their own, surely"

    def chunk(files):
        blocks = index.embed(index.chunks(files), "content", index.hashed_embedder(8), 8)
        return blocks.select(index.point_id(F.col("segment_hash")).alias("id"), "path", "start_line", "end_line", "content", "segment_hash", "embedding")

    change = streams.apply_changes(store.table.read, store.table.write, chunk)
    schema = "path string, event_type string, content string, seq long"
    change(spark.createDataFrame([("a/x.swift", "create", text, 1), ("a/y.swift", "create", text + " y", 2), ("b/z.swift", "create", text, 3), ("b/z.swift", "delete", None, 4)], schema), 0)
    assert sorted(r.path for r in store.table.read().collect()) == ["a/x.swift", "a/y.swift"]
    change(spark.createDataFrame([("a/x.swift", "change", text + " more", 5)], schema), 1)
    rows = {r.path: r for r in store.table.read().collect()}
    assert rows["a/x.swift"].content.endswith("more") and len(rows) == 2
    files = streams.feed(store, chunk)
    files(spark.createDataFrame([("c/v.swift", "create", text, 6), ("a/y.swift", "change", text + " z", 7), ("c/v.swift", "delete", None, 8), ("c/w.swift", "create", text, 9)], schema), 2)
    assert {r.path: r.content[-2:] for r in store.table.read().collect()} == {"a/x.swift": "re", "a/y.swift": " z", "c/w.swift": "ly"}
    files(spark.createDataFrame([("c/w.swift", "delete", None, 10)], schema), 3)
    hit = store.search(rows["a/x.swift"].embedding, k=1, prefix="./a").first()
    assert hit.path == "a/x.swift" and hit.score > 0.99
    assert store.search(rows["a/x.swift"].embedding, prefix="b").count() == 0
    store.delete_paths(spark.createDataFrame([("a",)], "path string"))
    assert store.table.read().count() == 2
    store.mark(True)
    assert store.has_data() and VectorStore(spark, str(tmp_path / "s"), 16).initialize()


def test_beats(spark):
    rows = spark.sql("SELECT 1 run_id, 'a' runner, TIMESTAMP'2024-01-01 00:00:00' event_ts UNION ALL SELECT 1, 'b', TIMESTAMP'2024-01-01 00:00:20'")
    from datetime import datetime

    assert [r.runner for r in streams.alive(rows, "10 seconds", datetime(2024, 1, 1, 0, 0, 25)).collect()] == ["b"]


def test_queue_stats(spark):
    from tarnfold.operators import tools

    q = spark.createDataFrame([("a", 5, 1, None), ("b", 2, 0, "e"), ("a", 9, 2, None)], "type string, ts long, retries long, last_error string")
    r = tools.queue_stats(q).first()
    assert (r["size"], r.oldest, r.newest, r.retries, r.with_error, r.by_type) == (3, 2, 9, 3, 1, {"a": 2, "b": 1})
    assert tools.queue_stats(q.limit(0)).first()["size"] == 0


def test_spilling_by_bytes():
    """What is shown never cuts a character, and what is written is the whole stream from the threshold on."""
    import random

    rng = random.Random(3)
    for _ in range(200):
        chunks = ["".join(rng.choice("aé中🙂") for _ in range(rng.randrange(6))) for _ in range(rng.randrange(1, 12))]
        threshold, shown = rng.choice([0, 5, 30, 200]), rng.choice([0, 1, 7, 20, 500])
        out = run(folds.spilling(threshold, shown), [{"payload": c} for c in chunks])
        for i, (_, _, _, head, omitted, tail) in enumerate(out):
            whole = "".join(chunks[: i + 1])
            size = len(whole.encode())
            assert whole.startswith(head) and whole.endswith(tail) and omitted == size - len(head.encode()) - len(tail.encode()) >= 0
            assert len(head.encode()) + len(tail.encode()) <= max(shown, 0)
            assert omitted or head + tail == whole
        written = "".join(d for _, _, d, *_ in out if d)
        assert written == ("".join(chunks) if len("".join(chunks).encode()) > threshold else "")
        at = 0
        for _, start, d, *_ in out:
            if d:
                assert start == at
                at += len(d.encode())


def test_spilled_files_after_a_restart(spark, tmp_path):
    """The stream stops after some batches, with one of them done twice, and goes on: files equal the input."""
    import random

    rng = random.Random(5)
    rows = [(k, i, "".join(rng.choice("aé\n") for _ in range(40))) for i in range(60) for k in ("a/b", "c d", "small") if k != "small" or i < 2]
    schema = "task string, seq long, payload string"
    for i in range(0, len(rows), 30):
        spark.createDataFrame(rows[i : i + 30], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in" / f"b{i:03d}"))
    events = streams.read_events(spark, str(tmp_path / "in" / "*"), schema, files_per_batch=1)
    found = folds.follow(events, ["task"], folds.spilling(300, 50), folds.SPILLED)
    write, done = streams.spill_to(f"file:{tmp_path}/out", "task"), []

    def once_or_fail(batch, n):
        write(batch, n)
        done.append(n)
        if done == [0, 1]:
            raise RuntimeError("lost after the files were written")

    def start():
        q = found.writeStream.option("checkpointLocation", str(tmp_path / "c")).foreachBatch(once_or_fail).trigger(availableNow=True).start()
        q.awaitTermination(240)

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    with pytest.raises(Exception, match="lost"):
        start()
    start()
    got = {}
    for r in streams.spilled(spark, f"file:{tmp_path}/out").orderBy("key", "at").collect():
        assert r.at == len(got.get(r.key, b""))
        got[r.key] = got.get(r.key, b"") + bytes(r.content)
    assert got == {k: "".join(p for t, _, p in rows if t == k).encode() for k in ("a/b", "c d")}
