import random

import pytest
from pyspark.sql import functions as F

from tarnfold.operators import messages, tools

LOG = "task_id string, seq long, ts long, kind string, type string, text string"


@pytest.fixture(scope="module")
def log(spark):
    return lambda rows, task="t": spark.createDataFrame([(task, i, 1000 + i, *r) for i, r in enumerate(rows)], LOG)


def START():
    return F.col("type") == "start"


def FINISH():
    return F.col("type") == "finish"


def stack(kinds):
    open_, out = [], []
    for i, k in enumerate(kinds):
        if k == "start":
            open_.append(i)
        elif k == "finish" and open_:
            out.append((open_.pop(), i))
    return sorted(out)


def test_pairs_are_those_of_a_stack(spark):
    rng = random.Random(5)
    logs = {f"t{n}": [rng.choice(["start", "finish", "other"]) for _ in range(rng.randrange(1, 30))] for n in range(150)}
    rows = [(t, i, i, "", k, "{}") for t, ks in logs.items() for i, k in enumerate(ks)]
    got = {}
    for r in messages.pairs(spark.createDataFrame(rows, LOG), START(), FINISH()).collect():
        got.setdefault(r.task_id, []).append((r.start_seq, r.finish_seq))
    assert {t: sorted(v) for t, v in got.items()} == {t: p for t, ks in logs.items() if (p := stack(ks))}


def test_requests(log):
    def run(rows):
        return [(r.type, r.text) for r in messages.consolidate_requests(log(rows), START(), FINISH()).orderBy("seq").collect()]

    one = run([("say", "start", '{"request":"GET /api/data"}'), ("say", "finish", '{"cost":0.005}')])
    assert one == [("start", '{"request":"GET /api/data","cost":"0.005"}')]
    assert len(run([("s", "start", "{}"), ("s", "finish", "{}"), ("s", "start", "{}"), ("s", "finish", "{}")])) == 2
    assert run([("s", "start", '{"a":1}'), ("s", "text", "x")]) == [("start", '{"a":1}'), ("text", "x")]
    assert len(run([("s", "start", "invalid json"), ("s", "finish", '{"cost":1}')])) == 1
    assert run([("s", "finish", "{}")]) == [("finish", "{}")]  # alone
    nested = run([("s", "start", '{"n":"1"}'), ("s", "start", '{"n":"2"}'), ("s", "finish", '{"f":"1"}'), ("s", "finish", '{"f":"2"}')])
    assert nested == [("start", '{"n":"1","f":"2"}'), ("start", '{"n":"2","f":"1"}')]


def test_commands(log):
    def run(rows):
        return [r.text for r in messages.consolidate_commands(log(rows), F.col("type") == "command", F.col("type") == "output", "kind").orderBy("seq").collect()]

    assert run([("ask", "command", "ls"), ("ask", "output", "file1.txt"), ("ask", "output", "file2.txt")]) == ["ls\nOutput:file1.txt\nfile2.txt"]
    assert run([("ask", "command", "ls"), ("ask", "output", "same output"), ("say", "output", "same output")]) == ["ls\nOutput:same output"]
    assert run([("ask", "output", "lost"), ("say", "text", "hi"), ("ask", "command", "a"), ("ask", "command", "b"), ("say", "output", "x")]) == ["hi", "a", "b\nOutput:x"]


def test_usage(log):
    rows = [("say", "request", '{"tokensIn":100,"tokensOut":50,"cost":0.01}'), ("say", "request", '{"tokensIn":200,"tokensOut":100,"cost":0.02}')]
    r = messages.token_usage(log(rows), F.col("type") == "request").first()
    assert (r.tokens_in, r.tokens_out, r.cost, r.cache_writes, r.cache_reads, r.context_tokens) == (300, 150, 0.03, None, None, 300)
    more = [rows[0], ("say", "condense", '{"newContextTokens":5000,"cost":0.05}'), ("say", "request", '{"tokensIn":"bad","cost":"x"}')]
    r = messages.token_usage(log(more), F.col("type") == "request", F.col("type") == "condense").first()
    assert r.context_tokens == 5000 and abs(r.cost - 0.06) < 1e-9


def test_truncation(log):
    t = messages.truncate(log([("say", "text", str(i)) for i in range(11)]), 0.5)
    assert [r.seq for r in t.where("hidden").orderBy("seq").collect()] == [1, 2, 3, 4]
    m = messages.markers(t).first()
    assert (m.after_seq, m.messages_removed) == (4, 4)
    assert messages.markers(messages.truncate(log([("say", "text", "x")] * 2), 0.5)).count() == 0


def test_batches_and_repetitions(log):
    rows = log([("", k, k) for k in "aabaaab"])
    got = sorted((r.seq, r.n) for r in messages.batch_consecutive(rows, F.col("type") == "a").collect())
    assert got == [(0, 2), (2, 1), (3, 3), (6, 1)]
    flags = [r.flagged for r in messages.repetitions(rows, "type", 3).orderBy("seq").collect()]
    assert flags == [False] * 5 + [True, False]


def test_history_without_condensed_rows(spark):
    schema = "task_id string, seq long, is_summary boolean, condense_id string, condense_parent string, is_truncation_marker boolean, truncation_id string, truncation_parent string"
    rows = [("t", 0, False, None, "c1", False, None, None), ("t", 1, False, None, "gone", False, None, None), ("t", 2, True, "c1", None, False, None, None), ("t", 3, False, None, None, False, None, "x1"), ("t", 4, False, None, None, True, "x1", None), ("t", 5, False, None, None, False, None, None)]
    df = spark.createDataFrame(rows, schema)
    assert [r.seq for r in messages.visible_history(df).orderBy("seq").collect()] == [2, 4, 5]
    cleared = {r.seq: r.condense_parent for r in messages.clear_orphans(df, "condense_parent", "condense_id").collect()}
    assert cleared[0] == "c1" and cleared[1] is None and len(cleared) == 6


def test_rewind(spark, log):
    rows = log([("say", "user", "a"), ("say", "x", "b"), ("say", "user", "c"), ("say", "x", "d")])
    cut = lambda ts: [r.seq for r in messages.rewind(rows, spark.createDataFrame([("t", ts)], "task_id string, cut_ts long"), F.col("type") == "user").orderBy("seq").collect()]
    assert cut(1001) == [0] and cut(999) == [0, 1, 2, 3] and cut(2000) == [0, 1, 2, 3]
    gap = rows.where("seq <> 1")
    out = messages.rewind(gap, spark.createDataFrame([("t", 1001)], "task_id string, cut_ts long"), F.col("type") == "user")
    assert [r.seq for r in out.collect()] == [0]


def test_metadata_and_states(spark, log):
    rows = [("say", "task", "do it"), ("say", "start", '{"tokensIn":5}'), ("say", "finish", '{"cost":1}'), ("ask", "resume", "")]
    m = messages.task_metadata(log(rows), START(), START(), FINISH(), F.col("type") == "resume").first()
    assert (m.task, m.ts, m.n_rows, m.tokens_in, m.cost) == ("do it", 1002, 4, 5, 1.0)
    p = messages.request_in_progress(log(rows), START()).first()
    assert p.in_progress
    assert messages.replace_or_append(log(rows), log([("say", "new", "n")] * 5), "seq").count() == 5


def test_repair(spark):
    uses = spark.createDataFrame([("t", 1, i, f"u{i}") for i in range(3)], "task_id string, message int, seq int, tool_use_id string")
    results = spark.createDataFrame([("t", 1, 0, "u1", "one"), ("t", 1, 1, "u1", "again"), ("t", 1, 2, "odd", "two")], "task_id string, message int, seq int, tool_use_id string, content string")
    got = {r.tool_use_id: (r.content, r.how) for r in messages.repair_results(uses, results).collect()}
    assert got["u1"] == ("one", "kept") and got["u0"] == ("two", "moved") and got["u2"][1] == "made"


def test_hunk_lines(spark):
    text = ["--- a", "+++ b", "@@ -3,3 +5,3 @@", " same", "-old", "+new", " end"]
    rows = spark.createDataFrame([("p", i, x) for i, x in enumerate(text)], "path string, seq int, line string")
    got = [(r.line, r.old_no, r.new_no) for r in tools.number_hunks(rows).orderBy("seq").collect()]
    assert got == [(" same", 3, 5), ("-old", 4, None), ("+new", None, 6), (" end", 5, 7)]
