import random
import time

import pytest
from pyspark.sql import functions as F

from tarnfold.streaming import streams, timers

EVENTS = "task string, ts long, seq long, payload string"


def brute_throttle(events, gap):
    """Millisecond by millisecond: a value goes out if it differs from the last one and the gap since then is over."""
    out, at, sent, held = [], None, None, None
    by = {}
    for t, p in events:
        by.setdefault(t, []).append(p)
    for t in range(max(by) + gap + 1):
        if held is not None and t >= at + gap:
            if held != sent:
                out.append((t, held))
                at, sent = t, held
            held = None
        for p in by.get(t, []):
            if at is None or t >= at + gap:
                if p != sent:
                    out.append((t, p))
                    at, sent = t, p
            else:
                held = p
    return out


def logs(seed):
    rng, rows = random.Random(seed), []
    for task in "abc":
        t = 0
        for i in range(40):
            t += rng.choice([0, 1, 3, 20, 60])
            rows.append((task, t, i, rng.choice("xyz")))
    return rows


def test_throttle_over_logs(spark):
    rows = logs(1)
    got = timers.replay(spark.createDataFrame(rows, EVENTS), ["task"], timers.throttle(25), "at long, value string").collect()
    for task in "abc":
        assert sorted((r.at, r.value) for r in got if r.task == task) == brute_throttle([(t, p) for k, t, _, p in rows if k == task], 25)


def test_registry_over_logs(spark):
    beats = spark.createDataFrame([("a", 0, 0, ""), ("a", 8, 1, ""), ("a", 40, 2, ""), ("b", 5, 3, "")], EVENTS)
    got = sorted(tuple(r) for r in timers.replay(beats, ["task"], timers.registry(10), "at long, up boolean", until=45).collect())
    assert got == [("a", 0, True), ("a", 18, False), ("a", 40, True), ("b", 5, True), ("b", 15, False)]


@pytest.fixture
def streamed(spark, tmp_path):
    timers.with_timers(spark)

    def run(batches, make, name, wait=None):
        """Each batch is a file and a trigger; wait: seconds to go on after the last."""
        d = tmp_path / name
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").json(str(d / f"b{i}"))
            time.sleep(1.1)  # files go by their times
        q = make(streams.read_events(spark, str(d / "*"), EVENTS, files_per_batch=1)).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-c")).outputMode("append")
        q = q.trigger(availableNow=True).start() if wait is None else q.trigger(processingTime="500 milliseconds").start()
        try:
            if wait is None:
                q.awaitTermination(240)
            else:
                end = time.time() + 120
                while time.time() < end and not wait(spark.table(name).collect()):
                    time.sleep(0.5)
            states = sum(s["numRowsTotal"] for p in q.recentProgress[-1:] for s in p["stateOperators"])
        finally:
            q.stop()
        return [tuple(r) for r in spark.table(name).collect()], states

    return run


def test_stream_by_event_time_agrees_with_replay(spark, streamed):
    """Whatever the batches; the last event is late enough for all timers of the others, and silent keys leave no state."""
    rows = [(k, t + 1000, i, p) for k, t, i, p in logs(2)]  # a watermark begins at 0, and what is not after it is late
    rows.sort(key=lambda r: (r[1], r[2]))
    end = [("end", 10**6, 99, "x")]
    timed = timers.throttle(25, 100)
    watermarked = lambda s: timers.follow(s.withColumn("event_ts", F.timestamp_millis("ts")).withWatermark("event_ts", "0 seconds"), ["task"], timed, "at long, value string")
    got, states = streamed([rows[:50], rows[50:], end], watermarked, "by_event_time")
    want = [tuple(r) for r in timers.replay(spark.createDataFrame(rows + end, EVENTS), ["task"], timed, "at long, value string", until=10**6).collect()]
    assert sorted(got) == sorted(want)
    assert states <= 4  # of the one key that is left: state, timer and their indexes


def test_stream_by_the_clock(spark, streamed):
    """A held value comes without an event when the gap is over, and a runner goes by itself."""
    batches = [[("a", 0, 0, "x"), ("a", 0, 1, "y")]]
    follow = lambda s: timers.follow(s, ["task"], timers.throttle(2000), "at long, value string", by_clock=True)
    got, _ = streamed(batches, follow, "by_clock", wait=lambda rows: len(rows) == 2)
    assert [v for _, _, v in sorted(got)] == ["x", "y"] and got[1][1] - got[0][1] == 2000
    beats = lambda s: timers.follow(s, ["task"], timers.registry(1500), "at long, up boolean", by_clock=True)
    got, _ = streamed(batches, beats, "beats", wait=lambda rows: len(rows) == 2)
    assert [u for _, _, u in sorted(got)] == [True, False]
