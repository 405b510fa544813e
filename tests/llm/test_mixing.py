import math
from collections import Counter
from fractions import Fraction

import pytest

from tarnfold.llm import mixing


@pytest.mark.parametrize("weights", [{"a": 1, "b": 1}, {"a": 5, "b": 3, "c": 1.7, "d": 0.2}, {"a": 1}, {f"s{i}": 1 + i % 7 for i in range(40)}])
def test_less_than_one_block_off(weights):
    share = mixing.shares(weights, 200)
    assert sum(share.values()) == 200 and min(share.values()) >= 1
    cycle, had = mixing.one_period(share), Counter()
    for t, s in enumerate(cycle, 1):
        had[s] += 1
        assert all(abs(had[x] - a * t / 200) < 1 for x, a in share.items())
    assert had == share


def test_phases_place_every_block():
    blocks, weights = {"a": 1234, "b": 7, "c": 90, "d": 1}, {"a": 1, "b": 2, "c": 1, "d": 9}
    seen, end, last = Counter(), 0, None
    for slot, before, cycle, took in mixing.phases(blocks, weights, 50):
        assert slot >= end and all(seen[s] == n for s, n in before.items())
        end = slot
        seen.update(took)
        last = {s for s, n in took.items() if n}
    assert seen == blocks and last == {"a"}


def test_schedule_keeps_to_the_weights(make):
    """With a hot source: all rows once, one block a slot, and less than one block off while all sources last."""
    docs = make([(i, f"text {i} " * 5) for i in range(3000)], source=lambda k: "hot" if k % 3 else f"s{k % 4}")
    weights = {"hot": 4, "s0": 2, "s1": 1, "s2": 1, "s3": 2}
    out = mixing.schedule(docs, weights, block=2000, period=100, chunk=4).collect()
    assert sorted(r.doc_id for r in out) == list(range(3000))
    slots = {(r.source, r.block): r.slot for r in out}
    assert all(slots[r.source, r.block] == r.slot for r in out) and len(set(slots.values())) == len(slots)
    first = sorted((r.slot, r.source) for r in {(r.slot, r.source): r for r in out if r.phase == 0}.values())
    had, total = Counter(), sum(weights.values())
    for slot, s in first:
        had[s] += 1
        assert all(abs(had[x] - w * (slot + 1) / total) < 1.01 for x, w in weights.items())
    sizes = Counter()
    for r in out:
        sizes[r.source, r.block] += r.size
    assert all(0.7 * 2000 < n < 1.4 * 2000 for n in sizes.values())


def test_edge_cases(make, spark):
    docs = make([(1, None), (1, None), (None, "x"), (2, "y " * 400_000), (3, "")], source=lambda k: None if k < 2 else "s")
    out = mixing.schedule(docs, block=1000).collect()
    assert len(out) == 5 and {r.source for r in out} == {"", "s"}
    mixed = mixing.mix(docs, block=1000)
    assert mixed.columns == docs.columns and mixed.count() == 5
    assert mixing.schedule(make([])).count() == 0 and mixing.mix(make([])).count() == 0


def test_written_order_follows_slots(make, tmp_path, spark):
    docs = make([(i, f"text {i} " * 5) for i in range(1000)], source=lambda k: f"s{k % 2}")
    mixing.mix(docs, block=1000, period=10).write.parquet(str(tmp_path / "m"))
    from tarnfold.llm import sharding

    back = spark.read.parquet(str(tmp_path / "m"))
    order = [r.source for r in back.withColumn("k", sharding.written_order()).orderBy("k").collect()]
    for start in range(0, 1000, 200):
        assert 70 <= sum(s == "s0" for s in order[start : start + 200]) <= 130


@pytest.mark.parametrize(
    "weights",
    [{f"src{i:02}": (1 + i) ** -0.7 for i in range(20)}, {"a": 10000, "b": 1, "c": 1}, {"hot": 500} | {f"s{i}": 1 for i in range(1000)}, {"a": 1 / 3, "b": 1e-9, "c": 2 / 3}],
)
def test_less_than_one_block_off_the_target(weights):
    """Of the weights themselves, at every slot of tens of thousands of blocks."""
    total, had, at = sum(weights.values()), Counter(), 0
    for slot, before, piece, _ in mixing.phases(dict.fromkeys(weights, 20_000), weights, 1000):
        if slot >= 30_000 or len(before) < len(weights):
            break
        for s in piece:
            at += 1
            had[s] += 1
            assert abs(had[s] - weights[s] / total * at) < 1 + 1e-6
        assert all(abs(had[x] - w / total * at) < 1 + 1e-6 for x, w in weights.items())
    assert at >= 20_000


def test_schedule_of_many_blocks_keeps_to_the_target(spark):
    """A source of weight 1/3 beside 1000 others, and a rare one: as many blocks of the first slots as they ask for."""
    blocks = {"hot": 20_000, "rare": 10} | {f"s{i}": 100 for i in range(1000)}
    weights = {"hot": 500.0, "rare": 0.1} | {f"s{i}": 1.0 for i in range(1000)}
    rows = mixing.slots_of(spark, blocks, weights, 1000).collect()
    assert Counter(r.source for r in rows) == blocks and sorted(r.slot for r in rows) == list(range(sum(blocks.values())))
    first, total = Counter(r.source for r in rows if r.slot < 30_000), sum(weights.values())
    assert {r.phase for r in rows if r.slot < 30_000} == {0}
    assert all(abs(first[s] - w / total * 30_000) < 1 + 1e-6 for s, w in weights.items())


def brute(weights, slots):
    """Earliest deadline first over the weights as fractions, looking at every source in every slot; ties by name."""
    total, had, out = sum(Fraction(w) for w in weights.values()), Counter(), []
    exact = {s: Fraction(w) / total for s, w in weights.items() if w}
    for t in range(slots):
        ready = [(math.ceil((had[s] + 1) / w), s) for s, w in exact.items() if math.floor(had[s] / w) <= t]
        had[min(ready)[1]] += 1
        out.append(min(ready)[1])
    return out


@pytest.mark.parametrize("weights", [{"a": 0.7, "b": 0.2, "c": 0.06, "d": 0.04}, {"a": 1, "b": 1, "c": 1}, {"a": 1, "b": 1e-6}, {"hot": 0.5} | {f"s{i:03}": 0.5 / 499 for i in range(499)}])
def test_against_a_brute_force_schedule_of_the_asked_weights(weights):
    n = 3000 if len(weights) > 100 else 12_000
    got = []
    for _, before, piece, _ in mixing.phases(dict.fromkeys(weights, n), weights, 1000):
        if len(got) >= n or len(before) < len(weights):
            break
        got += piece
    had, total = Counter(), sum(weights.values())
    want = brute(weights, n)
    for t, (g, w) in enumerate(zip(got, want, strict=False), 1):
        had[g] += 1
        assert abs(had[g] - weights[g] / total * t) < 1 + 1e-6
        if len(weights) < 100:
            assert g == w, t
    assert len(got) >= n


def test_weights_are_given_for_all_or_none(make):
    docs = make([(i, f"text {i} " * 5) for i in range(300)], source=lambda k: "ab"[k % 2])
    out = mixing.schedule(docs, {"a": 1, "b": 0}, block=1000).collect()
    assert len(out) == 300 and all((r.slot is None) == (r.source == "b") for r in out)
    assert {r.source for r in mixing.mix(docs, {"a": 1, "b": 0}, block=1000).collect()} == {"a"}
    assert mixing.mix(docs, {"a": 0, "b": 0}, block=1000).count() == 0
    for wrong in ({"a": 1}, {"a": 1, "b": -1}, {"a": 1, "b": float("nan")}):
        with pytest.raises(ValueError):
            mixing.schedule(docs, wrong)


def test_rows_mix_each_for_itself(make):
    """Null and repeated ids, and copies of a row that are half of the table, spread over all slots."""
    docs = make([(None if k % 2 else 5, "same words again" if k % 3 else f"text {k}") for k in range(900)], source=lambda k: "s")
    rows = mixing.mix(docs, block=1000, chunk=2).collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in docs.collect())
    for at in range(0, 900, 300):
        assert 150 <= sum(r.text == "same words again" for r in rows[at : at + 300]) <= 250
