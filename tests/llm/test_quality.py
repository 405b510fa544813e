import re
from collections import Counter

import numpy as np

from tarnfold.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)]


def test_counts_against_brute_force(small, spark):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    texts = {r.doc_id: r.text for r in small.collect()}
    out = quality.judge(small, labels).collect()
    assert len(out) == len(texts)
    for r in out:
        want = brute(texts[r.doc_id])
        assert [r[c] for c in quality.COUNTS] == want
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert r.base_failed == failed and not (failed and r.kept)


def test_edge_cases(make, spark):
    texts = [None, "", "\n\n", "a b c d e " * 3, "x\x0by z q", "very " * 300_000, "é" * 30]
    docs = make([(i, t) for i, t in enumerate(texts)] + [(0, None)])
    labels = spark.createDataFrame([(0, 1, 0), (None, 0, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    out = quality.judge(docs, labels).collect()
    assert len(out) == len(texts) + 1
    for r in out:
        assert [r[c] for c in quality.COUNTS] == brute(texts[r.doc_id])
        assert r.base_failed and not r.kept
    assert quality.judge(make([]), labels).count() == 0
    assert quality.keep(docs, labels).columns == docs.columns


def test_repeated_where_numbers_would_overflow():
    ids = np.array(list(range(7)) * 2 + [9])
    assert quality.repeated(ids, 1 << 30) == quality.repeated(ids, 10) == 14


def test_learns_and_prunes():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 3))
    bad = (x[:, 0] > 0.8) | ((x[:, 1] > 0.5) & (x[:, 2] <= 0.3))
    rules = quality.learn(x.tolist(), bad.tolist(), ["word_length", "symbol_share", "upper_share"], precision=0.9)
    got = np.zeros(len(x), bool)
    for r in rules:
        got |= r.matches(x, ["word_length", "symbol_share", "upper_share"])
    assert (got == bad).mean() > 0.95 and all(r.precision >= 0.9 for r in rules)


def test_held_out_accuracy(spark):
    """Learned on one half of the labelled rows; on the other, clean documents stay and most bad ones go."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = quality.judge(docs, labels.where("doc_id % 2 = 0")).where("not base_failed").join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    good = [r.kept for r in out if r.quality == 1]
    bad = [r.kept for r in out if r.quality == 0]
    assert len(good) > 50 and len(bad) > 5
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.3 * len(bad)


def test_keep_goes_by_texts_and_not_by_ids(make, spark):
    """Of rows that share an id, or have none, those go whose own text is bad; nothing is exchanged for it."""
    good, bad = " ".join(f"word{i}" for i in range(40)), "too few"
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = make([(None, good), (None, bad), (None, good + " more"), (None, None), (1, good), (1, bad), (1, good)])
    out = quality.keep(docs, labels)
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == [(0, good), (0, good + " more"), (1, good), (1, good)]
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert quality.keep(make([]), labels).count() == 0


def test_keep_and_judge_learn_the_same(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    assert sorted(r.doc_id for r in quality.keep(docs, labels).collect()) == sorted(r.doc_id for r in quality.judge(docs, labels).where("kept").collect())


def test_judge_and_keep_learn_from_one_sample(spark):
    """More labels than the sample takes: both ways learn the same rules, so they keep the same rows."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    for rows_max in (60, 150):
        judged = {r.doc_id for r in quality.judge(docs, labels, rows_max=rows_max).where("kept").collect()}
        assert judged == {r.doc_id for r in quality.keep(docs, labels, rows_max=rows_max).select("doc_id").collect()}
