import hashlib
import re

from tarnfold.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(texts, items):
    wins = {}
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - 9)) if w else []:
            wins.setdefault(tuple(w[s : s + 10]), set()).update([] if i is None else [str(i)])
    sizes = {len(w) for w in wins}
    out = []
    for i, t in texts:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (key := tuple(w[s : s + n])) in wins:
                    hit |= set(range(s, s + n))
                    found |= wins[key]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def explained(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def check(docs, bench, **options):
    texts, items = [(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()]
    got = sorted(map(tuple, decontam.contamination(docs, bench, **options).collect()), key=str)
    assert got == brute(texts, items)
    return got


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = check(docs, spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet"))
    assert any(r[5] for r in got)


def test_edge_cases(make, spark):
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    items = [(1, long), (2, "two words"), (3, None), (4, ""), (5, "!!"), (10, long), (None, "Solo"), (6, "a b a b a b a b a b a b"), (7, "p q r s t u")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [None, "", "...", long.upper(), f"x {long} {long} y", "two, WORDS two words", "solo", long[:40], "a b " * 40, "p q r s t u v", "q r s t u", "É two words é " * 3000, long]
    check(make([(i, t) for i, t in enumerate(texts)] + [(3, long), (None, long)]), bench)
    check(make([(i, t) for i, t in enumerate(texts)]), bench, broadcast_rows=1)  # by shuffled joins
    check(make([]), bench)
    check(make([(1, long)]), bench.limit(0))


def test_no_array_of_words_crosses_an_exchange(make, spark):
    """Small or large, a benchmark meets hashes and positions; a text's words are never copied for each of them."""
    docs = make([(1, "x a b c d e f g h i j k y")]).selectExpr("doc_id", "doc_id AS row", "struct(doc_id AS a, 2L AS b) AS key", "text")
    hashes = spark.range(5).selectExpr("id AS hash")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plans = {limit: explained(decontam.places(docs, hashes, [5, 2], 10, limit)) for limit in (0, 1000)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for limit, plan in plans.items():
        inputs = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)
        assert len(inputs) >= (3 if limit == 0 else 0), plan
        assert not any(re.search(r"(?<!_)words#", x) for x in inputs), inputs


def test_long_texts_by_shuffled_joins(make, spark):
    """One text of 100,000 words, each of which begins a shingle of the benchmark."""
    item = " ".join(f"w{i % 50}" for i in range(200))
    docs = make([(1, " ".join(f"w{i % 50}" for i in range(100_000))), (2, "w1 w2 w3"), (None, item), (None, "fine")])
    check(docs, spark.createDataFrame([(1, item)], "item_id long, text string"), broadcast_rows=1)


def test_clean_goes_by_texts_and_not_by_ids(make, spark):
    """Rows that share an id, or have none, stay or go each by its own text."""
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string")
    docs = make([(None, "a b c d e f g h i j"), (None, "fine"), (None, None), (None, "good"), (7, "x a b c d e f g h i j"), (7, "good"), (7, "good")])
    for limit in (1000, 1):
        out = decontam.clean(docs, bench, broadcast_rows=limit).collect()
        assert sorted((r.doc_id or 0, r.text or "") for r in out) == [(0, ""), (0, "fine"), (0, "good"), (7, "good"), (7, "good")]


def test_clean(make, spark):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string")
    docs = make([(1, "a b c d e f g h i j"), (2, "a b c d e f g h i"), (None, "fine"), (3, None)])
    out = decontam.clean(docs, bench)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {2, None, 3}


def test_a_window_that_many_items_share(make, spark):
    """10,000 items hold one header: each is listed for the texts with it, and no text is copied for them."""
    header = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    bench = spark.range(10_000).selectExpr("id AS item_id", f"concat('{header} number ', id, ' end') AS text")
    docs = make([(i, f"x {header} y") for i in range(20)] + [(30, header[:30]), (31, f"{header} number 77 end")])
    out = {r.doc_id: r for r in decontam.contamination(docs, bench).collect()}
    every = hashlib.sha256(",".join(sorted(map(str, range(10_000)))).encode()).hexdigest()
    assert all((out[i].n_hit, out[i].n_items, out[i].items_sha256) == (10, 10_000, every) for i in range(20))
    assert not out[30].contaminated and (out[31].n_hit, out[31].n_items) == (13, 10_000)


def test_items_of_one_common_word(make, spark):
    """Each place of the word is hit; long windows around it are found by their rarer shingles."""
    texts = ["the cat the dog the " * 50 + f"w{i}" for i in range(60)] + ["no such word", None, "the"]
    items = [(1, "the"), (2, "cat the"), (3, "the cat the dog the the cat the dog the w7 and more words"), (4, "the dog the the cat the dog the w8")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (1000, 1):
        check(make(list(enumerate(texts))), bench, broadcast_rows=limit)
