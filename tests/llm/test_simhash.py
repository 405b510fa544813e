import random
import re

import xxhash
from pyspark.sql import functions as F

from tarnfold.llm import common, simhash


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def brute_components(ids, fps):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, f in zip(ids, fps, strict=True):
        for b, g in zip(ids, fps, strict=True):
            if (f ^ g).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def test_against_brute_force(small):
    rows = small.collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    want = brute_components([r.doc_id for r in rows], fps)
    got = {r.doc_id: r for r in simhash.near_duplicates(small).collect()}
    assert {i: r.fingerprint for i, r in got.items()} == {r.doc_id: f"{f:016x}" for r, f in zip(rows, fps, strict=True)}
    assert {i: r.component_id for i, r in got.items()} == want


def test_edge_cases(make, spark):
    pairs = [(5, None), (3, ""), (9, " \t\n"), (1, "one"), (2, "ONE"), (2, "ONE"), (7, "word " * 200_000), (None, "one"), (8, "É a b"), (10, "é a b")]
    out = simhash.near_duplicates(make(pairs)).collect()
    assert len(out) == len(pairs)
    by = {r.doc_id: r for r in out}
    assert {by[i].fingerprint for i in (3, 5, 9)} == {"0" * 16} and {by[i].component_id for i in (3, 5, 9)} == {3}
    assert by[1].component_id == by[2].component_id == by[None].component_id == 1
    assert by[8].fingerprint != by[10].fingerprint  # only A-Z change case
    assert by[7].fingerprint == f"{brute_fingerprint('word word word'):016x}"
    assert simhash.near_duplicates(make([])).count() == 0


def test_no_link_is_lost_in_dense_buckets(spark):
    """Fingerprints within a few bits of each other, with buckets far over their size: refinement must find all."""
    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = {base}
    while len(fps) < 300:
        f = base
        for b in rng.sample(range(64), rng.choice([1, 2, 3, 6, 9])):
            f ^= 1 << b
        fps.add(f)
    fps = sorted(fps)
    nodes = spark.createDataFrame([(simhash.signed(f), i) for i, f in enumerate(fps)], "fp long, rep long")
    label = {r.v: r.label for r in simhash.components(simhash.near_links(nodes, bucket_size=8)).collect()}
    assert {i: label.get(i, i) for i in range(len(fps))} == brute_components(list(range(len(fps))), fps)


def test_every_pair_in_the_radius_collides():
    rng, tables = random.Random(1), simhash.masks()
    for _ in range(2000):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 3):
            b ^= 1 << bit
        assert any(a & m == b & m for m in tables)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200)], "a long, b long")
    got = {r.v: r.label for r in simhash.components(links).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {200: 100}


def test_keep_one(make):
    docs = make([(4, "a b c d e"), (2, "a b c d e"), (2, "a b c d e"), (6, "x y z u v w"), (None, "a b c d e")])
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [2, 6]


def test_keep_one_goes_by_texts_and_not_by_ids(make, monkeypatch):
    """Shared and null ids: one row of each group stays, and no text without a near copy goes."""
    one, two, three = "the first of several texts here", "quite another thing was said there", "nothing like it under the sun"
    docs = make([(1, one), (1, two), (None, three), (None, one), (None, None), (5, ""), (1, one), (None, "yet more words that differ")])
    for limit in (1_000_000, 0):
        monkeypatch.setattr(common, "BROADCAST_ROWS", limit)
        out = simhash.keep_one(docs).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in out) == [(False, 1, two), (False, 1, one), (False, 5, ""), (True, 0, three), (True, 0, "yet more words that differ")]
    assert simhash.keep_one(make([])).count() == 0


def test_third_level_buckets_are_small():
    """Each level fixes about half of the bits that are still free, so its buckets are bounded whatever the data."""
    full, kept = (1 << 64) - 1, simhash.masks()
    for most in (36, 17, 8):
        assert max(64 - k.bit_count() for k in kept) <= most
        kept = [k | m for k in kept for m in simhash.masks(full & ~k)]
