import zlib
from hashlib import sha256

import pytest

from tarnfold.llm import merkle

H = lambda parts: sha256("".join(parts).encode()).hexdigest()
KINDS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, rank long, block long, now string"


def leaf(row):
    return H(["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def lower(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def tree(nodes):
    """(root, for each node its siblings level by level as (left, right))."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            a = p - p % 8
            paths[i].append((nodes[a:p], nodes[p + 1 : a + 8]))
            at[i] = p // 8
        nodes = [H(nodes[a : a + 8]) for a in range(0, len(nodes), 8)]
    return nodes[0], paths


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text); {doc_id: what manifest() gives}."""
    langs = sorted({r[2] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    by = {s: sorted((r for r in rows if r[2] == s), key=lambda r: r[0]) for s in langs}
    trees = {s: tree([leaf(r) for r in by[s]]) for s in langs}
    root, tops = tree([trees[s][0] for s in langs])
    out = {}
    for k, s in enumerate(langs):
        for r, path in zip(by[s], trees[s][1], strict=True):
            whole = path + tops[k]
            now = leaf((*r[:4], lower(r[4]))) if zlib.crc32(str(r[0]).encode()) % 3 == 0 else leaf(r)
            for left, right in whole:
                now = H([*left, now, *right])
            out[r[0]] = (leaf(r), trees[s][0], root, H([x for left, right in whole for x in left + right]), now, now == root)
    return out


def check(spark, rows, **options):
    docs = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], KINDS)
    got = merkle.manifest(docs, tampered=merkle.lowered_third(docs), **options).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got} == brute(rows)
    return got


@pytest.mark.parametrize("levels, top", [(1, 1 << 17), (2, 1 << 17), (4, 1 << 17), (1, 3)])
def test_against_brute_force(spark, levels, top):
    """Langs of 1, 8, 9, 64, 65 and 600 rows and a null one; blocks of every size, and blocks that grow to suit the driver."""
    rows, k = [], 0
    for lang, n in ((None, 5), ("a", 1), ("", 8), ("B", 9), ("é", 64), ("zz", 65), ("en", 600)):
        for _ in range(n):
            rows.append((k * 7919 % 10007, None if k % 5 == 0 else f"s{k % 3}", lang, None if k % 4 == 0 else k, None if k % 11 == 0 else f"Text É {k} " * (k % 4)))
            k += 1
    got = check(spark, rows, levels=levels, top=top)
    assert 0.5 < sum(r.verified for r in got) / len(got) < 0.9


def test_small_tables(spark):
    assert merkle.manifest(spark.createDataFrame([], KINDS)).count() == 0
    (r,) = check(spark, [(3, "s", None, 1, "a B " * 200_000)])
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == H([])
    check(spark, [(3, "s", "a", 1, ""), (1, None, "b", None, None)])


def test_repeated_and_missing_ids(spark):
    """All rows are leaves, and all untampered ones fold to the root."""
    rows = [(i % 5 if i % 3 else None, "s", "en", 1, f"T {i // 2}") for i in range(90)]
    docs = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], KINDS)
    got = merkle.manifest(docs, levels=1).collect()
    assert len(got) == 90 and all(r.verified for r in got) and len({r.root for r in got}) == 1
    assert sorted(r.leaf for r in got) == sorted(leaf(r) for r in rows)
