"""Step-by-step helpers against plain versions: distances, fuzzy places, cache points, commands."""

import random
import time

import pytest

from tarnfold.functions import sequential, shell
from tarnfold.operators import search


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1]


def test_distance():
    rng = random.Random(1)
    for _ in range(600):
        a, b = ("".join(rng.choice("abcé") for _ in range(rng.choice([0, 1, 3, 9, 70, 140]))) for _ in range(2))
        assert sequential.edit_distance(a, b) == plain_distance(a, b)


def plain_middle_out(lines, chunk, first, last):
    """Every window from the middle outwards, each compared."""
    n, best, where, text = len(chunk), 0.0, -1, "\n".join(chunk)
    left = (first + last) // 2
    right = left + 1
    while left >= first or right <= last - n:
        for i in ([left] if left >= first else []) + ([right] if right <= last - n else []):
            a, b = sequential.plain("\n".join(lines[i : i + n])), sequential.plain(text)
            score = 0.0 if not text else 1.0 if a == b else 1 - plain_distance(a, b) / max(len(a), len(b))
            if score > best:
                best, where = score, i
        left, right = left - 1, right + 1
    return best, where


def test_middle_out():
    """Ties, windows over the end, quotes and white space, ranges, chunks longer than the lines."""
    rng = random.Random(3)
    for _ in range(400):
        lines = ["".join(rng.choice(["a", "b", " ", "  ", "’", "—"]) for _ in range(rng.randrange(5))) for _ in range(rng.randrange(1, 14))]
        chunk = ["".join(rng.choice(["a", "b", " ", "'", "-"]) for _ in range(rng.randrange(5))) for _ in range(rng.randrange(1, 5))]
        first = rng.choice([0, 0, rng.randrange(len(lines))])
        last = rng.choice([len(lines), rng.randrange(first, len(lines) + 1)])
        assert sequential.middle_out(lines, chunk, first, last) == pytest.approx(plain_middle_out(lines, chunk, first, last)), (lines, chunk, first, last)


def test_ten_thousand_lines():
    """At least ten times as fast as comparing every window by the table of distances."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    lines = [" ".join(word() for _ in range(8)) for _ in range(10_000)]
    chunk = [x.replace("a", "b", 1) for x in lines[7000:7005]]
    start = time.time()
    score, where = sequential.middle_out(lines, chunk)
    fast = time.time() - start
    assert where == 7000 and 0.9 < score < 1
    start = time.time()
    for i in range(20):
        plain_distance("\n".join(lines[i : i + 5]), "\n".join(chunk))
    assert fast < (time.time() - start) / 20 * 10_000 / 10


def plain_points(tokens, roles, most, least, before):
    """The rules of the placement, one after another, over plain lists."""
    n = len(tokens)

    def in_range(a, b):
        if a >= b:
            return None
        for i in range(b, a - 1, -1):
            if roles[i] == "user":
                prev = max([p for p in before if p < a], default=-1)
                return i if sum(tokens[prev + 1 : i + 1]) >= least else None
        return None

    if n <= 1:
        return []
    out = []
    if not before:
        at = 0
        while at < n and len(out) < most:
            p = in_range(at, n - 1)
            if p is None:
                break
            out.append(p)
            at = p + 1
        return out
    fresh = sum(tokens[before[-1] + 1 :])
    if fresh >= least and most > len(before):
        p = in_range(before[-1] + 1, n - 1)
        return before + ([p] if p is not None else [])
    if fresh >= least:
        between = [sum(tokens[a + 1 : b + 1]) for a, b in zip([-1, *before], before, strict=False)]
        gaps = [between[i] + between[i + 1] for i in range(len(between) - 1)]
        if gaps and fresh >= 1.2 * min(gaps):
            k, i = gaps.index(min(gaps)), 0
            while i < len(before):
                if i == k:
                    p = in_range(0 if i == 0 else before[i - 1] + 1, before[i + 1])
                    out += [p] if p is not None else []
                    i += 1
                else:
                    out.append(before[i])
                i += 1
            p = in_range(before[-1] + 1, n - 1) if len(out) < most else None
            return out + ([p] if p is not None else [])
    return list(before)


def test_cache_points_of_growing_conversations():
    rng, merged, kept = random.Random(6), 0, 0
    for _ in range(300):
        most, least = rng.choice([1, 2, 3, 4]), rng.choice([1, 20, 50])
        tokens, roles, points = [], [], []
        for _ in range(25):
            tokens.append(rng.choice([1, 5, 30, 100]))
            roles.append(rng.choice(["user", "assistant"]))
            got = sequential.cache_points(tokens, roles, most, least, points)
            assert got == plain_points(tokens, roles, most, least, points), (tokens, roles, most, least, points)
            merged += len(points) == most and got != points
            kept += len(points) == most and got == points
            points = got
    assert merged > 50 and kept > 50


CASES = [
    ("echo ${x@P}", "ask"), ("echo ${x@Q} y", "ask"), ("echo ${x@z}", "approve"), ("echo ${v=\\140ls\\140}", "ask"), ("echo ${v:-\\x60id\\x60}", "ask"), ("echo ${v:+\\u0060}", "ask"), ("echo ${v:-plain}", "approve"),
    ("echo ${!name}", "ask"), ("cat <<<$(whoami)", "ask"), ("cat <<< `id`", "ask"), ("cat <<<word", "approve"), ("cat =(ls)", "ask"), ("cat;=(ls)", "ask"), ("x=(a b)", "approve"), ("ls *(e:whoami:)", "ask"), ("ls ?(e:x:)", "ask"),
    ("echo $(whoami)", "ask"), ("echo $(cat f)", "approve"), ("echo $(rm -rf /)", "deny"), ('echo "$(rm x)"', "deny"), ("echo `rm x`", "deny"), ("cat <(rm x)", "deny"), ("echo 'a; rm x'", "approve"), ('echo "a && rm x"', "approve"),
    ("echo a; rm x", "deny"), ("echo a | cat", "approve"), ("echo a & who", "ask"), ("echo a 2>&1", "approve"), ("echo a\nrm x", "deny"), ("echo a\r\n\r\ncat b", "approve"), ("rm --help", "approve"), ("RM x", "deny"), ("", "approve"), ("  ", "approve"), (None, "ask"),
    ("echo $((1 + 2)) && cat", "approve"), ("echo ${a;rm}", "approve"), (r"echo \; rm", "approve"), ("who ${x@P}; rm y", "deny"), ('echo "const f = (x) => x * 2"', "approve"), ("echo $(echo $(rm y))", "deny"), ("echo $(", "approve"),
]


def test_command_decisions(spark):
    rules = spark.createDataFrame([("echo", True), ("cat", True), ("ls", True), ("x=", True), ("rm", False), ("rm --help", True)], "prefix string, allow boolean")
    lines = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(CASES)], "id int, command string")
    got = {r.id: r.decision for r in search.command_decisions(lines, rules).collect()}
    assert [(c, got[i]) for i, (c, _) in enumerate(CASES)] == CASES
    parts = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(CASES[:16])], "id int, part string")
    danger = {r.id for r in search.chain_decision(parts, rules).where("decision = 'ask'").collect()}
    assert danger >= {i for i, (_, d) in enumerate(CASES[:16]) if d == "ask"}


def test_commands_of_lines():
    assert shell.commands("a 'b; c' | d \"e && f\" || g $(h; i) j & k") == ["a 'b; c'", "d \"e && f\"", "g", "h", "i", "j", "k"]
    assert shell.commands("a ${x:-y;z} $[1|2] $((3 & 4)) >&2") == ["a ${x:-y;z} $[1|2] $((3 & 4)) >&2"]
    assert shell.commands("(cd x && ls) > out") == ["(cd x", "ls) > out"]
