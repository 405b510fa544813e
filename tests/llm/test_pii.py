import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tarnfold.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, m):
    d = [int(c) for c in m if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "phone":
        return 9 <= len(d) <= 15
    if kind == "card":
        return 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0
    return True


def brute(text):
    found = sorted((m.start(), k, m.end()) for k, kind in enumerate(pii.KINDS) for m in re.finditer(PLAIN[kind], text or "") if passes(kind, m.group()))
    return [sum(k == i for _, k, _ in found) for i in range(4)], ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in found)


def check(docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = pii.personal_data(docs).collect()
    for r in out:
        n, listed = brute(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == n, (r, texts[r.doc_id][:200])
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(listed.split(",")) - {""} <= set(r.spans.split(","))
    return out


def test_against_brute_force(spark):
    out = check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert sum(r.n_email for r in out) > 10 and sum(r.n_card for r in out) > 5
    assert sum(r.n_discovered for r in out) <= 0.01 * len(out)


CASES = [
    None, "", "a@b", "a@b.c_d@e.f", "a@b.c.@d.e x.@y.z", "é.a@b.co", "@@a@b.c@d.e.f", "1.2.3.4.5.6.7.8", "256.1.1.1 001.002.003.004 1..2.3.4.5 99999999999999999999.1.1.1",
    "4111 1111 1111 1111", "4111-1111-1111-1111-", "411111111111111 1", "4111  1111 1111 1111", "+1 (613) 555-8758", "+1--2", "+12", "+49.30.1234567 +1+23456789012", "𝒳 é 4111111111111111 +1 613 555 87588 z@z.zz",
]


def test_edge_cases(make):
    docs = make([(i, t) for i, t in enumerate(CASES)] + [(None, "x"), (0, None)])
    assert len(check(docs)) == len(CASES) + 2
    assert pii.personal_data(make([])).count() == 0


@pytest.mark.parametrize("text", ["1" * 15_000, "1 " * 60_000, "a" * 20_000, "a." * 10_000 + "@", "1." * 10_000, "+1 (" * 30_000, "x@" * 50_000, "-" * 20_000, "a@b.c " * 2_000, "+1 613 555 8758, " * 9_000, "a at b dot c " * 9_000])
def test_long_and_hostile_texts(make, text):
    check(make([(1, text)]))


def test_contexts_find_what_the_patterns_miss(make):
    """Seeds after a label make the label a pattern, which then finds what no base pattern matches."""
    known = [(i, f"Please write to my mail: user{i}@host{i}.org today, thanks") for i in range(8)]
    hidden = [(100, "Please write to my mail: user77(at)secret.org today, thanks"), (101, "There are 12345 sheep: 77777 black and 123-456 white")]
    out = {r.doc_id: r for r in check(make(known + hidden))}
    assert out[100].n_discovered == 1 and out[100].n_email == 0
    text = dict(hidden)[100]
    kind, s, e = out[100].spans.split(":")
    assert kind == "email" and text[int(s) : int(e)] == "user77(at)secret.org"
    assert out[101].n_discovered == 0


def test_sums_before(spark):
    for n in (0, 1, 63, 64, 65, 4096, 4097, 20_000):
        r = spark.range(1).select(F.sequence(F.lit(1), F.lit(n)) if n else F.array().cast("array<int>")).toDF("x").select(pii.sums_before(F.col("x")).alias("y")).first()
        assert r.y == [k * (k + 1) // 2 for k in range(n)]


def test_very_many_matches_take_time_in_proportion(make):
    """Five times the addresses, at most five times the time (and some more for the noise of a shared machine)."""

    def seconds(n):
        docs = make([(1, "a@b.c " * n)])
        start = time.time()
        assert pii.personal_data(docs).first().n_email == n
        return time.time() - start

    seconds(1000)
    assert seconds(170_000) <= 5 * seconds(34_000) + 5


def planted(seed):
    """(known, hidden, other) documents: seeds in 8 contexts, unseen identifiers in the same, and numbers and words in others."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    email = ["please write to {} for more", "contact: {} or the front desk", "my e-mail is {}, thanks", "Reply-To: {} (private)"]
    phone = ["you can call me at {} after noon", "Tel.: {} ask for the office"]
    ip = ["login failed from host {} port open", "client_ip={} status ok"]
    seeds = lambda kind: {"email": f"{word()}{digits(2)}@{word()}.org", "phone": f"+1 {digits(3)} {digits(3)} {digits(4)}", "ip": f"10.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}"}[kind]
    unseen = {
        "email": [lambda: f"{word()}(at){word()}.org", lambda: f"{word()} at {word()} dot org", lambda: f"{word()}[at]{word()}[dot]com", lambda: f"{word()}{digits(2)}@{word()}"],
        "phone": [lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"{digits(3)}/{digits(7)}", lambda: f"0{digits(3)} {digits(6)}"],
        "ip": [lambda: f"fe80-{digits(4)}-{digits(4)}", lambda: f"10.{digits(2)}.{digits(2)}.x{digits(1)}"],
    }
    known, hidden, other = [], [], []
    for kind, frames in (("email", email), ("phone", phone), ("ip", ip)):
        for f in frames:
            for _ in range(60):
                known.append(f"{word()} {word()} " + f.format(seeds(kind)) + f" {word()}")
            for k in range(30):
                what = unseen[kind][k % len(unseen[kind])]()
                hidden.append((f"{word()} {word()} " + f.format(what) + f" {word()}", kind, what))
    frames = ["in the year {} we met", "about {} sheep were seen", "meet me at {} sharp", "room {} is free", "we looked at {} dot prints", "version {} of it", "see page {} for more"]
    for f in frames:
        other += [f"{word()} " + f.format(digits(rng.choice([2, 4, 7]))) + f" {word()}" for _ in range(40)]
    return known, hidden, other


@pytest.mark.parametrize("seed", [5, 6])
def test_recall_of_planted_unseen_identifiers(make, seed):
    """240 identifiers that no base pattern matches, of three kinds and nine forms, among seeds and plain numbers."""
    known, hidden, other = planted(seed)
    texts = [*known, *[t for t, *_ in hidden], *other]
    out = {r.doc_id: r for r in pii.personal_data(make(list(enumerate(texts)))).collect()}
    caught = 0
    for k, (t, kind, what) in enumerate(hidden, len(known)):
        s = t.index(what)
        caught += f"{kind}:{s}:{s + len(what)}" in out[k].spans.split(",")
    wrong = sum(out[k].n_discovered for k in range(len(texts)) if k < len(known) or k >= len(known) + len(hidden))
    print(f"recall {caught / len(hidden):.3f} of {len(hidden)}, {wrong} spans in {len(known) + len(other)} documents without any")
    assert len(hidden) == 240 and caught >= 0.95 * len(hidden) and wrong <= 0.01 * len(texts)


@pytest.mark.parametrize(
    "text, want",
    [
        ("call (560) 484-7883 now", "(560) 484-7883"), ("mail w99@w (private)", "w99@w"), ("mail (w99@w) now", "w99@w"), ("at (12) (34", "(12) (34"), ("see ((5) it", "5"), ("x (a1", "a1"),
        ("about 7 of", "7"), ("call 0123 456789, or", "0123 456789"), ("on 10.23.45.x7.", "10.23.45.x7"), ("to jo(at)ex.org for", "jo(at)ex.org"), ("%%--", None),
    ],
)
def test_what_an_instance_is(spark, text, want):
    near = spark.createDataFrame([(text,)], "text string").select(pii.stretches(F.col("text")).alias("x")).first().x
    assert [text[r.s : r.e] for r in near] == ([want] if want else [])


def test_context_words_of_any_length(spark):
    """The words around stand whatever comes between; a long one is known by its digest."""
    far = "a" * 5000
    text = f"Mail  {far}:{' ' * 3000}x1@y{' ' * 3000}{far} z"
    (r,) = spark.createDataFrame([(text,)], "text string").select(pii.stretches(F.col("text")).alias("x")).first().x
    assert (r.l2, r.l1, r.label, r.r1) == ("mail", hashlib.sha256(f"{far}:".encode()).hexdigest(), True, hashlib.sha256(far.encode()).hexdigest())


def brute_graph(seen, support, threshold):
    """{inst: kind} of what the rounds make known. seen: (inst, kind or None, patterns)."""
    edges = {(i, p) for i, _, ps in seen for p in ps}
    known = {}
    for i, k, _ in seen:
        if k is not None:
            known[i] = (min(k, known.get(i, (k,))[0]), 1.0)
    found = {}
    while True:
        good = {}
        for p in {p for _, p in edges}:
            insts = [i for i, q in edges if q == p]
            for k in range(4):
                mine = [known[i][1] for i in insts if i in known and known[i][0] == k]
                share = sum(mine) / len(insts) * (1 - 1 / (1 + len(mine)))
                if len(insts) >= support and len(mine) >= support and share >= threshold:
                    good[p, k] = share
        now = {}
        for i in {i for i, _ in edges} - set(known):
            votes = {}
            for (p, k), share in good.items():
                digits = sum(c.isdigit() for c in i)
                shape = {0: "@" in i, 1: i.count(".") > 1 and digits >= 4, 2: 12 <= digits <= 19, 3: 7 <= digits <= 15}[k]
                if (i, p) in edges and shape:
                    votes[k] = 1 - (1 - votes.get(k, 0)) * (1 - share)
            best = max(votes, key=lambda k: (votes[k], -k), default=None)
            if best is not None and votes[best] >= threshold:
                now[i] = (best, votes[best])
        if not now:
            return {i: k for i, (k, _) in found.items()}
        found |= now
        known |= {i: (k, pii.FAITH * v) for i, (k, v) in now.items()}


def test_graph_against_brute_force(spark):
    """Random contexts and instances of all shapes; some contexts are of one kind, some mixed, one is very common."""
    rng, rows = random.Random(8), []
    for n in range(1500):
        k = rng.choice([0, 0, 3, 3, 1, None, None, None])
        digits = "".join(rng.choice("0123456789") for _ in range(rng.choice([3, 8, 13])))
        inst = {0: f"u{n % 90}@h", 1: f"10.{n % 70}.11.1", 3: digits, None: digits}[k]
        left = rng.choice(["me at", "mail to", "host is", "in year", "the"]) if k is None or rng.random() < 0.2 else {0: "mail to", 1: "host is", 3: "me at"}[k]
        l2, _, l1 = left.rpartition(" ")
        rows.append((inst, k if rng.random() < 0.7 else None, l2, l1 + rng.choice(["", ":"]), rng.choice(["", "or", "and"])))
    seen = spark.createDataFrame([(*r[:4], r[3].endswith(":"), r[4]) for r in rows], "inst string, k int, l2 string, l1 string, label boolean, r1 string")
    patterns = lambda l2, l1, r1: [x for x in (l2 and f"before {l2} {l1}", l1.endswith(":") and f"label {l1}", l1 and r1 and f"around {l1} {r1}") if x]
    want = brute_graph([(i, k, patterns(l2, l1, r1)) for i, k, l2, l1, r1 in rows], 3, 0.5)
    out = pii.discover(seen, 3, 0.5)
    assert {r.inst: r.k for r in out.collect()} == want and len(want) > 20


def test_a_hot_context(make):
    """One context holds half of all instances, most of them plain numbers: it is no pattern, and a sure one beside it is."""
    texts = [f"we are at {k:07d} today" for k in range(3000)] + [f"call me at +1 555 {k:03d} 1234 please" for k in range(300)] + [f"call me at 555/{k:07d} please" for k in range(40)]
    out = {r.doc_id: r for r in pii.personal_data(make(list(enumerate(texts)))).collect()}
    assert sum(out[k].n_discovered for k in range(3300)) == 0 and sum(out[k].n_discovered for k in range(3300, 3340)) == 40
