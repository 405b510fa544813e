import random
import re

import pytest
from pyspark.sql import functions as F

from tarnfold.llm import licences

SAID = {"apache": "Apache License", "mit": "MIT License", "gpl": "GNU General", "cc": "CC BY", "proprietary": "All rights reserved"}


def test_driver_documents(spark):
    """The corpus's licence lines are found and confirmed, and documents without any stay clean."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = licences.scan(docs).join(docs.select("doc_id", "text"), "doc_id").collect()
    assert len(rows) == 1000
    for r in rows:
        want = sorted(f for f, s in SAID.items() if s in r.text)
        assert r.families == ",".join(want), r
        assert want or r.n_unconfirmed + r.n_unknown == 0, r


@pytest.fixture(scope="module")
def fillers():
    return [(i, f"ordinary words about topic {i} and other things we saw\nsecond line {i} here") for i in range(100, 160)]


def test_edge_cases(make, fillers):
    apache = licences.TEMPLATES["apache"][0]
    cases = [(1, None), (2, ""), (3, "\n\n"), (4, f"text\n{apache}\nmore"), (4, "x"), (None, "Released under the MIT License."), (5, apache.upper()), (6, "plain words " * 100_000), (7, licences.OTHER[0])]
    out = licences.scan(make([*cases, *fillers])).collect()
    assert len(out) == len(cases) + len(fillers)
    got = {}
    for r in out:
        got.setdefault(r.doc_id, set()).add(r.families)
    assert got[1] == got[2] == got[3] == got[6] == {""} and got[4] == {"", "apache"} and got[None] == {"mit"} and got[5] == {"apache"}
    assert all(got[i] == {""} for i, _ in fillers)
    other = next(r for r in out if r.doc_id == 7)
    assert other.families == "" and other.n_unknown + other.n_unconfirmed == 1
    assert licences.scan(make([])).count() == 0


@pytest.fixture(scope="module")
def model(spark, make, fillers):
    return licences.train(make(fillers).select("doc_id", "text"))


def scored(spark, model, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, p string").withColumn("ws", licences.words(F.col("p")))
    return model.score(rows).orderBy("k").collect()


def test_families_and_their_neighbours(spark, model):
    """Every text goes to its own family, and likenesses of licences, and ordinary sentences, to none."""
    assert len(licences.TEMPLATES) >= 15 and {"lgpl", "agpl", "isc", "cc0", "unlicense", "bsd"} <= set(licences.TEMPLATES)
    texts = [(f, t) for f, ts in licences.TEMPLATES.items() for t in ts]
    rows = scored(spark, model, [t for _, t in texts])
    assert sum(r.label == f for r, (f, _) in zip(rows, texts, strict=True)) >= 0.95 * len(texts)
    odd = scored(spark, model, licences.OTHER)
    assert sum(r.label == licences.NONE or r.probability < model.bound for r in odd) >= len(odd) - 1
    plain = scored(spark, model, licences.ORDINARY)
    assert all(r.label == licences.NONE or not r.looks for r in plain)


def test_held_out_texts(spark, fillers):
    """Texts that training did not see: what goes to a family with a probability over one half goes to its own."""
    rows = licences.pieces(spark).withColumn("ws", licences.words(F.col("text")))
    trial = licences.Fit(rows.where("not held"), licences.VOCABULARY)
    held = licences.Model(trial, 1.0, 0.5).score(rows.where("held and whole").withColumnRenamed("label", "truth")).collect()
    sure = [r for r in held if r.truth != licences.NONE and r.label != licences.NONE and r.looks and r.probability >= 0.5]
    right = sum(r.label == r.truth for r in sure)
    print(f"{right} of {len(sure)} sure ones right, {sum(r.truth != licences.NONE for r in held)} held-out texts")
    assert len(sure) >= 5 and right >= 0.7 * len(sure)
    assert all(r.label == licences.NONE or not r.looks for r in held if r.truth == licences.NONE)


def test_lines_without_a_telling_word_are_none(spark, make, model):
    """The gate loses nothing: what it leaves out has no feature, whatever the words."""
    lines = ["Unless required by applicable law or agreed to in writing, software", "of the software, and to use the copies", "THE AFFERO AFFEROS licensedx", "nothing here", "a licensed one"]
    docs = make([(k, t) for k, t in enumerate(lines)]).select("doc_id", "text", "row")
    got = {r.doc_id for r in licences.candidates(docs, model).where("p is not null").collect()}
    words = [set(re.findall(r"[^\W_]+", t.lower())) for t in lines]
    assert got == {k for k, w in enumerate(words) if w & set(model.telling)}
    assert all(r.label == licences.NONE for k, r in enumerate(scored(spark, model, lines)) if k not in got)
    rows = spark.createDataFrame([(t,) for t in lines], "p string").withColumn("ws", licences.words(F.col("p"))).withColumn("grams", licences.grams("ws"))
    sizes = [r.features.numNonzeros() for r in model.fit.vectors.transform(rows).collect()]
    assert all(n == 0 for k, n in enumerate(sizes) if k not in got)


def test_templates_confirm_as_brute_force_does(spark, make, model):
    """Containment of 5-word shingles, of the shorter one, recomputed for cut and changed templates."""
    t = licences.TEMPLATES["apache"][1]
    w = t.split()
    lines = [t, " ".join(w[:9]), " ".join(w[:4]), " ".join([*w[:8], "changed", *w[9:]]), " ".join(w[::2]), t + " and then a good deal more was said about it all by others"]
    docs = make(list(enumerate(lines))).select("doc_id", "text", F.col("doc_id").alias("row"))
    got = {r["row"]: r for r in licences.paragraphs(licences.candidates(docs.withColumn("row", F.col("doc_id")), model), model).collect()}

    def sh(text):
        x = re.findall(r"[^\W_]+", text.lower())
        return {tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4))}

    for k, r in got.items():
        want = any(len(sh(lines[k]) & sh(x)) >= 0.8 * min(len(sh(lines[k])), len(sh(x))) for x in licences.TEMPLATES.get(r.family, []))
        assert r.confirmed == want
    assert got[0].confirmed and got[5].confirmed


def test_the_bound_parts_best():
    assert licences.separating([0.7, 0.9, 0.95, 0.99], [0.6, 0.8]) == pytest.approx(0.85)
    assert licences.separating([], [0.7]) == licences.separating([], []) == 0.5


def changed(text, rng):
    """A paragraph with other names and years, a clause left out, or wrapped: None where too little would be left."""
    w = text.split()
    how = rng.choice(["names", "clause", "wrapped"])
    if len(w) < 12:
        return None
    if how == "names":
        at = set(rng.sample(range(len(w)), max(1, len(w) // 20)))
        return " ".join(rng.choice(["Jane", "Exampleton", "1997", "2021", "Ltd."]) if i in at else x for i, x in enumerate(w))
    if how == "clause":
        k = rng.randrange(len(w) - len(w) // 6)
        return " ".join(w[:k] + w[k + len(w) // 6 :])
    return "\n".join(" ".join(w[i : i + 13]) for i in range(0, len(w), 13))


def test_recall_of_changed_paragraphs(spark, make, fillers, model):
    """Paragraphs as others write them go to their family, by the model or by a template; ordinary prose to none."""
    rng = random.Random(11)
    texts = [(f, c) for f, ts in licences.TEMPLATES.items() for t in ts for _ in range(2) if (c := changed(t, rng))]
    prose = [f"{a} {b}" for a in licences.ORDINARY[:10] for b in ("It was late in the year.", "We all agreed to that, and went home.")]
    docs = [*enumerate(c for _, c in texts), *((10_000 + k, t) for k, t in enumerate(prose))]
    rows = make(docs).select("doc_id", "text", F.col("doc_id").alias("row"))
    found = {}
    for r in licences.paragraphs(licences.candidates(rows, model), model).collect():
        found.setdefault(r["row"], set()).add(r.family)
    caught = sum(f in found.get(k, ()) for k, (f, _) in enumerate(texts))
    wrong = [k for k in found if k >= 10_000]
    print(f"{caught} of {len(texts)} changed paragraphs, {len(wrong)} of {len(prose)} ordinary ones marked")
    assert len(texts) >= 100 and caught >= 0.9 * len(texts) and not wrong
