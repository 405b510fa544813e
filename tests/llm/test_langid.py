import math
import re
import unicodedata
import zlib

import numpy as np

from tarnfold.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs, sample=300).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").collect()
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    test = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in test) >= 0.97 * len(test)
    assert all(0 <= r.score <= 1 for r in rows) and sum(r.rejected for r in rows) < 0.05 * len(rows)


def test_edge_cases(make):
    texts = [None, "", "123 !!", "a", "É", "word " * 300_000, "\U0001d4b3", "中文"]
    docs = make([(i, t) for i, t in enumerate(texts)] + [(None, "word"), (3, "a"), (3, "a")])
    out = langid.identify(docs).collect()
    assert len(out) == len(texts) + 3
    for r in out:
        letter = r.doc_id is None or any(unicodedata.category(c)[0] == "L" for c in texts[r.doc_id] or "")
        assert r.lang_pred == ("en" if letter else "und")
    assert langid.identify(make([])).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", docs.lang.substr(9, 1).substr(1, 0)).replace("", None, "lang")).collect()} == {"und"}


def test_long_texts_are_counted_in_steps(monkeypatch):
    text = "Ab1é " * 50
    whole = langid.ngrams(text, 512)
    assert whole.sum() > 0 and langid.ngrams("1 2", 512) is None
    low = langid.ngrams(text.lower(), 512)
    assert np.array_equal(whole, low)
    monkeypatch.setattr(langid, "STEP", 64)
    stepped = langid.ngrams(text, 512)
    assert abs(stepped.sum() - whole.sum()) <= 0.1 * whole.sum()


def test_k_means_finds_clusters():
    rng = np.random.default_rng(0)
    x = langid.unit(np.concatenate([np.eye(5)[i] + 0.05 * rng.random((40, 5)) for i in range(3)]))
    c, bound = langid.fit_language(x, 3)
    assert len(c) == 3 and bound > 0.95 and sorted(np.abs(c).argmax(axis=1)) == [0, 1, 2]


def test_predictions_against_brute_force(small):
    """Counts of n-grams from Python strings, weights and cosines one by one, for each text and centroid."""
    model = langid.fit(small.where(~langid.held_out(small.doc_id)), sample=100)
    places, mask = len(model["idf"]), (1 << 64) - 1

    def counts(text):
        s = " " + re.sub(" +", " ", "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text or "").strip()) + " "
        out = [0] * places
        for i in range(len(s)):
            one = ord(s[i]) * 0x9E3779B97F4A7C15 & mask
            hashes = [one]
            if i + 1 < len(s):
                two = ((one ^ (ord(s[i + 1]) * 0xC2B2AE3D27D4EB4F & mask)) * 0x165667B19E3779F9) & mask
                hashes.append(two)
                if i + 2 < len(s):
                    hashes.append(((two ^ (ord(s[i + 2]) * 0x27D4EB2F165667C5 & mask)) * 0x9E3779B97F4A7C15) & mask)
            for h in hashes:
                out[(h >> 33) % places] += 1
        return out

    rows = small.collect()[:60]
    got = {r.doc_id: r for r in langid.predict(small, model).collect()}
    for r in rows:
        x = [n * w for n, w in zip(counts(r.text), model["idf"], strict=True)]
        size = math.sqrt(sum(v * v for v in x))
        cos = [sum(v / size * c for v, c in zip(x, centre, strict=True)) for centre in model["centroids"]]
        assert got[r.doc_id].lang_pred == model["langs"][cos.index(max(cos))] and abs(got[r.doc_id].score - max(cos)) < 1e-6
