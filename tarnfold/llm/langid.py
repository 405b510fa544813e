"""Language identification: TF-IDF vectors of character n-grams, and the nearest of several centroids per language.

A text's letters are lower-cased, everything else becomes a single space, and its 1- to 3-grams are counted in a
fixed number of hashed places. Document frequencies come from all learning rows. The centroids come from spherical
k-means inside each language over a bounded sample. A text is of the language of the centroid with the largest
cosine; one that is further from its centroid than nearly all of the language's own sample is marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfold.llm.common import kept

PLACES = 2048
CENTROIDS = 4
#: Rows of a language that its centroids are fitted to, about: those of the smallest hashes.
SAMPLE = 1500
#: Code points counted at a time, which bounds the memory of a long text.
STEP = 1 << 20


def letters() -> np.ndarray:
    """For each code point: its lower-case letter, or 32 where it is none."""
    every = np.arange(0x110000, dtype=np.uint32)
    out = np.full(len(every), 32, np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and (ch := chr(c)).isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def ngrams(text: str | None, places: int) -> np.ndarray | None:
    """Counts of the hashed 1- to 3-grams; None where there is no letter."""
    out, any_letter = np.zeros(places, np.float64), False
    text = text or ""
    for start in range(0, len(text), STEP):
        code = kept("letters", letters)[np.frombuffer(text[max(0, start - 2) : start + STEP].encode("utf-32-le", "surrogatepass"), "<u4")]
        code = np.concatenate([[np.uint32(32)], code, [np.uint32(32)]]).astype(np.uint64)
        code = code[np.concatenate([[True], (code[1:] != 32) | (code[:-1] != 32)])]
        any_letter |= bool((code != 32).any())
        one = code * np.uint64(0x9E3779B97F4A7C15)
        two = (one[:-1] ^ (code[1:] * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0x165667B19E3779F9)
        three = (two[:-1] ^ (code[2:] * np.uint64(0x27D4EB2F165667C5))) * np.uint64(0x9E3779B97F4A7C15)
        for h in (one, two, three):
            out += np.bincount(((h >> np.uint64(33)) % np.uint64(places)).astype(np.int64), minlength=places)
    return out if any_letter else None


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return unit(counts * idf)  # plain counts: the language of most of a mixed text decides


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def document_frequencies(docs: DataFrame, places: int) -> tuple[np.ndarray, int]:
    """How many of all rows of docs have each place, and how many rows have a letter: one partial row a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(places, np.int64), 0
        for b in batches:
            for t in b.column(0):
                if (c := ngrams(t.as_py(), places)) is not None:
                    df += c > 0
                    n += 1
        yield pa.RecordBatch.from_pydict({"place": np.arange(-1, places), "n": np.concatenate([[n], df])})

    rows = docs.select("text").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    got = {r["place"]: r["n"] for r in rows}
    return np.array([got.get(i, 0) for i in range(places)], float), got.get(-1, 0)


def fit_language(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Centroids of unit vectors by spherical k-means, farthest points first; the cosine that 1 in 200 falls below."""
    c = x[:1]
    while len(c) < min(k, len(x)):
        c = np.concatenate([c, x[[int((x @ c.T).max(axis=1).argmin())]]])
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        c = unit(np.stack([x[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(len(c))]))
    return c, float(np.quantile((x @ c.T).max(axis=1), 0.005))


def fit(docs: DataFrame, places: int = PLACES, centroids: int = CENTROIDS, sample: int = SAMPLE) -> dict:
    """idf, and for each language its centroids and its rejection bound, from rows with a lang."""
    labelled = docs.where("lang is not null").select("text", F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id", "text").alias("h"))
    df, n = document_frequencies(labelled, places)
    idf = np.log((1 + n) / (1 + df)) + 1
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    share = labelled.sparkSession.createDataFrame([(k, min(1.0, sample / v)) for k, v in sizes.items()] or [("", 0.0)], "lang string, share double")
    # a share of the hashes: each language's group stays near `sample` rows, however many it has; copies of a row count once
    picked = labelled.join(F.broadcast(share), "lang").where(F.pmod("h", F.lit(1 << 30)) < F.col("share") * (1 << 30)).dropDuplicates(["lang", "h"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = [c for t in pdf.sort_values(["h", "text"])["text"] if (c := ngrams(t, places)) is not None]
        if not counts:
            return pd.DataFrame({"lang": [], "bound": [], "centroid": []})
        c, bound = fit_language(weigh(np.array(counts), idf), centroids)
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "bound": bound, "centroid": list(c.astype(np.float32))})

    rows = picked.groupBy("lang").applyInPandas(run, "lang string, bound double, centroid array<float>").collect()
    rows.sort(key=lambda r: (r["lang"], list(r["centroid"])))
    return {"idf": idf, "langs": [r["lang"] for r in rows], "bounds": np.array([r["bound"] for r in rows]), "centroids": np.array([r["centroid"] for r in rows], float).reshape(-1, places)}


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row."""
    idf, langs, bounds, centroids = model["idf"], model["langs"], model["bounds"], model["centroids"]
    places = len(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pred, score, far = [], [], []
            for start in range(0, b.num_rows, 512):
                counts = [ngrams(t.as_py(), places) for t in b.column(2).slice(start, 512)]
                x = np.array([np.zeros(places) if c is None else c for c in counts])
                cos = weigh(x, idf) @ centroids.T if len(langs) else np.zeros((len(x), 1))
                best = cos.argmax(axis=1)
                for c, i, s in zip(counts, best, cos.max(axis=1), strict=True):
                    none = c is None or not langs
                    pred.append("und" if none else langs[i])
                    score.append(0.0 if none else float(min(1.0, max(0.0, s))))
                    far.append(none or bool(s < bounds[i]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(far, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, **options) -> DataFrame:
    """Learn from the rows that are not held out, predict all.

    A null text and one without a letter are `und` with score 0 and rejected, as all texts are where no row has a
    lang. A null doc_id is not held out. Repeated rows count as often as they occur for document frequencies, and once for
    centroids. A text of any length is read whole, in steps. An empty table gives no rows. Only text decides a prediction.
    """
    return predict(docs, fit(docs.where(~held_out(F.col("doc_id"))), **options))
