"""Quality rules: base counts of every text and a decision list that is learned from labelled statistics.

Texts are counted in Arrow batches, each text by itself in time and memory in proportion to its length. The rules come
from a bounded sample of labelled rows and apply to all rows as one CASE expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfold.llm.common import cut, fresh

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: For the learned rules only.
MORE = ["n_chars_all", "n_upper", "n_distinct", "n_lines", "n_digits"]
WINDOW = 5
#: Labelled rows that the rules are learned from, at most.
ROWS_MAX = 20_000
SYMBOLS = b"#*$%&|<>"
UPPER, DIGITS, WHITE = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\v\f\r"


def repeated(ids: np.ndarray, v: int, width: int = WINDOW) -> int:
    """Words inside windows that occur twice or more; ids: below v, equal for equal words."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    key = ids[:n].astype(np.int64)
    for i in range(1, width):
        if int(key.max()) + 1 > (1 << 62) // v:  # else the number would not fit
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        key = key * v + ids[i : n + i]
    _, place, count = np.unique(key, return_inverse=True, return_counts=True)
    edge = np.zeros(len(ids) + 1, np.int64)
    start = np.flatnonzero(count[place] > 1)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + width, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def counts(text: bytes | None) -> list[int]:
    text = text or b""
    words = text.split()
    ids: dict[bytes, int] = {}
    places = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    lines = [x for x in text.split(b"\n") if x.strip(WHITE)]
    without = lambda chars: len(text) - len(text.translate(None, chars))
    chars = len(text.decode(errors="replace"))
    return [len(words), chars - without(WHITE), without(SYMBOLS), len(lines) - len(set(lines)), repeated(places, max(1, len(ids))), chars, without(UPPER), len(ids), len(lines), without(DIGITS)]


def statistics(docs: DataFrame) -> DataFrame:
    """docs's doc_id with the counts of its whole text; a null text has none of anything."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([counts(t.as_py()) for t in b.column(1)], np.int64).reshape(-1, len(COUNTS + MORE))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in rows.T)], ["doc_id", *COUNTS, *MORE])

    schema = ", ".join(f"{c} long" for c in ["doc_id", *COUNTS, *MORE])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, schema)


def features(at: str = "") -> dict[str, Column]:
    """The features that rules speak of, from the counts; at: what stands before the counts' names."""
    n = lambda name: F.col(at + name)
    words, chars = F.greatest(n("n_words"), F.lit(1)), F.greatest(n("n_chars_all"), F.lit(1))
    return {
        "words": n("n_words").cast("double"),
        "word_length": n("word_chars") / words,
        "symbol_share": n("n_symbols") / words,
        "dup_line_share": n("n_dup_lines") / F.greatest(n("n_lines"), F.lit(1)),
        "repeat_share": n("n_repeat_words") / words,
        "upper_share": n("n_upper") / chars,
        "distinct_share": n("n_distinct") / words,
        "digit_share": n("n_digits") / chars,
    }


def base_failed(at: str = "") -> Column:
    return (F.col(f"{at}n_words") < 10) | (100 * F.col(f"{at}n_repeat_words") > 20 * F.col(f"{at}n_words"))


@dataclass(frozen=True)
class Rule:
    """feature <= or > threshold, all of them; what is left of the labelled rows that it covers."""

    terms: tuple[tuple[str, str, float], ...]
    precision: float
    covered: int

    def condition(self, at: str = "") -> Column:
        f, out = features(at), F.lit(True)
        for name, op, x in self.terms:
            out = out & (f[name] <= x if op == "<=" else f[name] > x)
        return out

    def matches(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, op, t in self.terms:
            c = x[:, names.index(name)]
            out &= c <= t if op == "<=" else c > t
        return out


def foil(p: int, n: int, p0: int, n0: int) -> float:
    """Information that a term gains on the bad rows that it keeps."""
    return p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))) if p else -np.inf


def with_margin(x: np.ndarray, bad: np.ndarray, names: list[str], terms: list[tuple[str, str, float]]) -> list[tuple[str, str, float]]:
    """Terms with thresholds moved half way from the nearest uncovered row to the twentieth part of bad rows inside.

    A threshold beside the last good row would reject what is only a little beyond all good rows seen. Moved inwards, a
    rule covers less, never more; bad rows that it then leaves are for the rules after it.
    """
    out = list(terms)
    for i, (name, op, t) in enumerate(terms):
        hit = Rule(tuple(out), 0, 0).matches(x, names) & bad
        others = Rule(tuple(u for k, u in enumerate(out) if k != i), 0, 0).matches(x, names) & ~bad
        c = x[:, names.index(name)]
        outside = c[others & (c <= t if op == ">" else c > t)]
        if hit.any() and len(outside):
            inside = np.quantile(c[hit], 0.05 if op == ">" else 0.95)
            out[i] = (name, op, float(max(t, (outside.max() + inside) / 2) if op == ">" else min(t, (outside.min() + inside) / 2)))
    return out


def grow(x: np.ndarray, bad: np.ndarray, names: list[str], terms_max: int, bins: int) -> list[tuple[str, str, float]]:
    rows, terms = np.arange(len(x)), []
    while len(terms) < terms_max and (~bad[rows]).any():
        p0, n0, best = int(bad[rows].sum()), int((~bad[rows]).sum()), (1e-9, None)
        for j, name in enumerate(names):
            for t in np.unique(np.quantile(x[rows, j], np.linspace(0, 1, bins + 1)[:-1])):
                for op in ("<=", ">"):
                    hit = x[rows, j] <= t if op == "<=" else x[rows, j] > t
                    p = int((hit & bad[rows]).sum())
                    gain = foil(p, int(hit.sum()) - p, p0, n0)
                    if gain > best[0]:
                        best = gain, (name, op, float(t))
        if best[1] is None:
            break
        terms.append(best[1])
        rows = rows[Rule((best[1],), 0, 0).matches(x[rows], names)]
    return terms


def learn(rows: list[list[float]], bad: list[bool], names: list[str], precision: float = 0.97, support: int = 5, terms_max: int = 3, rules_max: int = 12, bins: int = 64) -> list[Rule]:
    """Sequential covering: grow a conjunction on two thirds, prune it on the rest, take out what it covers, go on.

    A rule is kept while, over all labelled rows that no earlier rule covers, it covers `support` bad ones or more
    and at least `precision` of what it covers is bad. Deterministic for the same rows in the same order.
    """
    x, y = np.array(rows, float).reshape(-1, len(names)), np.array(bad, bool)
    left, out = np.arange(len(x)), []
    while len(out) < rules_max and y[left].sum() >= support and (~y[left]).any():
        to_prune = left % 3 == 2
        terms = grow(x[left[~to_prune]], y[left[~to_prune]], names, terms_max, bins)
        held = left[to_prune]

        def worth(terms, held=held):
            hit = Rule(tuple(terms), 0, 0).matches(x[held], names)
            p, n = int((hit & y[held]).sum()), int((hit & ~y[held]).sum())
            return (p - n) / (p + n) if p + n else -1.0

        while len(terms) > 1 and worth(terms[:-1]) >= worth(terms):
            terms = terms[:-1]
        if not terms:
            break
        terms = with_margin(x[left], y[left], names, terms)
        hit = Rule(tuple(terms), 0, 0).matches(x[left], names)
        good = float(y[left][hit].mean()) if hit.any() else 0.0
        if good < precision or y[left][hit].sum() < support:
            break
        out.append(Rule(tuple(terms), good, int(hit.sum())))
        left = left[~hit]
    return out


def qualities(labels: DataFrame) -> DataFrame:
    """doc_id, quality: one row a labelled doc_id, the worse label of several; rows without one or the other are left out."""
    known = labels.where("doc_id is not null and quality is not null")
    return known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))


def under(h: str, share: float) -> Column:
    """Whether the hash is among the least `share` of all: so that tasks send no more than about a sample between them."""
    return F.pmod(h, F.lit(1 << 30)) < min(1.0, share) * (1 << 30)


def sampled(labels: DataFrame, rows_max: int) -> DataFrame:
    """doc_id, quality of at most rows_max labelled rows, those of the smallest hashes of doc_id: the bound of the sample."""
    known = cut(qualities(labels).withColumn("_h", F.xxhash64("doc_id")))
    some = known.where(under("_h", 1.1 * rows_max / max(1, known.count())))
    return cut(some.orderBy("_h", "doc_id").limit(rows_max).drop("_h"))


def train(stats: DataFrame, labels: DataFrame, rows_max: int = ROWS_MAX, **options) -> list[Rule]:
    """Learn from the documents of sampled() labels that pass the base, rows_max of them at most."""
    names = list(features())
    rows = cut(
        stats.where(~base_failed())
        .join(F.broadcast(sampled(labels, rows_max)), "doc_id")
        .select(F.xxhash64("doc_id").alias("h"), "doc_id", (F.col("quality") == 0).alias("bad"), *[f.alias(k) for k, f in features().items()])
    )
    some = rows.where(under("h", 1.1 * rows_max / max(1, rows.count())))  # more only where rows share a doc_id
    sample = some.orderBy("h", "doc_id", *names).limit(rows_max).collect()
    return learn([[r[k] for k in names] for r in sample], [r["bad"] for r in sample], names, **options)


def verdict(rules: list[Rule], at: str = "") -> Column:
    """The place of the first rule that rejects the row, from 1; 0: none does."""
    out = F.lit(0)
    for i, r in reversed(list(enumerate(rules, 1))):
        out = F.when(r.condition(at), i).otherwise(out)
    return out


def judge(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, the counts, base_failed, kept, rule (the rejecting rule's place, 0 for none) of every row.

    The base fails below 10 words, or where repeated 5-word windows hold over a fifth of the words: so do null and
    empty texts. Where no labelled row is found, the list is empty and the base alone decides. Repeated rows get
    equal verdicts. A text of any length is counted whole. An empty table gives no rows. Columns besides doc_id and
    text are not read.
    """
    stats = cut(statistics(docs))
    rule = verdict(train(stats, labels, **options))
    judged = stats.select("doc_id", *COUNTS, base_failed().alias("base_failed"), rule.alias("rule"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def counts_of(text: Column) -> Column:
    """A struct of the counts of a text."""

    @F.pandas_udf(", ".join(f"{c} long" for c in [*COUNTS, *MORE]))
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = np.array([counts(t) for t in texts], np.int64).reshape(-1, len(COUNTS + MORE))
        return pd.DataFrame(rows, columns=[*COUNTS, *MORE])

    return of(text.cast("binary"))


def keep(docs: DataFrame, labels: DataFrame, rows_max: int = ROWS_MAX, **options) -> DataFrame:
    """The rows that the base and the learned rules keep, each judged by its own text, whatever its doc_id.

    The rules are learned as in judge(), from the documents of at most rows_max labels. Then every text is counted once
    and its row kept or not in the same pass: nothing is joined and no text crosses an exchange. docs may have
    further columns of any names, which stay as they are. An empty table gives no rows.
    """
    chosen = sampled(labels, rows_max)
    labelled = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).join(F.broadcast(chosen.select("doc_id")), "doc_id")
    rules = train(statistics(labelled), chosen, rows_max, **options)
    name = fresh(docs, "_counts")
    counted = docs.withColumn(name, counts_of(docs["text"]))
    return counted.where(~base_failed(f"{name}.") & (verdict(rules, f"{name}.") == 0)).drop(name)
