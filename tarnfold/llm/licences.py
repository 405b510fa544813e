"""Licence scan: a trained paragraph classifier whose predictions templates confirm.

Paragraphs are lines. Texts of licences, whole and cut into overlapping pieces, teach the licence families; a bounded
sample of the corpus's own lines that hint at no licence, and ordinary sentences with words that licences use, teach the
class `none`. The features are word 1-, 2- and 3-grams over a bounded vocabulary, and the model is a sparse multinomial
logistic regression.

Calibration holds out whole texts, one in three of each family: a model that has not seen them gives the temperature,
and the bound under which a paragraph that looks like a licence is `unknown`. The bound is the one that best parts held
out texts that went to their families from wordings of other licences: a fixed list, and the sampled lines that hint at a
licence but share little with any template. The model that is used is fitted to all texts.

A predicted family is confirmed if the paragraph and one of the family's templates share their 5-word shingles: 0.8 or
more of those of the shorter one.

Features without a telling word are left out of the vocabulary: a word of three letters or more that the ordinary
sentences do not have. So a line without any telling word has no feature at all and is `none`, whatever the corpus is,
and needs no score.
"""

from __future__ import annotations

import math
import re

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.llm.common import cut
from tarnfold.llm.licence_texts import ORDINARY, OTHER, TEMPLATES

NONE, UNKNOWN = "none", "unknown"
VOCABULARY = 8192
#: Lines of the corpus that teach the class `none`, at most.
SAMPLE = 5000
SHINGLE, SHARED = 5, 0.8
#: A line looks like a licence if `none` has no more probability than this; one that does not is `none` unless a template confirms it.
NONE_MOST = 0.1
#: A line with a hint that shares less than this of its shingles with the templates is of no family.
FOREIGN = 0.3
HINT = r"(?i)licen[cs]e|copyright|rights reserved|warrant|permi(t|ss)|redistribut"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def once(x: Column, over) -> Column:
    """over(x), with x worked out once: inside a lambda, an expression is worked out again for each element."""
    return F.get(F.transform(F.array(x), over), F.lit(0))


def grams(ws: str) -> Column:
    """The 1-, 2- and 3-grams of an array column."""

    def of(w: Column, n: int) -> Column:
        one = lambda i: F.array_join(F.slice(w, i, n), " ")
        return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), one)).otherwise(F.array().cast("array<string>"))

    return once(F.col(ws), lambda w: F.concat(*[of(w, n) for n in (1, 2, 3)]))


def shingles(ws: str) -> Column:
    """Hashes of the 5-word shingles; of the whole, where it is shorter."""

    def of(w: Column) -> Column:
        one = lambda i: F.xxhash64(F.array_join(F.slice(w, i, SHINGLE), " "))
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - SHINGLE + 1, F.lit(1))), one))

    return once(F.col(ws), of)


def variants(text: str) -> list[str]:
    """A text as it may stand elsewhere: some words other ones, a clause left out, and wrapped into lines."""
    w = text.split()
    n = len(w)
    out = [" ".join("acme" if i % 9 == 4 else x for i, x in enumerate(w)), " ".join(w[: n // 3] + w[n // 2 :])]
    return out + [" ".join(w[i : i + 10]) for i in range(0, n - 9, 10)]


def pieces(spark: SparkSession) -> DataFrame:
    """label, text, held, whole: the families' texts, and stretches of 6 and 12 words of them; their variants are held out.

    Of the ordinary sentences every third is held out.
    """
    rows = []
    for family, texts in TEMPLATES.items():
        for t in texts:
            w = t.split()
            cuts = [" ".join(w[i : i + size]) for size, step in ((6, 3), (12, 4)) for i in range(0, max(1, len(w) - size + 1), step)]
            rows += [(family, t, False, True), *((family, x, False, False) for x in cuts if x != t)]
            rows += [(family, x, True, True) for x in variants(t) if x != t]
    rows += [(NONE, t, k % 3 == 2, True) for k, t in enumerate(ORDINARY)]
    return spark.createDataFrame(rows, "label string, text string, held boolean, whole boolean")


def templates(spark: SparkSession) -> DataFrame:
    """family, sh: the shingles of each template. A fixed number of rows."""
    rows = [(f, t) for f, texts in TEMPLATES.items() for t in texts]
    return spark.createDataFrame(rows, "family string, text string").withColumn("ws", words(F.col("text"))).select("family", shingles("ws").alias("sh"))


def shares(all_sh: str, ws: str) -> Column:
    """The largest part that a line shares with one of several templates, of the shingles of the shorter one."""

    def over(own: Column) -> Column:
        return F.array_max(F.transform(all_sh, lambda t: F.size(F.array_intersect(t, own)) / F.least(F.size(t), F.size(own))))

    return once(shingles(ws), over)


def is_telling(word: str, ordinary: set[str]) -> bool:
    return len(word) > 2 and word.isalpha() and word not in ordinary


class Fit:
    """Vectors and weights that were fitted to rows (label, ws). telling: the words of which each feature has one or more."""

    def __init__(self, rows: DataFrame, vocabulary: int):
        rows = cut(rows.withColumn("grams", grams("ws")))
        counted = CountVectorizer(inputCol="grams", outputCol="features", vocabSize=vocabulary, binary=True).fit(rows.where(F.col("label") != NONE))
        ordinary = set(re.findall(r"[^\W_]+", " ".join(ORDINARY).lower()))
        features = [f for f in counted.vocabulary if any(is_telling(w, ordinary) for w in f.split(" "))]
        self.telling = sorted({w for f in features for w in f.split(" ") if is_telling(w, ordinary)})
        self.vectors = CountVectorizerModel.from_vocabulary(features, inputCol="grams", outputCol="features").setBinary(True)
        self.classes = [NONE, *sorted(TEMPLATES)]
        # so that each family and the other lines weigh the same
        sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
        weight, number = F.lit(1.0), F.lit(None).cast("double")
        for k, c in enumerate(self.classes):
            weight = F.when(F.col("label") == c, 100.0 / sizes.get(c, 1)).otherwise(weight)
            number = F.when(F.col("label") == c, float(k)).otherwise(number)
        data = self.vectors.transform(rows.withColumn("y", number).withColumn("w", weight)).select("features", "y", "w")
        self.model: LogisticRegressionModel = LogisticRegression(
            featuresCol="features", labelCol="y", weightCol="w", probabilityCol="probabilityVector",
            family="multinomial", maxIter=60, regParam=0.002, elasticNetParam=0.5, standardization=False,
        ).fit(data.coalesce(1))  # a few thousand short rows
        if self.model.interceptVector.argmax():
            raise ValueError("a line without features would not be none")

    def raw(self, rows: DataFrame) -> DataFrame:
        """rows (with array ws) with rawPrediction."""
        scored = self.model.transform(self.vectors.transform(rows.withColumn("grams", grams("ws"))))
        return scored.drop("grams", "features", "probabilityVector", "prediction")


class Model:
    """A fitted scan. bound: the least probability of a family, unless a template confirms it; telling: see Fit."""

    def __init__(self, fit: Fit, temperature: float, bound: float):
        self.fit, self.temperature, self.bound, self.telling = fit, temperature, bound, fit.telling

    def score(self, rows: DataFrame) -> DataFrame:
        """rows (with array ws) with label, probability, and looks: whether they look like a licence."""
        def best(raw: Column) -> Column:
            top_ = F.array_max(raw)
            total = F.aggregate(raw, F.lit(0.0), lambda acc, x: acc + F.exp((x - top_) / self.temperature))
            none = F.exp((F.element_at(raw, 1) - top_) / self.temperature) / total
            label = F.element_at(names, F.array_position(raw, top_).cast("int"))
            return F.struct((1 / total).alias("probability"), label.alias("label"), (none <= NONE_MOST).alias("looks"))

        names = F.array(*map(F.lit, self.fit.classes))
        scored = self.fit.raw(rows).withColumn("_raw", vector_to_array("rawPrediction"))
        return scored.withColumn("_best", once(F.col("_raw"), best)).withColumns({"probability": F.col("_best.probability"), "label": F.col("_best.label"), "looks": F.col("_best.looks")}).drop("rawPrediction", "_raw", "_best")


def sampled(docs: DataFrame, sample: int) -> DataFrame:
    """text, hint of different lines of documents of the smallest hashes: at most `sample` of each sort.

    The hashes' bound comes from the number of documents: a document is looked at if its hash is under it.
    """
    n = max(1, docs.count())
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < min(1.0, sample / n) * (1 << 30))
    lines = some.select(F.explode(F.split("text", "\n")).alias("text")).where("trim(text) <> ''").distinct()
    lines = cut(lines.select("text", F.col("text").rlike(HINT).alias("hint")))
    first = lambda x: x.orderBy(F.xxhash64("text"), "text").limit(sample)
    return first(lines.where("hint")).union(first(lines.where("not hint")))


def train(docs: DataFrame, sample: int = SAMPLE, vocabulary: int = VOCABULARY) -> Model:
    """Fit to the licence texts and to at most `sample` of the corpus's lines; calibrate with what is held out, and keep the fit."""
    spark = docs.sparkSession
    lines = cut(sampled(docs, sample).withColumn("ws", words(F.col("text"))))
    of_corpus = lines.where("not hint").select(F.lit(NONE).alias("label"), "ws", (F.pmod(F.xxhash64("text"), F.lit(3)) == 2).alias("held"), F.lit(True).alias("whole"))
    rows = cut(pieces(spark).withColumn("ws", words(F.col("text"))).select("label", "ws", "held", "whole").union(of_corpus))
    fit = Fit(rows.where("not held"), vocabulary)
    known = fit.raw(rows.where("held and whole")).select("label", "rawPrediction").collect()
    held = [([float(x) for x in r["rawPrediction"]], fit.classes.index(r["label"])) for r in known]
    # lines of no family are many: they count as much as all texts of families together
    families = sum(y > 0 for _, y in held)
    weighted = [(raw, y, 1.0 if y else families / max(1, len(held) - families)) for raw, y in held]
    temperature = min((t / 10 for t in range(5, 41)), key=lambda t: loss(weighted, t))
    every = {h for r in templates(spark).select("sh").collect() for h in r["sh"]}  # a fixed number
    known_sh = F.split(F.lit(",".join(map(str, sorted(every)))), ",").cast("array<bigint>")
    foreign = lines.where("hint").where(F.size(F.array_intersect(shingles("ws"), known_sh)) < FOREIGN * F.size(shingles("ws"))).select("ws")
    odd = spark.createDataFrame([(t,) for t in OTHER], "text string").select(words(F.col("text")).alias("ws")).union(foreign)
    right = [p for raw, y in held if y for p, k in [top(raw, temperature)] if k == y]
    wrong = [p for r in fit.raw(odd).select("rawPrediction").collect() for p, k in [top([float(x) for x in r["rawPrediction"]], temperature)] if k]
    return Model(fit, temperature, separating(right, wrong))


def top(raw: list[float], t: float) -> tuple[float, int]:
    m = max(raw)
    e = [math.exp((x - m) / t) for x in raw]
    return max((x / sum(e), k) for k, x in enumerate(e))


def separating(known: list[float], other: list[float]) -> float:
    """The bound with the best balance of known ones at or over it and others under it; half if there are none.

    It lies half way from the last one under it to the least known one over it.
    """
    share = lambda xs, ok: sum(map(ok, xs)) / len(xs) if xs else 1.0
    best = max(sorted({0.5, *known}), key=lambda b: share(known, lambda p: p >= b) + share(other, lambda p: p < b))
    below = [p for p in [*known, *other] if p < best]
    return (best + max(below)) / 2 if below else best


def loss(rows: list[tuple[list[float], int, float]], t: float) -> float:
    out = 0.0
    for raw, y, weight in rows:
        m = max(raw)
        out += weight * (math.log(sum(math.exp((x - m) / t) for x in raw)) - (raw[y] - m) / t)
    return out


def any_of(words_: list[str]) -> str:
    """A pattern of these words, with common beginnings written once, so that few characters decide."""
    tree: dict = {}
    for w in words_:
        at = tree
        for c in w:
            at = at.setdefault(c, {})
        at[""] = {}

    def write(at: dict) -> str:
        ways = [c + write(at[c]) for c in sorted(at) if c]
        return "(?:" + "|".join(ways) + ")" + ("?+" if "" in at else "") if ways else ""

    return write(tree)


def candidates(docs: DataFrame, model: Model) -> DataFrame:
    """row, doc_id and, for every line with a telling word, line (its place) and p; one row without for other documents."""
    # possessive: a longer word that begins like a telling one is tried first, and the end must then be right
    gate = rf"(?<![\p{{L}}\p{{N}}]){any_of(model.telling)}(?![\p{{L}}\p{{N}}])" if model.telling else r"\b\B"
    lines = F.transform(F.split("text", "\n"), lambda p, i: F.struct(i.alias("line"), p.alias("p")))
    told = F.when(F.lower("text").rlike(gate), F.filter(lines, lambda x: F.lower(x["p"]).rlike(gate)))
    return docs.select("row", "doc_id", F.explode_outer(told).alias("x")).select("row", "doc_id", "x.line", "x.p")


def paragraphs(lines: DataFrame, model: Model) -> DataFrame:
    """row, line, family, probability, confirmed of every candidate line that is no `none`."""
    spark = lines.sparkSession
    # cut before the filter, which would otherwise take the whole score into itself
    scored = cut(model.score(lines.where("p is not null").withColumn("ws", words(F.col("p")))).drop("p", "doc_id")).where(F.col("label") != NONE)
    own = templates(spark).groupBy("family").agg(F.collect_list("sh").alias("all"))
    confirmed = F.coalesce(shares("all", "ws") >= SHARED, F.lit(False))
    return (
        scored.join(F.broadcast(own), F.col("label") == F.col("family"), "left")
        .withColumn("confirmed", confirmed)
        .where(F.col("looks") | F.col("confirmed"))
        .withColumn("family", F.when((F.col("probability") >= model.bound) | F.col("confirmed"), F.col("label")).otherwise(UNKNOWN))
        .select("row", "line", "family", F.round("probability", 6).alias("probability"), "confirmed")
    )


def scan(docs: DataFrame, **options) -> DataFrame:
    """doc_id, families, n_confirmed, n_unconfirmed, n_unknown, best_probability of every row.

    families: the confirmed ones of its paragraphs, sorted, comma-joined. Null and empty texts have no paragraph;
    repeated rows are scanned each for itself; a text of any length is read whole, and so is each of its lines; an
    empty table gives no rows. Other columns are not read.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.withColumn("row", F.monotonically_increasing_id())
    model = train(texts, **options)
    lines = cut(candidates(rows, model))
    found = paragraphs(lines, model)
    per = found.groupBy("row").agg(
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("families"),
        F.count(F.when(F.col("confirmed"), 1)).alias("n_confirmed"),
        F.count(F.when(~F.col("confirmed") & (F.col("family") != UNKNOWN), 1)).alias("n_unconfirmed"),
        F.count(F.when(F.col("family") == UNKNOWN, 1)).alias("n_unknown"),
        F.max("probability").alias("best_probability"),
    )
    zero = F.lit(0).cast("long")
    counts = [F.coalesce(c, zero).alias(c) for c in ("n_confirmed", "n_unconfirmed", "n_unknown")]
    every = lines.groupBy("row").agg(F.first("doc_id").alias("doc_id")).join(per, "row", "left")
    return every.select("doc_id", F.coalesce("families", F.lit("")).alias("families"), *counts, "best_probability")
