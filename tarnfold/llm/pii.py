"""Personal data: base patterns, and bootstrapped extraction from the contexts in which what they find stands.

Base spans seed the method. Around every entity-like stretch of a text (a word with a digit or an @, and the number
groups after it; or words around a written-out "at" and "dot") stand the words before and after it: its lexical
patterns, in three forms. Patterns and instances make a graph. A seed scores 1; a pattern scores by the share of its
instances that is known to be of one kind, less where the evidence is thin; an instance scores by the patterns that
extract it; and so on in rounds, until a round makes nothing known. What gets known in a round keeps its kind and
score, and counts for its patterns in the next, by FAITH times its score, so that a long chain of guesses carries little:
a pattern has to hold by its seeds in the main. All its other instances, numbers of any length among them, count against
it; and only what is shaped like its kind gets known. Occurrences of what is known in the end, and not by the base, are
the discovered spans. All of it is Spark expressions and joins.

The base patterns are written with possessive repeats and looks behind: they match the same spans as the plain ones,
in time in proportion to the text and without deep recursion, whatever it holds. Where matches begin is summed up in
blocks, so a text with very many of them takes time in proportion, too.
"""

from __future__ import annotations

import operator
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfold.llm.common import cut, small

KINDS = ["email", "ip", "card", "phone"]
#: A local part begins after another character or where the last match ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be looked for.
SIGN = {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}
#: An address spelled with a bracketed at, or with an at and a dot as words of their own.
AT, DOT = r" ?[(\[{](?i:at)[)\]}] ?", r"(?: ?[(\[{](?i:dot)[)\]}] ?| (?i:dot) |\.)"
SPELLED = rf"(?<![\p{{L}}0-9._-])[\p{{L}}0-9._-]++(?:{AT}[\p{{L}}0-9-]++(?:{DOT}[\p{{L}}0-9-]++)++| (?i:at) [\p{{L}}0-9-]++(?: (?i:dot) [\p{{L}}0-9-]++)++)"
#: Or a word with a digit or @, then number groups after single spaces, each with a digit at its start.
STRETCH = SPELLED + r"|(?<![\p{L}0-9@._%+()/-])[\p{L}._%+()/-]*+[0-9@][\p{L}0-9@._%+()/-]*+(?: \(?[0-9][0-9()./-]*+)*+"
STRETCH_SIGN = r"[0-9@]|[(\[{](?i:at)[)\]}]| (?i:dot) "
#: Marks before and after an instance are no part of it, nor are brackets around all of it; those around a part are.
LEAD = r"^(?:[._%)/-]|\((?![^()]*\))|\((?=[^()]*\)[._%/+-]*$))*+"
TAIL, TAIL_CLOSED = r"[._%(/+-]++$", r"[._%()/+-]++$"
#: What an instance must look like to be taken for a kind: an at sign or a spelled one; several parts; or so many digits.
SHAPES = {
    "email": lambda inst, digits: inst.contains("@") | inst.rlike(r"[(\[{]at[)\]}]| at "),
    "ip": lambda inst, digits: inst.rlike(r"[0-9a-f]+([.:-][0-9a-z]+){2}") & (digits >= 4),
    "card": lambda inst, digits: digits.between(12, 19),
    "phone": lambda inst, digits: digits.between(7, 15),
}
#: What a discovered instance counts for, against a seed.
FAITH = 0.5
#: Context words longer than this are compared by their digests.
LONG_WORD = 64
#: Elements that are folded at a time.
BLOCK = 1024
SPAN = "array<struct<s:int,k:int,e:int>>"
STRETCHES = "array<struct<s:int,e:int,inst:string,l2:string,l1:string,label:boolean,r1:string,k:int>>"


def luhn(number: Column) -> Column:
    n = F.length(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(number, n - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def good(kind: str, m: Column) -> Column:
    number = F.regexp_replace(m, "[^0-9]", "")
    size = F.length(number)
    if kind == "ip":
        short = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(m, r"\."), lambda p: F.when(F.length(short(p)) <= 3, short(p).cast("int") <= 255).otherwise(False))
    if kind == "card":
        return F.when(size.between(12, 19), luhn(number)).otherwise(False)
    if kind == "phone":
        return size.between(9, 15)
    return F.lit(True)


def sums_before(values: Column, levels: int = 1) -> Column:
    """The sum of what stands before each element of an array of numbers.

    A fold that grows an array copies it in each step, so only blocks are folded: of numbers, and of sums of blocks. With
    blocks of BLOCK and one level the work is in proportion up to some BLOCK ** 2 elements, and small beyond.
    """
    none = F.array().cast("array<int>")

    def fold(xs: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), none.alias("out"))
        step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(xs, start, step, lambda acc: acc["out"])

    def over(blocks: Column) -> Column:
        before = sums_before(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), operator.add)), levels - 1)
        pairs = F.arrays_zip(before.alias("at"), blocks.alias("b"))
        return F.flatten(F.transform(pairs, lambda x: F.transform(fold(x["b"]), lambda y: y + x["at"])))

    def of(xs: Column) -> Column:
        if not levels:
            return fold(xs)
        last = F.floor((F.size(xs) - 1) / BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(xs, k * BLOCK + 1, F.lit(BLOCK)))
        return F.when(F.size(xs) <= BLOCK, fold(xs)).otherwise(once(blocks, over))

    return once(values, of)


def once(x: Column, over) -> Column:
    """over(x), with x worked out once however often over names it."""
    return F.get(F.transform(F.array(x), over), F.lit(0))


def walk(text: Column, pattern: str, make) -> Column:
    """Over the leftmost, non-overlapping matches: array of make(start, end, match, gap before, gap after), nulls left out."""

    def spans(steps: Column) -> Column:
        at = sums_before(F.transform(steps, lambda x: F.length(x["g"]) + F.length(x["m"])))

        def one(x: Column) -> Column:
            s = x["s"]
            start = x["at"] + F.length(s["g"])
            return make(start, start + F.length(s["m"]), s["m"], s["g"], s["h"])

        return F.filter(F.transform(F.arrays_zip(steps.alias("s"), at.alias("at")), one), lambda y: y.isNotNull())

    def over(b: Column) -> Column:
        n = F.size(b["m"])
        return once(F.arrays_zip(F.slice(b["g"], F.lit(1), n).alias("g"), b["m"].alias("m"), F.slice(b["g"], F.lit(2), n).alias("h")), spans)

    return once(F.struct(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m")), over)


def base_spans(text: Column) -> Column:
    parts = []
    for k, kind in enumerate(KINDS):
        make = lambda s, e, m, g, h, k=k, kind=kind: F.when(good(kind, m), F.struct(s.alias("s"), F.lit(k).alias("k"), e.alias("e")))
        parts.append(F.when(text.rlike(SIGN[kind]), walk(text, BASE[kind], make)).otherwise(F.array().cast(SPAN)))
    return F.sort_array(F.concat(*parts))


def stretches(text: Column) -> Column:
    """Entity-like stretches with the words around them and, for those that hold a base span, its kind."""

    def make(s: Column, e: Column, m: Column, g: Column, h: Column) -> Column:
        kind = F.lit(None).cast("int")
        for k, name in reversed(list(enumerate(KINDS))):
            kind = F.when(F.exists(F.regexp_extract_all(m, F.lit(BASE[name]), F.lit(0)), partial(good, name)), k).otherwise(kind)
        back = F.reverse(g)  # so that the last words are found from the front
        last = F.lower(F.reverse(F.regexp_extract(back, r"^\s*+(\S++)", 1)))
        second = F.lower(F.reverse(F.regexp_extract(back, r"^\s*+\S++\s++(\S++)", 1)))
        after = F.lower(F.regexp_extract(h, r"^\s*+(\S++)", 1))
        short = lambda w: F.when(F.length(w) > LONG_WORD, F.sha2(w, 256)).otherwise(w)

        def cleaned(lead: Column) -> Column:
            rest = F.substr(m, lead + 1)
            inst = F.when(rest.contains("("), F.regexp_replace(rest, TAIL, "")).otherwise(F.regexp_replace(rest, TAIL_CLOSED, ""))
            return F.struct((s + lead).alias("s"), inst.alias("inst"))

        def span(x: Column) -> Column:
            made = F.struct(
                x["s"].alias("s"), (x["s"] + F.length(x["inst"])).alias("e"), F.lower(x["inst"]).alias("inst"), short(second).alias("l2"), short(last).alias("l1"),
                last.rlike(r"[=:#]['\"(]*$").alias("label"), short(after).alias("r1"), kind.alias("k"),
            )
            return F.when(x["inst"] != "", made)

        return once(once(F.length(F.regexp_extract(m, LEAD, 0)), cleaned), span)

    return F.when(text.rlike(STRETCH_SIGN), walk(text, STRETCH, make)).otherwise(F.array().cast(STRETCHES))


def shaped(kind: Column, inst: Column) -> Column:
    digits = F.length(F.regexp_replace(inst, "[^0-9]", ""))
    out = F.lit(False)
    for k, name in enumerate(KINDS):
        out = F.when(kind == k, SHAPES[name](inst, digits)).otherwise(out)
    return out


def discover(seen: DataFrame, support: int, threshold: float) -> DataFrame | None:
    """(inst, k) of what the contexts make known beyond the seeds; None where nothing is.

    seen: inst, k (null if unknown), l2, l1, label, r1 of every stretch. A pattern counts from `support` known instances
    on, and from the threshold on, a share of its different instances that is damped by its evidence. What is known only
    grows, so the rounds end by themselves.
    """
    forms = F.array(
        F.when(F.col("l2") != "", F.concat_ws("\0", F.lit("before"), "l2", "l1")),
        F.when(F.col("label"), F.concat_ws("\0", F.lit("label"), "l1")),
        F.when((F.col("l1") != "") & (F.col("r1") != ""), F.concat_ws("\0", F.lit("around"), "l1", "r1")),
    )
    edges = cut(seen.select("inst", F.explode(forms).alias("pattern")).where("pattern is not null").distinct())
    size = cut(edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= support))
    seeds = cut(seen.where("k is not null").groupBy("inst").agg(F.min("k").alias("k")).withColumn("score", F.lit(1.0)))
    known, found = seeds, None
    while True:
        mass = edges.join(known, "inst").groupBy("pattern", "k").agg(F.sum("score").alias("mass"), F.count("*").alias("n_known"))
        share = F.col("mass") / F.col("n") * (1 - 1 / (1 + F.col("n_known")))
        patterns = cut(mass.where(F.col("n_known") >= support).join(size, "pattern").select("pattern", "k", share.alias("p")).where(F.col("p") >= threshold))
        told = edges.join(small(patterns, patterns.count()), "pattern").where(shaped(F.col("k"), F.col("inst")))
        votes = told.groupBy("inst", "k").agg((1 - F.exp(F.sum(F.log(1 - F.col("p"))))).alias("score"))
        best = votes.groupBy("inst").agg(F.max(F.struct("score", (-F.col("k")).alias("k"))).alias("x")).select("inst", (-F.col("x.k")).alias("k"), F.col("x.score").alias("score"))
        now = cut(best.where(F.col("score") >= threshold).join(known, "inst", "left_anti"))
        if now.isEmpty():
            return found
        found = now if found is None else found.union(now)
        known = seeds.union(found.withColumn("score", FAITH * F.col("score")))


def personal_data(docs: DataFrame, support: int = 3, threshold: float = 0.6) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_discovered of every row.

    A null text is an empty one. Repeated rows are looked at each for itself; equal instances count once for the
    patterns, however often they occur. Spans that several kinds match are listed for each. A text of any length is read
    whole. An empty table gives no rows. Other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), base_spans(text).alias("base"), stretches(text).alias("near")))
    each = rows.where(F.size("near") > 0).select("row", F.explode("near").alias("x")).select("row", "x.*")
    new = discover(each, support, threshold)
    if new is None:
        out = rows.withColumn("more", F.array().cast(SPAN))
    else:
        more = each.where("k is null").drop("k").join(new, "inst").groupBy("row").agg(F.collect_set(F.struct("s", "k", "e")).alias("more"))
        out = rows.join(more, "row", "left").withColumn("more", F.coalesce("more", F.array().cast(SPAN)))
    names = F.array(*map(F.lit, KINDS))
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"])), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return out.select(
        "doc_id", *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)], F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.sort_array(F.concat("base", "more"))).alias("spans"), F.size("more").cast("long").alias("n_discovered"),
    )
