"""Benchmark decontamination: a prefix-filtered join of item windows with the documents.

A window's set is its word shingles; with exact containment asked for, a prefix of one shingle is necessary, and
the rarest over all documents gives the fewest candidates. One pass over the texts finds where benchmark shingles stand:
rows of hashes and positions, without words. From those come the shingles' counts, then each window's prefix, and, by
position and length bounds, the candidates. Only texts with candidates are read again, once for copies of one text, and
each candidate is verified word by word. Windows go by number; the items that hold them join the result at the end.

A benchmark of up to BROADCAST_ROWS different shingles (16 bytes each) is broadcast; a larger one is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfold.llm.common import BROADCAST_ROWS, ascii_lower, cut, small, text_key, without

WINDOW = 10
SHINGLE = 5
DELIMITERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), DELIMITERS), "")


def shingle_hashes(column: str, size: Column, k: int) -> Column:
    """Hashes of the k-word shingles of an array column, in order."""
    one = lambda i: F.xxhash64(*[F.get(F.col(column), i + j) for j in range(k)])
    return F.when(size >= k, F.transform(F.sequence(F.lit(0), size - k), one)).otherwise(F.array().cast("array<bigint>"))


def windows(benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(win, w, n: a number, the words joined by spaces, and how many they are, of each different window; win, item_id of the items that hold it).

    item_id is a string; items without one hold windows, but are not listed.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("words")).withColumn("size", F.size("words"))
    n = F.least("size", F.lit(window))
    each = (
        items.where("size > 0")
        .select("item_id", n.alias("n"), F.explode(F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: F.slice("words", i, n))).alias("w"))
        .select("item_id", F.array_join("w", " ").alias("w"), "n")
        .distinct()
    )
    wins = cut(each.select("w", "n").distinct().withColumn("win", F.monotonically_increasing_id()))
    return wins, cut(each.where("item_id IS NOT NULL").join(wins.select("w", "win"), "w").select("win", "item_id"))


def numbered(sizes: list[int]) -> tuple[Column, Column, Column]:
    """All shingle hashes of the column words, those of one size after those of another; of place _at, its size and position."""
    n, start, size, pos = F.col("n_words"), F.lit(0), F.lit(None).cast("int"), F.lit(None).cast("int")
    for k in sizes:
        own = F.greatest(n - k + 1, F.lit(0))
        inside = (F.col("_at") >= start) & (F.col("_at") < start + own)
        size, pos = F.when(inside, k).otherwise(size), F.when(inside, F.col("_at") - start).otherwise(pos)
        start = start + own
    return F.concat(*[shingle_hashes("words", n, k) for k in sizes]), size, pos


def places(docs: DataFrame, hashes: DataFrame, sizes: list[int], window: int, broadcast_rows: int) -> DataFrame:
    """key, hash, k, pos of the places of shingles in the texts; and key, n_words, doc_id, with a null pos, for each document.

    docs: doc_id, key (of the text), text. hashes: the different hashes of all shingles. Few are broadcast, and every text
    is read once, in one stage. Many meet the texts' hashes by an exchange of hashes and positions alone; copies of a
    text then count as one. The work is in proportion to the texts: hashes are made before they are exploded, and no
    words go along.
    """
    every, size, pos = numbered(sizes)
    split_ = lambda rows: rows.withColumn("words", words(F.col("text"))).withColumn("n_words", F.size("words"))
    columns = ["doc_id", "key", "n_words", "hash", size.alias("k"), pos.alias("pos")]
    if hashes.count() <= broadcast_rows:
        # a place after all others, whose hash is 0, stands for the document
        end = F.array(F.lit(0).cast("bigint"))
        keys = hashes.union(docs.sparkSession.range(1).select("id")).distinct()
        each = split_(docs).select("doc_id", "key", "n_words", F.posexplode(F.concat(every, end)).alias("_at", "hash"))
        return each.join(F.broadcast(keys), "hash").select(*columns)
    each = split_(docs).select("doc_id", "key", "n_words", F.posexplode(every).alias("_at", "hash"))
    met = each.join(hashes, "hash").select(*columns).dropDuplicates(["key", "k", "pos"])
    none = F.lit(None).cast
    return met.unionByName(split_(docs).select("doc_id", "key", "n_words", none("long").alias("hash"), none("int").alias("k"), none("int").alias("pos")))


def prefixes(pieces: DataFrame, found: DataFrame) -> DataFrame:
    """win, n, hash, off: the rarest shingle of each window. A window with one that stands nowhere is ruled out."""
    counts = found.where("pos IS NOT NULL").groupBy("hash").agg(F.count("*").alias("met"))
    rarest = pieces.join(counts, "hash", "left").groupBy("win", "n").agg(F.min(F.struct(F.coalesce("met", F.lit(0)).alias("met"), "hash", "off")).alias("p"))
    return rarest.where("p.met > 0").select("win", "n", F.col("p.hash").alias("hash"), F.col("p.off").alias("off"))


def verified(docs: DataFrame, near: DataFrame, wins: DataFrame) -> DataFrame:
    """key, win, start, n of the candidates (near: the same) whose words are the window's. Each text is read for all of its own at once."""
    asked = near.join(wins.select("win", "w"), "win").groupBy("key").agg(F.collect_set(F.struct("start", "n", "win", "w")).alias("asked"))
    asked = cut(asked)
    texts = docs.join(small(asked.select("key"), asked.count()), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    same = lambda c: F.array_join(F.slice("words", c["start"] + 1, c["n"]), " ") == c["w"]
    each = texts.join(asked, "key").select("key", words(F.col("text")).alias("words"), "asked")
    return each.select("key", F.explode(F.filter("asked", same)).alias("x")).select("key", "x.win", "x.start", "x.n")


def judged(docs: DataFrame, benchmark: DataFrame, window: int, shingle: int, broadcast_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, key of the text, n_words of every row; key, win, start, n of the hits in each different text; win, item_id)."""
    wins, items = windows(benchmark, window)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), "text")
    k = F.least("n", F.lit(shingle))
    cuts = F.transform(F.sequence(F.lit(1), F.col("n") - F.col("k") + 1), lambda i: F.slice("ws", i, F.col("k")))
    cut_up = cut(wins.select("win", "n", k.alias("k"), F.split("w", " ").alias("ws")).select("win", "n", "k", F.posexplode(cuts).alias("off", "words")))
    sizes = sorted({shingle} | {r["k"] for r in cut_up.select("k").distinct().collect()}, reverse=True)  # 1 to shingle
    of_size = [cut_up.where(F.col("k") == k).select("win", "n", "off", F.xxhash64(*[F.get("words", F.lit(j)) for j in range(k)]).alias("hash")) for k in sizes]
    pieces = cut(reduce(DataFrame.union, of_size))
    found = cut(places(texts, cut(pieces.select("hash").distinct()), sizes, window, broadcast_rows))
    prefix = cut(prefixes(pieces, found))
    start = F.col("pos") - F.col("off")
    lengths = found.where("pos IS NOT NULL")
    near = lengths.join(F.broadcast(prefix) if prefix.count() <= broadcast_rows else prefix, "hash").withColumn("start", start)
    bounds = (F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.col("n_words"))
    hits = cut(verified(texts, near.where(bounds).select("key", "win", "start", "n"), wins))
    return found.where("pos IS NULL").select("doc_id", "key", "n_words"), hits, items


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of docs.

    A null or empty text has no words and is clean; an empty benchmark leaves all clean; repeated rows are judged
    each for itself, also where they share a doc_id; a window that several items hold counts for each of them, and
    one of an item without item_id marks words but counts for no item. A text of any length is read whole. An empty
    table gives no rows. Columns other than doc_id and text (item_id and text) are not read.
    """
    rows, hits, items = judged(docs, benchmark, window, shingle, broadcast_rows)
    places_of = F.collect_set(F.struct("start", "n"))
    covered = F.array_distinct(F.flatten(F.transform(places_of, lambda h: F.sequence(h["start"], h["start"] + h["n"] - 1))))
    hit = hits.groupBy("key").agg(F.size(covered).cast("long").alias("n_hit"))
    listed = hits.select("key", "win").distinct().join(items, "win").groupBy("key").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    named = listed.select("key", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    of_text = cut(hit.join(named, "key", "left"))
    out = rows.join(small(of_text, of_text.count()), "key", "left")
    n_hit, none = F.coalesce("n_hit", F.lit(0)).cast("long"), F.sha2(F.lit(""), 256)
    return out.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", none).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of docs whose own text holds no window, whatever their doc_ids. Null texts stay.

    Texts cross an exchange only if more than BROADCAST_ROWS different texts go. A text of any length is read whole. An
    empty table gives no rows, and an empty benchmark all. docs may have further columns of any names, which stay as they are.
    """
    _, hits, _ = judged(docs, benchmark, window, shingle, broadcast_rows)
    return without(docs, hits.select("key"), text_key(docs["text"]))
