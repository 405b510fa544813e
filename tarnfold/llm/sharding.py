"""Sharding by histogram sort: equal bytes for every shard, one exchange.

Rows are in order of a whole-number key. Each splitter starts with the whole key range; a round counts, over all
partitions, the exact bytes and rows below evenly spaced probes inside the range of every open splitter, and keeps
the one cell that holds the splitter's byte target. A splitter is done when its cell is a single key or within the
tolerance. Then the rows are exchanged once, by splitter, and numbered.

A shard is written by as many tasks as its bytes ask for: parts, which have splitters of their own. Splitters are a
constant array, searched by halves in every row, so their number costs next to nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfold.llm.common import cut, fresh

OVERHEAD = 16
#: Counts that the driver takes in a round for each open splitter, and at most for all of them.
PROBES, PROBES_ALL = 256, 1 << 17
#: Bytes that a task sorts.
PART_BYTES = 256 << 20
#: Bytes of a row of shard()'s own columns.
ROW_BYTES = 64
#: The share of a part's bytes by which a splitter may miss its target.
TOLERANCE = 0.001


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD


def group_key(text: Column, tie: Column) -> Column:
    """63 bits: 31 of the text, so that equal texts are neighbours, then 32 of what tells them apart."""
    high = F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit("")), text.isNull()), 33)
    return F.shiftleft(high, 32).bitwiseOR(F.shiftrightunsigned(F.xxhash64(tie), 32))


def constants(values: list[int]) -> Column:
    """A constant array of whole numbers, however many."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def at_or_below(values: list[int], key: Column) -> Column:
    """How many of the sorted values are key or less: a binary search."""
    n, found = len(values), constants(values)
    if not n:
        return F.lit(0)
    halves = F.array(*[F.lit(1 << b) for b in reversed(range(n.bit_length()))])
    further = lambda p, b: F.when((p + b <= n) & (F.get(found, p + b - 1) <= key), p + b).otherwise(p)
    return F.aggregate(halves, F.lit(0), further)


@dataclass(frozen=True)
class Splits:
    """bounds: keys that begin parts 1.. in order; bytes and rows: how many are below each part, from part 0; per: parts a shard."""

    bounds: list[int]
    bytes: list[int]
    rows: list[int]
    per: int

    def part(self, key: Column) -> Column:
        return at_or_below(self.bounds, key)


@dataclass
class Cell:
    """The keys lo..hi that hold a byte target; what is below them."""

    target: int
    lo: int
    hi: int
    bytes: int
    rows: int


def split(rows: DataFrame, key: str, size: str, shards: int, per: int = 1, probes: int = PROBES, tolerance: float = TOLERANCE) -> Splits:
    """Splitters for shards * per parts with near equal bytes. The driver holds `probes` counts for each of them.

    tolerance: the share of a part's bytes within which a splitter may miss its target; 0 refines to single keys. A
    splitter never misses by more than half of the rows of one key.
    """
    parts = shards * per
    total, count, lo, hi = rows.agg(F.sum(size), F.count("*"), F.min(key), F.max(key)).first()
    if not count:
        return Splits([0] * (parts - 1), [0] * parts, [0] * parts, per)
    total, probes = int(total), max(2, min(probes, PROBES_ALL // parts))
    slack = tolerance * total / parts
    open_ = [Cell(total * i // parts, lo, hi, 0, 0) for i in range(1, parts)]
    done: list[tuple[int, int, int]] = []
    while open_:
        ranges = sorted({(c.lo, c.hi) for c in open_})  # disjoint, as all come from the same counts
        los, his, steps = [a for a, _ in ranges], [b for _, b in ranges], [(b - a) // probes + 1 for a, b in ranges]
        pick = lambda values: F.element_at(constants(values), F.col("_c"))
        counts = (
            rows.select(key, size, at_or_below(los, F.col(key)).alias("_c"))
            .where(F.col("_c") > 0)
            .where(F.col(key) <= pick(his))
            .select("_c", key, size, F.call_function("div", F.col(key) - pick(los), pick(steps)).alias("_p"))
            .groupBy("_c", "_p")
            .agg(F.sum(size).alias("b"), F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi"))
            .collect()
        )
        cells: dict[tuple[int, int], list] = {}
        for r in sorted(counts, key=lambda r: (r["_c"], r["_p"])):
            cells.setdefault(ranges[r["_c"] - 1], []).append(r)
        again = []
        for c in open_:
            b, n = c.bytes, c.rows
            for r in cells[c.lo, c.hi]:
                if c.target < b + r["b"]:
                    break
                b, n = b + int(r["b"]), n + r["n"]
            if r["lo"] < r["hi"] and r["b"] > slack:
                again.append(Cell(c.target, r["lo"], r["hi"], b, n))
            elif c.target - b <= r["b"] / 2:
                done.append((r["lo"], b, n))
            else:
                done.append((r["hi"] + 1, b + int(r["b"]), n + r["n"]))
        open_ = again
    done.sort()
    return Splits([k for k, _, _ in done], [0, *(b for _, b, _ in done)], [0, *(n for _, _, n in done)], per)


def place(df: DataFrame, key: str, splits: Splits, ties: list[Column]) -> DataFrame:
    """df with shard and slot (gapless from 0 in each shard, in the order of key, then ties): the one exchange."""
    parts, per = len(splits.rows), splits.per
    base = [splits.rows[i] - splits.rows[i // per * per] for i in range(parts)]
    part = fresh(df, "_part")
    parted = df.withColumn(part, splits.part(F.col(key))).repartitionById(parts, part)
    number = F.row_number().over(Window.partitionBy(part).orderBy(key, *ties)).cast("long") - 1
    return (
        parted.withColumn("slot", number + F.element_at(constants(base), F.col(part) + 1))
        .withColumn("shard", F.floor(F.col(part) / per).cast("int"))
        .drop(part, key)
    )


def parts_of(shards: int, size: int, part_bytes: int) -> int:
    """Parts a shard, so that a part has about part_bytes or less."""
    return max(1, -(-size // (shards * part_bytes)))


def shard(docs: DataFrame, shards: int = 40, part_bytes: int = PART_BYTES, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row, under the law `bytes`.

    Equal texts are neighbours, so a group of copies fills shards one after the other and crosses as few bounds as
    its size allows. A null text has size 16 and the crc of no bytes. Rows with equal doc_id and text have one key
    and stay together; a bound then misses its target by their bytes. So it does by those of a very long text, which
    is one row. An empty table gives no rows. Other columns are not read.
    """
    text = F.col("text")
    rows = cut(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), size_of(text).alias("size"),
            F.crc32(F.coalesce(text.cast("binary"), F.lit(b""))).alias("text_crc32"), group_key(text, F.col("doc_id")).alias("_key"),
        )
    )
    per = parts_of(shards, rows.count() * ROW_BYTES, part_bytes)
    splits = split(rows, "_key", "size", shards, per, tolerance=tolerance)
    return place(rows, "_key", splits, [F.col("doc_id"), F.col("text_crc32")]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def written_order(docs: DataFrame | None = None) -> Column:
    """A key for the order in which the rows of written Parquet files were written: number of the file, then of the row.

    docs: the rows, needed where one of their own columns is named _metadata.
    """
    at = F.col("_metadata") if docs is None else docs.metadataColumn("_metadata")
    part = F.coalesce(F.regexp_extract(at["file_name"], r"part-(\d+)", 1).try_cast("long"), F.lit(0))
    return F.shiftleft(part, 40).bitwiseOR(at["row_index"])


def shard_in_order(docs: DataFrame, order: Column | None = None, shards: int = 40, part_bytes: int = PART_BYTES, tolerance: float = TOLERANCE) -> DataFrame:
    """docs with size, shard and slot: shards are stretches of equal bytes of an order.

    order: a key of whole numbers, as written_order() for rows that come straight from Parquet files; the order of
    shard() where it is None.
    Texts cross one exchange, in parts of about part_bytes. Columns of docs with the names size, shard and slot are
    replaced; further ones of any names stay as they are. A null text has size 16; one of any length is one row. An
    empty table gives no rows.
    """
    key = fresh(docs, "_key")
    keyed = docs.withColumn(key, group_key(docs["text"], docs["doc_id"]) if order is None else order).withColumn("size", size_of(docs["text"]))
    sizes = cut(keyed.select(key, "size"))
    per = parts_of(shards, int(sizes.agg(F.sum("size")).first()[0] or 0), part_bytes)
    return place(keyed, key, split(sizes, key, "size", shards, per, tolerance=tolerance), [])
