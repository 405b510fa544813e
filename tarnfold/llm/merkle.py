"""Merkle manifest of a dataset: a root, a proof and a check for every row.

The leaves of a lang stand in the order of their doc_ids; every FAN consecutive nodes become their hash, until one, the
lang's subroot, is left; the subroots, in the order of their langs, become the root likewise.

* Leaves are hashed where the texts are read; only digests and ids are sorted, by ranges, so a lang of any size spreads
  over all tasks. What is counted in each range gives every leaf its rank.
* Blocks of FAN ** levels consecutive leaves are reduced to one node, each block by one task. `levels` grows with the
  rows, so that at most TOP nodes (and one a lang) are left for the driver.
* The driver builds the upper tree from these nodes and broadcasts it: what follows a block up to the root.
* Then each block is gone through again: its tree gives a leaf's siblings below, the upper tree those above; both make
  the proof, and the fold of what the row has become.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfold.llm.common import ascii_lower, cut, small

FAN = 8
#: Nodes of blocks that the driver takes; 32 bytes each.
TOP = 1 << 17
#: The least levels that a block is reduced by.
LEVELS = 4
#: Leaves that a task sorts.
RANGE_ROWS = 1 << 20
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
OUT = "doc_id long, lang string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def leaf(columns: dict[str, Column]) -> Column:
    """The digest of a row, as 32 bytes."""
    parts = []
    for name in FIELDS:
        value = columns[name].cast("string")
        parts.append(F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def digest(nodes: list[str]) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


def raised(nodes: list[str], fan: int = FAN) -> list[str]:
    return [digest(nodes[i : i + fan]) for i in range(0, len(nodes), fan)]


def runs(levels: list[list[str]], at: int, fan: int = FAN) -> Iterator[tuple[list[str], int]]:
    """What stands in one run with node `at` of the first level, then with its parent, and so on; and the place in it."""
    for nodes in levels:
        yield nodes[at - at % fan : at - at % fan + fan], at % fan
        at //= fan


@dataclass
class Upper:
    """The tree over the nodes of blocks. Levels that do not hold the one last node."""

    fan: int
    of_lang: dict[str | None, list[list[str]]]
    subroots: dict[str | None, str]
    of_langs: list[list[str]]
    place: dict[str | None, int]
    root: str

    @classmethod
    def build(cls, nodes: dict[str | None, list[str]], fan: int) -> Upper:
        def climb(level: list[str]) -> tuple[list[list[str]], str]:
            levels = []
            while len(level) > 1:
                levels.append(level)
                level = raised(level, fan)
            return levels, level[0]

        langs = sorted(nodes, key=lambda s: (s is not None, (s or "").encode()))
        climbed = {s: climb(nodes[s]) for s in langs}
        subroots = {s: x[1] for s, x in climbed.items()}
        of_langs, root = climb([subroots[s] for s in langs])
        return cls(fan, {s: x[0] for s, x in climbed.items()}, subroots, of_langs, {s: i for i, s in enumerate(langs)}, root)

    def path(self, lang: str | None, block: int) -> list[tuple[list[str], int]]:
        """The suffix of every proof of a block."""
        return [*runs(self.of_lang[lang], block, self.fan), *runs(self.of_langs, self.place[lang], self.fan)]


def block_levels(leaves: list[str], multiple: bool, levels: int, fan: int) -> list[list[str]]:
    """All levels of a block, its own node last: `levels` of them above the leaves, or as many as one block alone asks for."""
    out = [leaves]
    while len(out) <= levels and (multiple or len(out[-1]) > 1):
        out.append(raised(out[-1], fan))
    return out


def proofs(leaves: list[str], now: list[str], multiple: bool, levels: int, path: list[tuple[list[str], int]], fan: int) -> Iterator[tuple[str, str]]:
    """The proof's digest and the folded root of each leaf; now: the leaves as their rows are found."""
    below = block_levels(leaves, multiple, levels, fan)[:-1]
    above = "".join(x for run, p in path for x in run[:p] + run[p + 1 :])
    for i, cur in enumerate(now):
        siblings = []
        for run, p in runs(below, i, fan):
            siblings += run[:p] + run[p + 1 :]
            cur = digest([*run[:p], cur, *run[p + 1 :]])
        for run, p in path:
            cur = digest([*run[:p], cur, *run[p + 1 :]])
        yield digest([*siblings, above]), cur


def ranked(rows: DataFrame, parts: int) -> DataFrame:
    """rows with rank, from 0 in each lang by doc_id, and n, the lang's leaves. Rows with one doc_id go by their leaves.

    The rows are sorted by ranges, whatever langs they hold; a range's number and its first row give the rest.
    """
    order = ["lang", F.col("doc_id").asc_nulls_first(), "leaf", "now"]
    placed = cut(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    each = placed.groupBy("lang", F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("rows"), F.min("at").alias("first")).collect()
    before: dict[str | None, int] = {}
    starts = []
    for r in sorted(each, key=lambda r: r["part"]):  # one row a range, and one more a lang
        starts.append((r["lang"], r["part"], r["first"] - before.get(r["lang"], 0)))
        before[r["lang"]] = before.get(r["lang"], 0) + r["rows"]
    table = rows.sparkSession.createDataFrame([(*s, before[s[0]]) for s in starts], "l string, part long, start long, n long")
    same = F.col("lang").eqNullSafe(F.col("l")) & (F.shiftright("at", 33) == F.col("part"))
    return placed.join(small(table, len(starts)), same).withColumn("rank", F.col("at") - F.col("start")).drop("l", "part", "start", "at")


def manifest(docs: DataFrame, fan: int = FAN, top: int = TOP, levels: int = LEVELS, tampered: Column | None = None) -> DataFrame:
    """doc_id, lang, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    tampered: what the text of a row is found to be when it is checked, the text itself where it is None; a null text
    stays one. Nulls in any column are part of the leaf, and a null lang is the first. Rows that share a doc_id, or have
    none, are leaves of their own, by their digests, those without one first; rows that are equal in all five columns
    give rows equal but for their proofs. A text of any length is read whole. An empty table gives no rows. Other
    columns are not read.
    """
    spark, columns = docs.sparkSession, {name: docs[name] for name in FIELDS}
    found = leaf(columns if tampered is None else columns | {"text": tampered})
    rows = cut(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].cast("string").alias("lang"), leaf(columns).alias("leaf"), found.alias("now")))
    total = rows.count()
    if not total:
        return spark.createDataFrame([], OUT)
    while total > top * fan**levels:
        levels += 1
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_ROWS))
    size = fan**levels
    blocks = cut(ranked(rows, parts).withColumn("block", F.floor(F.col("rank") / size)))

    def in_order(t: pa.Table) -> tuple[pa.Table, list[str], bool]:
        t = t.sort_by("rank")
        return t, [x.as_py().hex() for x in t["leaf"]], t["n"][0].as_py() > size

    def reduce_block(key: tuple, t: pa.Table) -> pa.Table:
        _, leaves, multiple = in_order(t)
        node = block_levels(leaves, multiple, levels, fan)[-1][0]
        return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "block": pa.array([key[1].as_py()], pa.int64()), "node": [node]})

    nodes: dict[str | None, list[str]] = {}
    for r in sorted(blocks.groupBy("lang", "block").applyInArrow(reduce_block, "lang string, block long, node string").collect(), key=lambda r: r["block"]):
        nodes.setdefault(r["lang"], []).append(r["node"])
    upper = spark.sparkContext.broadcast(Upper.build(nodes, fan))

    def prove(key: tuple, t: pa.Table) -> pa.Table:
        lang, block, tree = key[0].as_py(), key[1].as_py(), upper.value
        t, leaves, multiple = in_order(t)
        made = list(proofs(leaves, [x.as_py().hex() for x in t["now"]], multiple, levels, tree.path(lang, block), fan))
        same, n = [folded == tree.root for _, folded in made], len(made)
        return pa.table(
            {
                "doc_id": t["doc_id"], "lang": pa.array([lang] * n, pa.string()), "leaf": leaves, "subroot": [tree.subroots[lang]] * n, "root": [tree.root] * n,
                "proof_sha256": [p for p, _ in made], "folded_root": [folded for _, folded in made], "verified": same,
            }
        )

    return blocks.groupBy("lang", "block").applyInArrow(prove, OUT)


def lowered_third(docs: DataFrame) -> Column:
    """The tampering of the registered query: where 3 divides crc32 of the decimal doc_id, the text's A-Z are lower-cased."""
    hit = F.crc32(docs["doc_id"].cast("long").cast("string").cast("binary")) % 3 == 0
    return F.when(hit, ascii_lower(docs["text"])).otherwise(docs["text"])
