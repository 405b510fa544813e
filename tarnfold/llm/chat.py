"""Chat formatting as prefix trees: initial turns that conversations share are formatted and emitted once.

A turn is written `<turn role="R">T</turn>` and a line break. In R and T, a backslash, `<`, `>` and `"` become a
backslash and a letter, so no text can hold a mark of the template, and the change can be undone.

A node of the tree is a turn together with all turns before it; its id is a digest of its parent's id, its role and
its text. Conversations are put in an order in which those that share initial turns are neighbours: that of their
choices, the digests of their nodes where paths part. A node belongs to the first conversation that has it; the nodes
by conversation, then depth, are in depth-first order: each after its parent, and before its parent's next child. A
node has the interval [start, end) of the output that its characters take; the position id of its first character,
which is how many characters its ancestors have; the intervals of the output that it attends to besides itself, its
ancestors', neighbouring ones merged; and the interval under the loss. Units are code points, and stand for tokens.

Nothing holds a whole tree or a whole conversation: turns are rows, those of a conversation pass one by one through a
task that keeps a digest and a position, and where a partition's output begins is the sum of the partitions before.
What a conversation adds to the memory of a task is the list of its choices and of its merged intervals, which grow
with the number of places where others part from it, and not with its turns.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfold.llm.common import cut, drop, parts_for, shared_dir

ESCAPE = str.maketrans({"\\": "\\\\", "<": "\\l", ">": "\\g", '"': "\\q"})
PLAIN = {"\\": "\\", "l": "<", "g": ">", "q": '"'}
OPEN, ROLE_END, CLOSE = '<turn role="', '">', "</turn>\n"
TURN = re.compile(r'<turn role="([^"]*)">([^<]*)</turn>\n')
LEARNED = "assistant"
#: Bytes of a row of a node, and of one of a key besides the key, by which they are dealt to tasks.
NODE_BYTES, KEY_BYTES = 100, 50
TURN_ROWS = "conv_id long, depth long, node binary, parent binary, pos long, size long, text string, loss_start long, loss_end long"
READ_BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
INTERVALS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def escaped(text: str) -> str:
    return text.translate(ESCAPE)


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: PLAIN[m[1]], text)


def by_conversation(rows: DataFrame, *order: str) -> DataFrame:
    """A conversation's rows one after the other in one task, in order."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def names_of(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def turn_rows(turns: DataFrame) -> DataFrame:
    """A row a turn: its depth, its node and parent in the tree, its formatted text with its size and place, and the loss in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, node, pos, depth = (), b"", 0, 0  # () is no conv_id, not even a null one
        for b in batches:
            rows = []
            for conv_id, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if conv_id != conv:
                    conv, node, pos, depth = conv_id, b"", 0, 0
                parent, encoded = node, role.encode()
                node = hashlib.sha256(parent + len(encoded).to_bytes(8, "big") + encoded + text.encode()).digest()[:16]
                head, body = OPEN + escaped(role) + ROLE_END, escaped(text)
                loss = (len(head), len(head) + len(body)) if role == LEARNED else (None, None)
                size = len(head) + len(body) + len(CLOSE)
                rows.append((conv_id, depth, node, parent, pos, size, head + body + CLOSE, *loss))
                pos, depth = pos + size, depth + 1
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names_of(TURN_ROWS))

    whole = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    return by_conversation(whole, "turn", "role", "text").mapInArrow(run, TURN_ROWS)


def same_conversation(a: DataFrame, b: DataFrame) -> Column:
    return a["conv_id"].eqNullSafe(b["conv_id"])


def ranks(turns: DataFrame) -> DataFrame:
    """_conv, rank: an order of the conversations in which those that share initial turns are neighbours.

    turns: conv_id, depth, node, parent. A conversation's key has a digest for each of its nodes that has siblings.
    """
    nodes = turns.select("node", "parent").distinct()
    forks = nodes.groupBy("parent").agg(F.count("*").alias("n")).where("n > 1").select("parent")
    choices = nodes.join(forks, "parent", "left_semi").select("node", F.lit(True).alias("chosen"))
    marked = turns.join(choices, "node", "left")
    choice = F.when(F.col("chosen"), F.struct("depth", F.hex(F.substring("node", 1, 8)).alias("digest")))
    keys = marked.groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_list(choice))["digest"], "").alias("key"))
    keys = cut(keys)
    parts = parts_for(turns.sparkSession, int(keys.agg(F.sum(F.length("key") + F.lit(KEY_BYTES))).first()[0] or 0))
    ordered = keys.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    return cut(ordered.select(F.col("conv_id").alias("_conv"), F.monotonically_increasing_id().alias("rank")))


def offsets(nodes: DataFrame) -> DataFrame:
    """nodes (rank, depth, size and others) with start and end in the depth-first output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part = 0, TaskContext.get().partitionId()
        for b in batches:
            if b.num_rows:
                ends = pc.add(pc.cumulative_sum(b.column("size")), at)
                at = ends[-1].as_py()
                more = [ends, pa.repeat(pa.scalar(part, pa.int32()), b.num_rows)]
                yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, "end", "part"])

    nodes = cut(nodes)
    parts = parts_for(nodes.sparkSession, nodes.count() * NODE_BYTES)
    ordered = nodes.repartitionByRange(parts, "rank", "depth").sortWithinPartitions("rank", "depth")
    schema = ", ".join(f"{c} {t}" for c, t in ordered.dtypes) + ", end long, part int"
    local = cut(ordered.mapInArrow(run, schema))
    sums, base = [], 0
    for r in local.groupBy("part").agg(F.sum("size").alias("n")).orderBy("part").collect():  # a row a partition
        sums.append((r["part"], base))
        base += r["n"]
    bases = nodes.sparkSession.createDataFrame(sums, "part int, base long")
    placed = local.join(F.broadcast(bases), "part").withColumn("end", F.col("end") + F.col("base"))
    return placed.withColumn("start", F.col("end") - F.col("size")).drop("part", "base")


def with_ancestors(placed: DataFrame) -> DataFrame:
    """placed (conv_id, depth, start, end, own) with attends: the merged intervals of the turns before, where own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, before = (), []
        for b in batches:
            out = []
            for conv_id, start, end, own in zip(*(b.column(c).to_pylist() for c in ("conv_id", "start", "end", "own")), strict=True):
                if conv_id != conv:
                    conv, before = conv_id, []
                out.append([{"start": s, "end": e} for s, e in before] if own else None)
                if before and before[-1][1] == start:
                    before[-1] = before[-1][0], end
                else:
                    before.append((start, end))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, INTERVALS)], [*b.schema.names, "attends"])

    schema = ", ".join(f"{c} {t}" for c, t in placed.dtypes) + ", attends array<struct<start:long,end:long>>"
    return by_conversation(placed, "depth").mapInArrow(run, schema)


def write_trees(turns: DataFrame, folder: str) -> None:
    """Into folder: `nodes` (start, end, pos, attends, loss_start, loss_end, text), in depth-first order, and `leaves`.

    leaves (conv_id, depth, start) has a row for each turn of a conversation: where its node begins.
    """
    rows = cut(turn_rows(turns))
    turn = rows.select("conv_id", "depth", "node", "parent", "size")
    rank = ranks(turn)
    ranked = turn.join(rank, turn["conv_id"].eqNullSafe(rank["_conv"])).select("conv_id", "depth", "node", "size", "rank")
    firsts = ranked.groupBy("node").agg(F.min("rank").alias("rank"), F.first("depth").alias("depth"), F.first("size").alias("size"))
    nodes = offsets(firsts).select("node", "start", "end", F.col("rank").alias("_first"))
    placed = ranked.join(nodes, "node").select("conv_id", "depth", "start", "end", (F.col("rank") == F.col("_first")).alias("own"))
    placed = cut(with_ancestors(placed))
    placed.select("conv_id", "depth", "start").write.parquet(f"{folder}/leaves")
    own = placed.where("own").select("conv_id", "depth", "start", "end", "attends")
    final = rows.join(own, same_conversation(rows, own) & (rows["depth"] == own["depth"]))
    loss = [(F.col("start") + F.col(c)).alias(c) for c in ("loss_start", "loss_end")]
    parts = parts_for(turns.sparkSession, int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0))
    ordered = final.select("start", "end", "pos", "attends", *loss, "text").repartitionByRange(parts, "start").sortWithinPartitions("start")
    ordered.write.parquet(f"{folder}/nodes")


def read_conversations(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from the output alone."""
    pieces = leaves.join(nodes.select("start", "text", "loss_start", "loss_end"), "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, n, turns, learned, loss, chars, done = (), 0, hashlib.sha256(), 0, hashlib.sha256(), 0, []

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = list(zip(*done, strict=True)) or [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names_of(READ_BACK))

        for b in batches:
            done = []
            for conv_id, start, text, begin, end in zip(*(b.column(c).to_pylist() for c in ("conv_id", "start", "text", "loss_start", "loss_end")), strict=True):
                if conv_id != conv:
                    if conv != ():
                        done.append((conv, n, turns.hexdigest(), learned, loss.hexdigest(), chars))
                    conv, n, turns, learned, loss, chars = conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0
                for role, body in TURN.findall(text):
                    n += 1
                    turns.update(f"{unescaped(role)}\n{unescaped(body)}\n".encode())
                if begin is not None:
                    under = unescaped(text[begin - start : end - start])
                    learned += len(under)
                    loss.update(under.encode())
                chars += len(text)
            yield flush()
        if conv != ():
            done = [(conv, n, turns.hexdigest(), learned, loss.hexdigest(), chars)]
            yield flush()

    return by_conversation(pieces, "depth").mapInArrow(run, READ_BACK)


def round_trip(turns: DataFrame) -> DataFrame:
    """Write the trees of all conversations into the shared folder, read every conversation back, and delete the folder.

    Null roles and texts are empty strings; rows of one turn are turns in the order of role and text, a null turn
    first; repeated rows are turns of their own; rows without conv_id are one conversation. A conversation may have any
    number of turns, and a turn a text of any length. An empty table gives no rows. Other columns are not read.
    """
    spark = turns.sparkSession
    folder = f"{shared_dir(spark)}/chat-{uuid.uuid4().hex}"
    write_trees(turns, folder)
    out = cut(read_conversations(spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/leaves")))
    drop(spark, folder)
    return out
