"""Helpers that the corpus operators share."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.session import cut, drop, shared_dir

__all__ = ["BROADCAST_ROWS", "LOWER", "SPACE", "UPPER", "ascii_lower", "cut", "drop", "fresh", "kept", "parts_for", "row_of", "shared_dir", "small", "table", "text_key", "without"]

#: ASCII white space, as the word patterns of the operators name it.
SPACE = r"[\x20\x09-\x0D]"
#: Tables of small rows are broadcast up to so many rows, and shuffled beyond.
BROADCAST_ROWS = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(key: object, make):
    """What make() gives, made once in a Python worker and kept there from task to task."""
    store = sys.__dict__.setdefault("_tarnfold_kept", {})
    if key not in store:
        store[key] = make()
    return store[key]


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if it has no more than BROADCAST_ROWS rows; they must be small ones."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def parts_for(spark: SparkSession, size: int, each: int = 64 << 20) -> int:
    """Partitions for so many bytes: those of the session, or more, so that one has about `each` at most."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


def text_key(text: Column) -> Column:
    """128 bits of a text; a null text has a key of its own, which is not that of an empty one."""
    whole = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(whole, text.isNull()).alias("a"), F.xxhash64(text.isNull(), whole).alias("b"))


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with underscores after it, so that no column of df has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_of(df: DataFrame) -> Column:
    """All columns of df as a struct, whatever their names."""
    return F.struct(*[df[f"`{c.replace('`', '``')}`"].alias(c) for c in df.columns])


def without(docs: DataFrame, keys: DataFrame, key: Column) -> DataFrame:
    """The rows of docs whose key is not in keys (one column, no nulls in it). Texts cross an exchange only if keys are many.

    docs may have any columns.
    """
    gone = fresh(docs, "_gone")
    keys = cut(keys.toDF(gone).distinct())
    return docs.join(small(keys, keys.count()), key == F.col(gone), "left_anti")
