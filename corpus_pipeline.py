"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing, sharding.

Every stage goes by rows and their texts, never by doc_id alone: rows that share an id, or have none, are judged each for
itself. Null and empty texts fail the quality rules. Texts of any length are read whole; an empty table gives none back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tarnfold.llm import decontam, mixing, quality, sharding, simhash
from tarnfold.llm.common import drop, shared_dir, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, written in the order of their slots: the next stage cuts that order into shards."""
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stretches of the written order; where docs does not come from files, there is none, and the shards are by key."""
    return sharding.shard_in_order(docs, sharding.written_order(docs) if docs.inputFiles() else None)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixed_sources),
    ("sharding", shards),
]
#: Fingerprints, the learned rules and the schedule are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what each returns is written to the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                drop(spark, f"{folder}/{k - 1}")
    return docs
