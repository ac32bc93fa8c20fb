"""The corpus pipeline: quality, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept.  All but the last return the columns of documents.  run() writes each
stage's result as Parquet in the shared folder and reads it again.

There is no SQL for the whole: the classifier, signatures and the suffix
automaton are no SQL.  Tests compare the stages with brute force instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellwright.llm import decontaminate, mixing, near_dedup, quality, sharding
from cellwright.llm._base import Scratch, dropped_after, table

ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of bad quality, and toxic ones (operator 6, fitted on the labelled documents among docs)."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates (operator 1: five words, similarity 0.8).

    The one of least id stays; of a group without ids, one without id.  Of rows
    that are equal in id and text one stays.  Texts without words are in no group.
    """
    return near_dedup.one_of_each(docs, width=5, percent=80)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut benchmark passages from texts, and drop documents of which more than half is hit (operator 3)."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (operator 7)."""
    return mixing.mixed(docs)


def to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add shard, slot and grown_shard (operator 10)."""
    return sharding.assign(docs)


STAGES = [
    ("quality", keep_good),
    ("near-duplicates", keep_one_of_each),
    ("decontamination", cut_benchmark),
    ("mixing", mix_sources),
    ("sharding", to_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents.

    A stage's result is written before the next one starts; then the tables of
    its operator and the stage before it are deleted.
    """
    scratch = Scratch(spark, "pipeline")
    docs, last = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        with dropped_after():
            docs = scratch.table(stage(spark, docs, sf_dir), f"{k}-{name}")
        if last is not None:
            scratch.drop(last)
        last = f"{k}-{name}"
    return docs
