"""The corpus pipeline: quality rules, near duplicates, decontamination, mixing, sharding.

Every stage works on all rows that the stage before it kept. Between stages the rows are a Parquet
table in the shared folder.

Defined results of every stage: columns of any name stay as they are (sharding replaces a column
``shard``); very long texts are read whole; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenfold.llm import decontaminate, jaccard_join, mixing, quality_rules, sharding
from lumenfold.llm.common import table, written


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, and whose host does.

    Null and empty texts fail; a null source is a host; repeated rows stay or go together.
    """
    return quality_rules.keep_good(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates.

    That of the least ``doc_id`` stays, then of the least MD5 of its text, then any; a null id is the
    largest. Rows without words are in no group and stay.
    """
    return jaccard_join.one_of_each(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item.

    Each row is judged by its text; null and empty texts stay, and empty items are in no text.
    """
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    Rows without words stay once. Rows equal in id, text and source tie in the draw, and of ties as many
    are taken as are needed. A null source is a source.
    """
    return mixing.mixed(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard.

    Equal texts are in one shard; null texts are together by ``doc_id``; ties go by the texts' MD5.
    """
    return sharding.with_shard(docs)


STAGES = [
    ("quality rules", good),
    ("near duplicates", distinct),
    ("decontamination", clean),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: Edit matching, subset sums and differencing are beyond SQL; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
