"""The corpus pipeline: quality, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
docs. ``run`` writes each stage's result as Parquet in the shared folder and gives it to the next one.
An empty table passes through all stages as an empty one; further columns, whatever they are called, are
kept by all but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import decontam, mixing, quality, sharding, simhash
from tracewell.llm.common import read_table, staged


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of a half or more; null and empty texts have a score as any text, repeated rows equal ones."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the smallest id's; null and empty texts are one group, rows without an id come last in theirs."""
    return simhash.keep_first(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark; null and empty texts hold none."""
    return decontam.without_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that a document is taken; null languages and sources are "unknown", rows of one id are taken together."""
    return mixing.select(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row; a null id is a key of its own, a null text has no bytes."""
    return sharding.shard_documents(docs)


STAGES = [("quality", good_quality), ("near_duplicates", no_near_duplicates), ("decontamination", no_benchmark), ("mixing", mixed), ("sharding", sharded)]

#: The classifier and the fingerprints' search aren't SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
