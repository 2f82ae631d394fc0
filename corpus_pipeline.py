"""A corpus pipeline: toxicity, near copies, benchmark leaks, mixture, shards.

STAGES lists the stages by name; each takes (spark, docs, sf_dir) and gives the rows that go on.

In all stages rows go by their own contents, whatever their ids: null and repeated ids, nulls in any column and
repeated rows are rows like others; null texts count as empty; texts are read whole, however long; extra columns
pass through, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from equivox.llm import decontaminate, mixing, sharding, simhash, toxicity
from equivox.llm.session import table, written
from equivox.plans.shipping import ship


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; empty texts score as texts without a marked word do."""
    ship(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 of the shingles of five words) stays: that of the smallest id,
    nulls last, of equal ids the row whose columns hash lowest.  Texts without words are copies of each other; a text
    under five words is one shingle; rows equal in all columns are one."""
    ship(spark)
    return simhash.drop_near_copies(docs, words=5, similarity=0.8)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go; an item under five words is one shingle of all its words, an item
    without words is in nothing."""
    ship(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture draws them, dealt to shards and shuffled within each; a null source is a
    source, the last; repeated ids of a source share a block and are drawn alike."""
    ship(spark)
    return mixing.mix(docs).drop("mix_shard")


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shards; rows of one id share a shard, which is over the limit (marked) if they alone are."""
    ship(spark)
    return sharding.shard(docs)


STAGES = [("toxicity", toxic), ("simhash near-dedup", near_copies), ("benchmark decontamination", leaks), ("mixing", mixture), ("sharding", shards)]

ORACLE_SQL = None  # the toxicity model can't be expressed in SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
