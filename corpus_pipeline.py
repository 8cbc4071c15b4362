"""A training-corpus pipeline over `documents`: each stage takes what the one before it kept, written as Parquet and read again.

quality classifier (rejected documents go) -> SimHash near-duplicates (one document of each group stays) -> benchmark
decontamination (documents that hold a benchmark item go) -> mix of sources to target weights (documents are left out or
repeated as their source's target asks) -> shards (an assignment of every row).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftframe.llm import decontaminate, mixing, quality_classifier, sharding, simhash
from driftframe.llm.common import forget, stored
from driftframe.runtime import ship, table

SHARDS = 40


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; it is fitted on the labelled ones among docs."""
    ship(spark)
    model, _ = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    return model.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints: that with the least doc_id."""
    ship(spark)
    return simhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    ship(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them, up to twice each."""
    ship(spark)
    return mixing.apply(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    ship(spark)
    return sharding.shard(docs, SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("shards", shards),
]

#: No stage but the last is expressible in SQL; tests hold the pipeline against its stages' brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        kept = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        forget(docs)
        docs = kept
    return docs
