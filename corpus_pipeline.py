"""A training-corpus pipeline over ``documents``, each stage one corpus operator.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and
returns rows with the columns of ``documents``; the last returns the shard table.
``run`` writes every stage as Parquet under the shared folder and reads it again.
Tables that a stage writes for itself go before it returns, and Spark is told to drop
the shuffle files of a query when the query ends, so later stages do not pay for
the disk of earlier ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiforge.llm import decontaminate, mixing, ngram_join, quality, sharding
from kpiforge.llm.common import table
from kpiforge.session import drop_shuffles, materialize, scratch


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the compression classifier rejects."""
    drop_shuffles(spark)
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates (five-word shingles, similarity 0.8)."""
    drop_shuffles(spark)
    return ngram_join.keep_representatives(docs, k=5, percent=80)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents contaminated by the benchmark."""
    drop_shuffles(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat, keep or drop documents so that the sources meet their target weights."""
    drop_shuffles(spark)
    with scratch(spark) as keep:
        mix = keep(mixing.mix(docs), "pipeline-mix")
    return mixing.apply_mix(docs, mix)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put every row into one of 16 shards of near equal size."""
    drop_shuffles(spark)
    with scratch(spark) as keep:
        placed = keep(sharding.assign(docs, shards=16), "pipeline-shards")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot")


STAGES = [
    ("quality_classifier", good_quality),
    ("ngram_join", near_distinct),
    ("benchmark_decontamination", clean_of_benchmark),
    ("source_mixing", mixed),
    ("sharding", sharded),
]

#: SQL cannot train the classifier.  The operators are held against plain Python in tests/llm/test_operators.py;
#: tests/llm/test_pipeline.py only compares near duplicates and decontamination with the same operators' output and
#: checks the row count and shard range of sharding, not what the quality stage rejects or what mixing takes.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
