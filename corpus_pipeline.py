"""The corpus pipeline: its stages over ``documents``, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm.common import materialise, release, table
from gneiss.llm.decontaminate import keep_clean
from gneiss.llm.jaccard_join import keep_one
from gneiss.llm.langid import keep_known
from gneiss.llm.mixing import mixed_documents
from gneiss.llm.sharding import assign_shards


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is near no language's centroids go. What Python workers judge is written here, in small batches."""
    return materialise(keep_known(docs), "stage-language")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return materialise(keep_clean(docs, table(spark, sf_dir, "benchmark")), "stage-benchmark")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document stays as often as the mix takes it."""
    return mixed_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document of the mix goes: doc_id, size, text_crc32, shard, grown_shard, slot."""
    return assign_shards(docs).withColumn("slot", F.col("slot").cast("long"))


STAGES = [("language", language), ("jaccard", near_copies), ("benchmark", benchmark), ("mix", mix), ("shard", shards)]

#: Hashed vectors, trained centroids and banded alignment have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        told = stage(spark, docs, sf_dir)
        if not hasattr(told, "_table"):
            told = materialise(told, f"stage-{name}")
        release(docs)
        docs = told
    return STAGES[-1][1](spark, docs, sf_dir)
