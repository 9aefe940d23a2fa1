"""The corpus pipeline: toxicity, exact dedup, n-gram Jaccard join, benchmark
decontamination, packing.

Each stage is written as Parquet into the shared checkpoint folder and read
again as the next one's documents. All but the last return the columns of
`documents`.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stockboard.llm import decontaminate, exact_dedup, jaccard_join, packing, toxicity
from stockboard.llm.common import scratch


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    net = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, net)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs).drop("ids")


STAGES = [("toxicity", without_toxic), ("exact dedup", without_copies),
          ("n-gram Jaccard join", without_near_copies), ("benchmark decontamination", without_benchmark), ("best-fit packing", packed)]
#: The network of the first stage cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
