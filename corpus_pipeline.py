"""The corpus pipeline: five stages over ``documents``, each the operator of its name with production parameters.

Each stage takes (spark, docs, sf_dir) and returns the rows that it keeps, with the columns of ``documents``; the last
returns where each row goes. ``run`` writes each stage's result as Parquet to the shared folder and reads it again.

Rows: toxicity drops documents predicted toxic; near-dedup keeps the least id of each group (5-word shingles,
similarity 0.8); decontamination drops documents that hold a benchmark item; mixing repeats or drops documents so
that sources meet their targets; sharding gives each row its shard and slot.
"""

from pyspark.sql import DataFrame

from tidemark.llm._runtime import materialize
from tidemark.llm.decontaminate import drop_leaks
from tidemark.llm.mixing import mixed_documents
from tidemark.llm.near_dedup import one_of_each
from tidemark.llm.sharding import shard_rows
from tidemark.llm.toxicity import drop_toxic


def toxicity(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def decontamination(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def sharding(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shard_rows(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: Learnt scores, latent search and signatures have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
