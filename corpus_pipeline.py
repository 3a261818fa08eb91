"""A corpus pipeline of five stages over ``documents``, each one of the operators of ``policylake.llm``.

Every stage is written as Parquet and read again as the next one's documents. All but the last
return the columns of documents; the last returns where each document's ids lie in the token files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from policylake.llm import decontaminate, mixing, quality, queries, simhash, tokens
from policylake.session import materialize

#: Two stages learn from or hash the whole corpus, which SQL can't express: tested against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, replica=None, order=None)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = queries.new_folder(spark, "tokens")
    tokens.write_tokens(docs, path, queries.tokenizer())
    return tokens.read_tokens(spark, path)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("source mixing", source_mixing),
    ("token output", token_output),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
