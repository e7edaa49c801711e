"""The training-data pipeline: its stages in order, each from documents to documents, and a run over all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from labelloom.llm import stages
from labelloom.session import stored

STAGES = [
    ("quality_rules", stages.quality_rules),
    ("ngram_jaccard_join", stages.ngram_jaccard_join),
    ("benchmark_decontamination", stages.benchmark_decontamination),
    ("mixing", stages.mix),
    ("sharding", stages.shards),
]

# The knapsack of the mixing stage has no SQL form; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again as the next stage's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
