"""The corpus pipeline: stages over the documents table, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cuesheet.llm import stages
from cuesheet.llm.scratch import Scratch

STAGES = [
    ("language_id", stages.keep_known_languages),
    ("line_dedup", stages.drop_repeated_lines),
    ("minhash_near_dedup", stages.keep_one_of_each_group),
    ("benchmark_decontamination", stages.drop_benchmark_leaks),
    ("sentencepiece", stages.encode_pieces),
]

# Language scores, near-duplicate groups and pieces are beyond SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
