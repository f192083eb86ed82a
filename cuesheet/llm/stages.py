"""The operators as stages over the documents table: each takes and returns its rows, the last returns tokens.

Every stage keeps all columns of the rows that stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.llm import language, latent, lines, minhash, pieces
from cuesheet.llm.queries import PIECE_FILE, tokenizer_file
from cuesheet.llm.scratch import Scratch


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; ``lang`` is what they declare, ``source`` stands for the host."""
    model = language.fit(docs)
    out = language.identify(docs, model, F.col("text"), F.col("lang"), F.col("source"))
    return out.filter("language_known").select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds are cut out; ``n_chars`` follows the text."""
    out = lines.drop_repeated_lines(docs)
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text")).otherwise(F.col("n_chars"))).select(docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the document with the smallest id."""
    groups = minhash.near_duplicates(docs)
    gone = Scratch(spark, "pipeline").keep(groups.filter("NOT kept").select(F.col("doc").alias("doc_id")), "duplicates")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = latent.benchmark_matches(docs, benchmark).select("doc", "version").distinct()
    found = Scratch(spark, "pipeline").keep(found, "leaks")
    rows = docs.withColumn("_version", F.xxhash64("text"))
    return rows.join(found, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("_version") == F.col("version")), "left_anti").select(docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the pieces of every document that is left."""
    return pieces.piece_digests(docs, tokenizer_file(PIECE_FILE))
