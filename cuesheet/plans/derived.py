"""Inputs derived from the given tables, as DataFrames (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.ordering import POS, Ordered, arrange


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _timeline(rows: DataFrame) -> Ordered:
    """Lay sentences on a millisecond timeline."""
    o = arrange(rows, ("media_id",), ("turn", "pos"))
    idx = F.col(POS) + 1
    long_gap = F.when(idx % 41 == 0, 15_000).when(idx % 17 == 0, 2_000).otherwise(0)
    gap = ((F.col("media_id") * 7 + idx * 13) % 11) * 150 - 300 + long_gap
    o = o.with_columns({"idx": idx, "_dur": 300 + 55 * F.length("text").cast("bigint")})
    o = o.running({"_cum": ("sum", F.col("_dur") + gap)})
    o = o.with_columns(
        {
            "start_ms": F.greatest(F.col("_cum") - F.col("_dur"), F.lit(0)),
            "end_ms": F.greatest(F.col("_cum"), F.lit(0)),
        }
    )
    return o.of(o.df.drop("turn", "pos", "_dur", "_cum"))


def _sentences(text: str) -> Column:
    return F.split(F.replace(F.col(text), F.lit(". "), F.lit(".\n")), "\n")


def conversation_segments(spark: SparkSession, sf_dir: str) -> Ordered:
    turns = table(spark, sf_dir, "conversations")
    speaker = F.when(F.col("role") == "user", "S01").when(F.col("role") == "assistant", "S02").otherwise("S03")
    rows = (
        turns.select(F.col("conv_id").alias("media_id"), "turn", speaker.alias("speaker"), F.posexplode(_sentences("text")).alias("pos", "text"))
        .filter(F.col("text") != "")
    )
    return _timeline(rows)


def document_segments(spark: SparkSession, sf_dir: str) -> Ordered:
    docs = table(spark, sf_dir, "documents")
    rows = (
        docs.select(
            F.col("doc_id").alias("media_id"),
            F.lit(0).cast("bigint").alias("turn"),
            F.lit("S00").alias("speaker"),
            F.posexplode(_sentences("text")).alias("pos", "text"),
        )
        .filter(F.col("text") != "")
    )
    return _timeline(rows)
