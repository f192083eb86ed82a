"""Subtitle and transcript texts per media."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesheet.functions import text as tx
from cuesheet.functions import times as tm
from cuesheet.ordering import POS, Ordered, as_ordered


def joined(df: DataFrame, keys: list[str], order: str, piece: Column, glue: str) -> DataFrame:
    """One text per key from pieces in order.  The text is the output itself."""
    packed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), piece.alias("t"))))
    out = df.groupBy(*keys).agg(packed.alias("_p"))
    return out.select(*keys, F.array_join(F.transform("_p", lambda x: x["t"]), glue).alias("text"))


def with_names(df: DataFrame, names: DataFrame | None) -> DataFrame:
    """Add ``speaker_name`` from names(media_id, speaker, name); Spark sizes the join."""
    if names is None:
        return df.withColumn("speaker_name", F.lit(None).cast("string"))
    return df.join(names.select("media_id", "speaker", F.col("name").alias("speaker_name")), ["media_id", "speaker"], "left")


def srt_blocks(rows: DataFrame | Ordered, *, show_speaker: bool = True, names: DataFrame | None = None) -> DataFrame:
    """One SRT block per segment: (media_id, block_no, block)."""
    o = as_ordered(rows)
    df = with_names(o.df, names)
    shown = tx.display_text(F.col("speaker"), F.col("text"), show_speaker=show_speaker, name=F.col("speaker_name"))
    number = F.col(POS) + 1
    return df.select(
        "media_id",
        number.alias("block_no"),
        F.concat_ws(
            "\n",
            number.cast("string"),
            F.concat(tm.srt_time(F.col("start_ms")), F.lit(" --> "), tm.srt_time(F.col("end_ms"))),
            shown,
        ).alias("block"),
    )


def export_srt(rows: DataFrame | Ordered, *, show_speaker: bool = True, names: DataFrame | None = None) -> DataFrame:
    blocks = srt_blocks(rows, show_speaker=show_speaker, names=names)
    out = joined(blocks, ["media_id"], "block_no", F.col("block"), "\n\n")
    return out.select("media_id", F.concat("text", F.lit("\n")).alias("srt"))


def export_json(rows: DataFrame | Ordered) -> DataFrame:
    """One JSON array of segments per media, times in seconds."""
    o = as_ordered(rows)
    item = F.to_json(segment_struct())
    out = joined(o.df, ["media_id"], POS, item, ",")
    return out.select("media_id", F.concat(F.lit("["), F.col("text"), F.lit("]")).alias("json"))


def segment_struct() -> Column:
    return F.struct(
        "id", tm.seconds(F.col("start_ms")).alias("start"), tm.seconds(F.col("end_ms")).alias("end"), "speaker", "text"
    )


def render_transcript(rows: DataFrame | Ordered) -> DataFrame:
    """Compact text ``[start][speaker]text[end]`` per media."""
    o = as_ordered(rows)
    piece = F.concat(
        F.lit("["), tm.seconds_text(F.col("start_ms")), F.lit("]["), F.col("speaker"), F.lit("]"), F.col("text"),
        F.lit("["), tm.seconds_text(F.col("end_ms")), F.lit("]"),
    )
    return joined(o.df, ["media_id"], POS, piece, "")
