"""SRT and ASS texts -> segments, and the choice of file per media."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.functions import text as tx
from cuesheet.functions import times as tm
from cuesheet.operators.segments import number_id

BOM = "﻿"


def read_subtitle_texts(spark: SparkSession, path: str) -> DataFrame:
    """(media_id = folder of the file, kind, modified, text) for every file under ``path``."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    where = F.col("_metadata.file_path")
    return files.select(
        F.regexp_extract(where, r"([^/]+)/[^/]+$", 1).alias("media_id"),
        F.regexp_extract(where, r"([^/]+)$", 1).alias("name"),
        F.lower(F.regexp_extract(where, r"\.([^./]+)$", 1)).alias("kind"),
        F.col("_metadata.file_modification_time").alias("modified"),
        F.regexp_replace("value", f"^{BOM}", "").alias("text"),
    )


def parse_srt(df: DataFrame) -> DataFrame:
    """(media_id, text) -> segments.  Bad blocks are skipped but keep their number in the ids."""
    text = tx.strip(F.coalesce("text", F.lit("")))
    blocks = F.split(text, rf"\r?\n{tx.WS}*\r?\n", -1)
    rows = df.select("media_id", F.posexplode(blocks).alias("pos", "block"))
    lines = F.filter(tx.lines_of(F.col("block")), lambda line: F.length(tx.strip(line)) > 0)
    rows = rows.withColumn("lines", lines).filter(F.size("lines") >= 2)
    first, second = F.col("lines")[0], F.col("lines")[1]
    numbered = second.contains("-->")
    timing = F.when(numbered, second).otherwise(first)
    # A first line equal to the timing line counts as the timing line too.
    body_from = F.when(timing == second, 3).otherwise(2)
    body = F.array_join(F.slice("lines", body_from, F.greatest(F.size("lines"), F.lit(1))), "\n")
    rows = rows.withColumn("timing", timing).withColumn("body", body).filter(F.col("timing").contains("-->"))
    cut = F.instr("timing", "-->")
    rows = rows.withColumn("start_ms", tm.parse_srt_time(tx.strip(F.substring("timing", F.lit(1), cut - 1)))).withColumn(
        "end_ms", tm.parse_srt_time(tx.strip(F.substring("timing", cut + 3, F.length("timing"))))
    )
    rows = rows.filter(F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull())
    return _rows(rows.withColumn("said", tx.prefixed_speaker(F.col("body"))), F.col("said.speaker"))


def parse_ass(df: DataFrame) -> DataFrame:
    """(media_id, text) -> segments from ``Dialogue:`` lines; ids carry the line number."""
    rows = df.select("media_id", F.posexplode(tx.lines_of(F.coalesce("text", F.lit("")))).alias("pos", "line"))
    rows = rows.withColumn("line", tx.strip(F.col("line"))).filter(F.col("line").startswith("Dialogue:"))
    rows = rows.withColumn("parts", F.split("line", ",", 10)).filter(F.size("parts") == 10)
    part = lambda i: tx.strip(F.col("parts")[i])
    rows = rows.withColumn("start_ms", tm.parse_ass_time(part(1))).withColumn("end_ms", tm.parse_ass_time(part(2)))
    rows = rows.filter(F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull())
    rows = rows.withColumn("said", tx.prefixed_speaker(tx.strip(tx.strip_ass_markup(F.col("parts")[9]))))
    named = F.when(F.length(part(4)) > 0, part(4)).otherwise(tx.DEFAULT_SPEAKER)
    return _rows(rows, F.when(F.col("said.speaker") != tx.DEFAULT_SPEAKER, F.col("said.speaker")).otherwise(named))


def _rows(rows: DataFrame, speaker) -> DataFrame:
    number = (F.col("pos") + 1).cast("bigint")
    return rows.select(
        "media_id",
        number.alias("idx"),
        number_id(number).alias("id"),
        "start_ms",
        F.greatest("start_ms", "end_ms").alias("end_ms"),
        speaker.alias("speaker"),
        F.col("said.body").alias("text"),
    )


def ass_resolution(df: DataFrame) -> DataFrame:
    """(media_id, text) -> (media_id, width, height); the last header line wins, default 1920x1080."""
    line = F.regexp_extract_all("text", F.lit(r"(?m)^PlayRes{}:([^\r\n]*)".replace("{}", "X")), F.lit(1))
    tall = F.regexp_extract_all("text", F.lit(r"(?m)^PlayResY:([^\r\n]*)"), F.lit(1))
    number = lambda found: F.trim(F.element_at(found, -1)).try_cast("bigint")
    return df.select(
        "media_id",
        F.coalesce(F.when(F.size(line) > 0, number(line)), F.lit(1920).cast("bigint")).alias("width"),
        F.coalesce(F.when(F.size(tall) > 0, number(tall)), F.lit(1080).cast("bigint")).alias("height"),
    )


def pick_first_file(files: DataFrame, names: list[str]) -> DataFrame:
    """Per media the first existing of ``names``: files(media_id, name, ...)."""
    order = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("name"))
    known = files.filter(F.col("name").isin(names))
    whole = F.struct(*files.columns)
    best = known.groupBy("media_id").agg(F.min_by(whole, order).alias("b"))
    return best.select("b.*")


SOURCE_VERSIONS = ["segments.source.json", "segments_original.json", "segments.json"]


def pick_subtitle_source(files: DataFrame, *, force: bool = False) -> DataFrame:
    """Per media the file to sync segments from: files(media_id, kind in srt/ass/json, modified).

    SRT before ASS; the segments file itself only when forced.  Unless forced, nothing is
    picked while the segments file is as new as the subtitle file.
    """
    newest = lambda k: F.max(F.when(F.col("kind") == k, F.col("modified")))
    per_media = files.groupBy("media_id").agg(
        newest("srt").alias("srt"), newest("ass").alias("ass"), newest("json").alias("json")
    )
    kind = F.when(F.col("srt").isNotNull(), "srt").when(F.col("ass").isNotNull(), "ass")
    if force:
        kind = kind.when(F.col("json").isNotNull(), "json")
    when = F.coalesce("srt", "ass", "json") if force else F.coalesce("srt", "ass")
    picked = per_media.select("media_id", kind.alias("kind"), when.alias("modified"), "json")
    picked = picked.filter(F.col("kind").isNotNull())
    if not force:
        picked = picked.filter(F.col("json").isNull() | (F.col("json") < F.col("modified")))
    return picked.select("media_id", "kind", "modified")
