"""Writing per-media files and reports."""

from __future__ import annotations

import itertools
import os
import re
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.functions import times as tm
from cuesheet.ordering import Ordered, as_ordered
from cuesheet.session import materialise
from cuesheet.sinks.ass import export_ass
from cuesheet.sinks.subtitles import export_json, export_srt, segment_struct

BOM = "﻿"


def write_set(tables: dict[str, DataFrame], path: str, version: int | None = None) -> int:
    """Write one version of several tables (media_id, text) under ``path`` so that readers see all of it or nothing.

    Every table gets the version in a folder of its own, and a commit naming them is written last; ``read_texts`` looks at committed versions only.
    A run that breaks off leaves nothing visible, and writing the same version again replaces what it left.
    Media of other versions stay.  ``version`` is the time in microseconds unless given; it is returned.
    """
    version = time.time_ns() // 1000 if version is None else version
    for name, df in tables.items():
        df.select("media_id", "text").write.mode("overwrite").parquet(f"{path}/{name}/version={version}")
    spark = next(iter(tables.values())).sparkSession
    commit = spark.range(1).select(F.explode(F.array(*map(F.lit, tables))).alias("name"), F.lit(version).cast("bigint").alias("version"))
    commit.write.mode("overwrite").parquet(f"{path}/commits/set={'+'.join(sorted(tables))}/of={version}")
    return version


def write_texts(df: DataFrame, path: str, column: str = "text", *, bom: bool = False, version: int | None = None) -> None:
    """Write one version of the texts of some media to the table at ``path``, a set of its own (``write_set``).

    Media of earlier calls stay as they are; ``read_texts`` gives the newest version of each.  ``bom`` puts a
    byte-order mark in front.
    """
    folder, name = path.rstrip("/").rsplit("/", 1)
    write_set({name: df.select("media_id", _with_bom(F.col(column), bom).alias("text"))}, folder, version)


def _with_bom(text: Column, bom: bool) -> Column:
    return F.concat(F.lit(BOM), text) if bom else text


def committed(spark: SparkSession, path: str) -> DataFrame | None:
    """All committed rows (media_id, version, text) of the table at ``path``; None if no version was committed."""
    folder, name = path.rstrip("/").rsplit("/", 1)
    commits = _there(spark, f"{folder}/commits")
    if commits is None:
        return None
    versions = commits.filter(F.col("name") == name).select(F.col("version").cast("bigint").alias("version")).distinct()
    rows = _there(spark, path)
    return None if rows is None else rows.select("media_id", F.col("version").cast("bigint").alias("version"), "text").join(versions, "version")


def _there(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(media_id, version, text): the newest committed version of each media in a table of texts."""
    rows = committed(spark, path)
    if rows is None:
        raise FileNotFoundError(f"no committed version under {path}")
    newest = F.max_by("text", "version").alias("text")
    return rows.groupBy("media_id").agg(F.max("version").alias("version"), newest).select("media_id", "version", "text")


def export_files(df: DataFrame, path: str, column: str = "text", *, bom: bool = False) -> None:
    """Plain text files, one folder per media, for players: folders of other media stay, those of these media are replaced.

    On a mounted file system the tasks write and replace the files themselves.  Elsewhere Spark's writer does, whose driver then moves folder
    by folder; not for millions of media.
    """
    body = F.regexp_replace(column, r"\n\z", "")  # each row ends with one newline
    rows = df.select("media_id", _with_bom(body, bom).alias("value"))
    mounted = _mounted(df.sparkSession, path)
    if mounted is None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("media_id").text(path)
        return
    apart = rows.withColumn("media_id", F.col("media_id").cast("string")).repartition("media_id").sortWithinPartitions("media_id")
    apart.mapInArrow(_write_files(mounted), "media_id string").write.format("noop").mode("overwrite").save()


def _mounted(spark: SparkSession, path: str) -> str | None:
    """The folder in the file system that tasks see, of a path that names one."""
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", path)
    if scheme:
        return re.sub("^file:(//)?", "", path).rstrip("/") if scheme[1] == "file" else None
    local = (spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:").startswith("file:")
    return path.rstrip("/") if local and path.startswith("/") else None


def _write_files(path: str):
    """mapInArrow body over rows in order of media_id: ``<path>/media_id=<id>/text.txt``, named as Spark's writer names folders.

    Spark's own writer starts two processes per file there (chmod of the file and of its checksum).
    """

    def folder(media):
        named = re.sub(r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]""", lambda c: f"%{ord(c[0]):02X}", media or "")
        return f"{path}/media_id={named or '__HIVE_DEFAULT_PARTITION__'}"

    def rows(batches):
        for batch in batches:
            yield from zip(batch.column("media_id").to_pylist(), batch.column("value").to_pylist())

    def run(batches):
        for where, own in itertools.groupby(rows(batches), lambda row: folder(row[0])):
            os.makedirs(where, exist_ok=True)
            part = f"{where}/.{uuid.uuid4().hex}.tmp"
            with open(part, "wb") as f:
                for _, value in own:
                    f.write((value or "").encode() + b"\n")
            os.replace(part, f"{where}/text.txt")  # a second attempt replaces the first
            for name in os.listdir(where):
                if name != "text.txt" and not name.endswith(".tmp"):
                    os.unlink(f"{where}/{name}")
        yield from ()

    return run


def write_media_set(rows: DataFrame | Ordered, path: str, style: dict | None = None, *, show_speaker: bool = False, version: int | None = None) -> None:
    """One committed set of tables under ``path``: segments (JSON), srt and ass, and the first segments of each media under source.

    The rows are computed once.  A media that has a committed source already keeps it.
    """
    o = as_ordered(rows)
    o = o.of(materialise(o.df))
    spark = o.df.sparkSession
    json = materialise(export_json(o).withColumnRenamed("json", "text"))
    version = time.time_ns() // 1000 if version is None else version
    had = committed(spark, f"{path}/source")  # but for what an earlier try of this version left
    texts = lambda df, column: df.select("media_id", _with_bom(F.col(column), True).alias("text"))
    tables = {
        "source": json if had is None else keep_source_once(had.filter(F.col("version") != version), json), "segments": json,
        "srt": texts(export_srt(o, show_speaker=show_speaker), "srt"), "ass": texts(export_ass(o, style), "ass"),
    }
    write_set(tables, path, version)


def keep_source_once(snapshots: DataFrame, current: DataFrame) -> DataFrame:
    """Source rows to append: media that have no snapshot yet."""
    return current.join(snapshots.select("media_id").distinct(), "media_id", "left_anti")


def clip_metadata(rebased: DataFrame, clips: DataFrame, media: DataFrame) -> DataFrame:
    """Nested JSON per clip: source range, clip timeline, rebased segments.

    clips: media_id, clip_id, clip_start_ms, clip_end_ms; media: media_id, media_name.
    """
    packed = F.array_sort(F.collect_list(F.struct("idx", segment_struct().alias("s"))))
    segs = rebased.groupBy("media_id", "clip_id").agg(F.transform(packed, lambda x: x["s"]).alias("segments"))
    start, length = F.col("clip_start_ms"), F.col("clip_end_ms") - F.col("clip_start_ms")
    doc = F.struct(
        F.col("media_name").alias("source_media"),
        tm.seconds(start).alias("source_start"),
        tm.seconds(F.col("clip_end_ms")).alias("source_end"),
        tm.seconds(length).alias("duration"),
        F.lit(0.0).alias("clip_timeline_start"),
        tm.seconds(length).alias("clip_timeline_end"),
        "segments",
    )
    out = clips.join(segs, ["media_id", "clip_id"]).join(media, "media_id")
    return out.select("media_id", "clip_id", F.to_json(doc).alias("json"))
