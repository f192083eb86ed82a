"""Compact transcripts ``[start][Sxx]text[end]...`` -> segments, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.functions import text as tx
from cuesheet.functions import times as tm

# Pieces of a transcript; together they give the text back without loss.
PIECE = r"\[[0-9.]{1,32}\]|\[S[0-9]{1,15}\]|\[|[^\[]+"
_STAMP = r"^\[([0-9]+\.?[0-9]*|\.[0-9]+)\]$"
_SEEK, _SPEAKER_NEXT, _TEXT, _ENDED = 0, 1, 2, 3
_WORDS, _BLANK, _OPEN, _TIME, _BAD_TIME, _SPEAKER = range(6)


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """One document per media: (media_id = file path, text).

    Of many folders give the one above them all: tasks then list them, where a pattern is matched by the driver, folder by folder.
    """
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("media_id"), F.col("value").alias("text"))


def _pieces(text: Column) -> Column:
    def describe(p: Column) -> Column:
        kind = (
            F.when(p == "[", _OPEN)
            .when(p.startswith("[S"), _SPEAKER)
            .when(p.startswith("["), F.when(p.rlike(_STAMP), _TIME).otherwise(_BAD_TIME))
            .when(p.rlike(rf"^{tx.WS}+\z"), _BLANK)
            .otherwise(_WORDS)
        )
        return F.struct(
            kind.alias("kind"),
            F.length(p).alias("n"),
            F.when(kind == _TIME, F.regexp_extract(p, _STAMP, 1).try_cast("double")).alias("sec"),
            F.when(kind == _SPEAKER, F.substring(p, F.lit(2), F.length(p) - 2)).alias("tag"),
            p.rlike(r"^[0-9.]+\z").alias("digits"),
        )

    return F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), describe)


_STATE = (
    "struct<mode:int,open:int,at:int,start:double,end:double,speaker:string,from:int,to:int,"
    "found:array<struct<start:double,end:double,speaker:string,from:int,to:int>>>"
)


def _advance(a: Column, p: Column) -> Column:
    """One piece.  ``open`` is the length of digits after a lone '[' in the text, else -1:
    while such a bracket is open the next '[' is plain text."""
    mode, kind = a["mode"], p["kind"]
    is_time = kind == _TIME
    inside = a["open"] >= 0
    ends = (mode == _TEXT) & ~inside & is_time & (p["sec"] >= a["start"])
    emits = (mode == _ENDED) & kind.isin(_OPEN, _TIME, _BAD_TIME, _SPEAKER)
    opens = mode.isin(_SEEK, _ENDED) & is_time
    speaks = (mode == _SPEAKER_NEXT) & (kind == _SPEAKER)
    still_digits = (mode == _TEXT) & inside & kind.isin(_WORDS, _BLANK) & p["digits"] & (a["open"] + p["n"] <= 32)
    next_mode = (
        F.when(opens, _SPEAKER_NEXT)
        .when(speaks | (mode == _TEXT) & ~ends, _TEXT)
        .when(ends, _ENDED)
        .when((mode == _SPEAKER_NEXT) & (kind == _BLANK), _SPEAKER_NEXT)
        .when((mode == _ENDED) & (kind == _BLANK), _ENDED)
        .when((mode == _ENDED) & (kind == _WORDS), _TEXT)
        .otherwise(_SEEK)
    )
    segment = F.struct(a["start"], a["end"], a["speaker"], a["from"], a["to"])
    return F.struct(
        next_mode.alias("mode"),
        F.when(still_digits, a["open"] + p["n"])
        .when((mode == _TEXT) & ~inside & (kind == _OPEN), F.lit(0))
        .otherwise(F.lit(-1))
        .alias("open"),
        (a["at"] + p["n"]).alias("at"),
        F.when(opens, p["sec"]).otherwise(a["start"]).alias("start"),
        F.when(ends, p["sec"]).otherwise(a["end"]).alias("end"),
        F.when(speaks, p["tag"]).otherwise(a["speaker"]).alias("speaker"),
        F.when(speaks, a["at"] + p["n"]).otherwise(a["from"]).alias("from"),
        F.when(ends, a["at"]).otherwise(a["to"]).alias("to"),
        F.when(emits, F.concat(a["found"], F.array(segment))).otherwise(a["found"]).alias("found"),
    ).cast(_STATE)


def parse_transcripts(df: DataFrame, *, strip_text: bool = True, skip_empty: bool = True) -> DataFrame:
    """(media_id, text) -> (media_id, idx, start_ms, end_ms, speaker, text).

    The fold keeps offsets only; the text of a segment is one slice of the document.
    An end stamp counts when it is not before the start and only blanks stand between it
    and the next '[' or the end.
    """
    begin = F.expr(
        f"cast(struct({_SEEK}, -1, 1, null, null, null, 0, 0, array()) as {_STATE})"
    )

    def close(a: Column) -> Column:
        last = F.array(F.struct(a["start"], a["end"], a["speaker"], a["from"], a["to"]))
        return F.when(a["mode"] == _ENDED, F.concat(a["found"], last)).otherwise(a["found"])

    found = F.aggregate(_pieces(F.col("text")), begin, _advance, close)

    def cut(s: Column) -> Column:
        raw = F.substring(F.col("text"), s["from"], s["to"] - s["from"])
        return F.struct(
            tm.millis(s["start"]).alias("start_ms"),
            tm.millis(s["end"]).alias("end_ms"),
            s["speaker"].alias("speaker"),
            (tx.strip(raw) if strip_text else raw).alias("text"),
        )

    segments = F.transform(found, cut)
    if skip_empty:
        segments = F.filter(segments, lambda s: F.length(s["text"]) > 0)
    return df.select("media_id", F.posexplode(segments).alias("pos", "s")).select(
        "media_id", (F.col("pos") + 1).cast("bigint").alias("idx"), "s.start_ms", "s.end_ms", "s.speaker", "s.text"
    )
