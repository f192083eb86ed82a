"""Clean-up of timed, speaker-tagged segments (media_id, idx, id, start_ms, end_ms, speaker, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesheet.functions import text as tx
from cuesheet.ordering import POS, Ordered, arrange, as_ordered

MIN_MS = 1000
MAX_MS = 6000
MAX_CHARS = 24
MERGE_GAP_MS = 300
BY_TIME = ("start_ms", "end_ms", "idx")
COLUMNS = ("media_id", "idx", "id", "start_ms", "end_ms", "speaker", "text")


def number_id(n: Column, prefix: str = "seg_", width: int = 4) -> Column:
    plain = F.concat(F.lit(prefix), F.lpad(n.cast("string"), width, "0"))  # a formatter per row costs ten times as much
    return F.when(n.between(0, 10**width - 1), plain).otherwise(F.format_string(f"{prefix}%0{width}d", n))


def _filled(c: str, other: Column) -> Column:
    return F.coalesce(F.when(F.length(F.col(c)) > 0, F.col(c)), other)


def coerce_segments(df: DataFrame) -> DataFrame:
    """Fill missing id, speaker and text; times and order stay as given."""
    id_now = F.col("id") if "id" in df.columns else F.lit(None).cast("string")
    return df.withColumn("id", id_now).select(
        "media_id",
        "idx",
        _filled("id", number_id(F.col("idx"))).alias("id"),
        "start_ms",
        "end_ms",
        _filled("speaker", F.lit(tx.DEFAULT_SPEAKER)).alias("speaker"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def cleaned_rows(df: DataFrame) -> DataFrame:
    """Stripped text, no blank rows, ``0 <= start <= end``.  Row-local."""
    start = F.greatest(F.col("start_ms"), F.lit(0))
    return (
        coerce_segments(df)
        .withColumn("text", tx.strip(F.col("text")))
        .filter(F.length("text") > 0)
        .withColumn("start_ms", start.cast("bigint"))
        .withColumn("end_ms", F.greatest("start_ms", "end_ms"))
    )


def prepare(df: DataFrame | Ordered) -> Ordered:
    """Clean rows and put every media in (start, end, source position) order."""
    like = df if isinstance(df, Ordered) else None
    rows = df.plain() if isinstance(df, Ordered) else df
    return arrange(cleaned_rows(rows), order=BY_TIME, like=like)


def prepare_for_clips(df: DataFrame | Ordered) -> Ordered:
    """As ``prepare``, but rows without duration go and times are not repaired."""
    like = df if isinstance(df, Ordered) else None
    rows = df.plain() if isinstance(df, Ordered) else df
    rows = (
        coerce_segments(rows)
        .withColumn("text", tx.strip(F.col("text")))
        .filter((F.length("text") > 0) & (F.col("end_ms") > F.col("start_ms")))
    )
    return arrange(rows, order=BY_TIME, like=like)


def renumber(o: Ordered, *, ids: bool = True) -> Ordered:
    """``idx`` (and optionally ``id``) from the current position, 1-based."""
    o = o.with_columns({"idx": F.col(POS) + 1})
    return o.with_columns({"id": number_id(F.col("idx"))}) if ids else o


def fix_overlaps(o: Ordered, min_ms: int = MIN_MS) -> Ordered:
    """Push each start past the previous end and give every row ``min_ms``.

    The cursor sweep has a closed form: with n the 1-based position,
    end(n) = n*d + max over j<=n of (max(e, s+d) - j*d).
    """
    n = F.col(POS) + 1
    lift = F.greatest(F.col("end_ms"), F.col("start_ms") + min_ms) - n * min_ms
    o = o.running({"_lift": ("max", lift)})
    o = o.with_columns({"_end": F.col("_lift") + n * min_ms})
    o = o.local({"_before": lambda w: F.lag("_end").over(w)}, before=1)
    start = F.greatest(F.col("start_ms"), F.coalesce(F.col("_before"), F.lit(0)))
    return o.of(o.df.withColumn("start_ms", start).withColumn("end_ms", F.col("_end")).drop("_lift", "_end", "_before"))


def _merge_step(budget: int):
    def step(length, joins, gap, chars):
        if length and joins and length + gap + chars <= budget:
            return length + gap + chars, 0
        return min(chars, budget + 1), 1

    return step


def merge_adjacent(o: Ordered, merge_gap_ms: int = MERGE_GAP_MS, max_chars: int = MAX_CHARS) -> Ordered:
    """Greedily join neighbours of one speaker while the joined text stays within twice ``max_chars``."""
    budget = 2 * max_chars
    gap = F.col("start_ms") - F.col("_end_before")
    o = o.local(
        {
            "_end_before": lambda w: F.lag("end_ms").over(w),
            "_speaker_before": lambda w: F.lag("speaker").over(w),
            "_tail": lambda w: tx.last_char(F.lag("text").over(w)),
        },
        before=1,
    )
    o = o.with_columns(
        {
            "_joins": F.coalesce((F.col("_speaker_before") == F.col("speaker")) & gap.between(0, merge_gap_ms), F.lit(False)),
            "_sep": F.coalesce(tx.separator(F.col("_tail"), F.col("text")), F.lit("")),
        }
    )
    o = o.of(o.df.drop("_end_before", "_speaker_before", "_tail"))
    o = o.fold(
        "_opens",
        {"joins": F.col("_joins"), "gap": F.length("_sep"), "chars": F.least(F.length("text"), F.lit(budget + 1))},
        _merge_step(budget),
        states=budget + 2,
    )
    o = o.running({"_unit": ("sum", F.col("_opens").cast("bigint"))})
    # At most ``budget`` rows share a unit: every joined row adds at least one character.
    piece = F.struct(F.col(POS).alias("p"), F.col("_sep").alias("s"), F.col("text").alias("t"))
    pieces = F.array_sort(F.collect_list(piece))
    merged = o.df.groupBy(*o.keys, "_unit").agg(
        F.min_by("idx", POS).alias("idx"),
        F.min_by("id", POS).alias("id"),
        F.min_by("start_ms", POS).alias("start_ms"),
        F.max("end_ms").alias("end_ms"),
        F.min_by("speaker", POS).alias("speaker"),
        pieces.alias("_pieces"),
    )
    glued = F.array_join(F.transform("_pieces", lambda x: F.concat(F.when(x["p"] == F.col("_pieces")[0]["p"], "").otherwise(x["s"]), x["t"])), "")
    merged = merged.withColumn("text", glued).drop("_pieces")
    return arrange(merged, o.keys, ("_unit",), like=o)


def drop_unit(o: Ordered) -> Ordered:
    return o.of(o.df.drop("_unit"))


def split_long(o: Ordered, min_ms: int = MIN_MS, max_ms: int = MAX_MS, max_chars: int = MAX_CHARS) -> Ordered:
    """Split long rows; time goes to the pieces by length, with ``min_ms`` floors."""
    duration = F.col("end_ms") - F.col("start_ms")
    fits = (duration <= max_ms) & (F.length("text") <= max_chars)
    df = o.df.withColumn("_chunks", F.when(fits, F.array("text")).otherwise(tx.split_long_text(F.col("text"), max_chars)))
    many = F.size("_chunks") > 1
    total = F.aggregate("_chunks", F.lit(0), lambda a, c: a + F.length(c))
    count = F.size("_chunks")
    floor = F.lit(float(min_ms))

    def place(acc: Column, chunk: Column) -> Column:
        k = F.size(acc["spans"]) + 1
        share = acc["cursor"] + F.greatest(floor, duration.cast("double") * (F.length(chunk).cast("double") / total.cast("double")))
        capped = F.least(share, F.col("end_ms").cast("double") - floor * (count - k).cast("double"))
        end = F.greatest(F.when(k == count, F.col("end_ms").cast("double")).otherwise(capped), acc["cursor"] + floor)
        span = F.struct(acc["cursor"].alias("s"), end.alias("e"), chunk.alias("t"))
        return F.struct(end.alias("cursor"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    start = F.struct(
        F.col("start_ms").cast("double").alias("cursor"),
        F.array().cast("array<struct<s:double,e:double,t:string>>").alias("spans"),
    )
    whole = F.array(
        F.struct(F.col("start_ms").cast("double").alias("s"), F.col("end_ms").cast("double").alias("e"), F.col("text").alias("t"))
    )
    spans = F.when(many, F.aggregate("_chunks", start, place, lambda acc: acc["spans"])).otherwise(whole)
    df = df.withColumn("_many", many).select("*", F.posexplode(spans).alias("_part", "_span")).drop("_chunks")
    df = (
        df.withColumn("id", F.when(F.col("_many"), F.concat("id", F.lit("_"), F.col("_part") + 1)).otherwise(F.col("id")))
        .withColumn("start_ms", F.floor(F.col("_span.s") + 0.5).cast("bigint"))
        .withColumn("end_ms", F.floor(F.col("_span.e") + 0.5).cast("bigint"))
        .withColumn("text", F.col("_span.t"))
        .withColumn("_row", F.col(POS))
        .drop("_many", "_span")
    )
    out = arrange(df, o.keys, ("_row", "_part"), like=o)
    return out.of(out.df.drop("_row", "_part"))


def normalize(
    df: DataFrame | Ordered,
    *,
    min_ms: int = MIN_MS,
    max_ms: int = MAX_MS,
    max_chars: int = MAX_CHARS,
    merge_gap_ms: int = MERGE_GAP_MS,
    regenerate_ids: bool = True,
) -> Ordered:
    """prepare, fix overlaps, merge, split, fix overlaps again, number."""
    o = fix_overlaps(prepare(df), min_ms)
    o = drop_unit(merge_adjacent(o, merge_gap_ms, max_chars))
    o = fix_overlaps(split_long(o, min_ms, max_ms, max_chars), min_ms)
    return renumber(o, ids=regenerate_ids)


def mark_repeated_phrases(o: Ordered, max_run: int = 3, max_total: int = 24) -> Ordered:
    """Flag ``repeated`` on short phrases past ``max_run`` in a row or ``max_total`` overall.

    Blank rows never reach the guard; a text that is no short phrase resets the run.
    """
    o = o.with_columns({"_p": tx.normal_phrase(F.col("text")), "_seen": F.length(tx.strip(F.col("text"))) > 0})
    o = o.with_columns({"_p": F.when(F.col("_seen"), F.when(tx.is_short_phrase(F.col("_p")), F.col("_p")).otherwise(F.lit("")))})
    # Blank rows carry null, so the last non-null phrase before a row skips them.
    o = o.running({"_upto": ("last", F.col("_p"))})
    o = o.local({"_last": lambda w: F.lag("_upto").over(w)}, before=1)
    breaks = F.col("_seen") & ((F.col("_p") == "") | (F.coalesce(F.col("_last"), F.lit("")) != F.col("_p")))
    o = o.running({"_run": ("sum", breaks.cast("bigint")), "_n": ("sum", F.col("_seen").cast("bigint"))})
    o = o.running({"_run_from": ("last", F.when(breaks, F.col("_n")))})
    run = F.col("_n") - F.col("_run_from") + 1
    # Occurrence number of a phrase: counted per (media, phrase) on the candidate rows alone.
    # Each phrase is a group of its own, so a media-wide repeated phrase is chunked as well.
    short = F.col("_seen") & (F.col("_p") != "")
    rows = o.df.withColumn("_over_run", short & (run > max_run))
    phrases = o.of(rows.filter(short).select(*o.keys, F.col(POS).alias("_at"), "_p"))
    nth = arrange(phrases.df, (*o.keys, "_p"), ("_at",), like=o)
    late = nth.df.filter(F.col(POS) >= max_total).select(*o.keys, F.col("_at").alias(POS), F.lit(True).alias("_late"))
    rows = rows.join(late, [*o.keys, POS], "left")
    rows = rows.withColumn("repeated", F.col("_over_run") | F.coalesce("_late", F.lit(False)))
    return o.of(rows.drop("_p", "_seen", "_upto", "_last", "_run", "_n", "_run_from", "_over_run", "_late"))


def drop_repeated_phrases(df: DataFrame | Ordered, max_run: int = 3, max_total: int = 24) -> DataFrame:
    o = mark_repeated_phrases(as_ordered(df), max_run, max_total)
    kept = o.df.filter(~F.col("repeated") & (F.length(tx.strip(F.col("text"))) > 0))
    return kept.drop("repeated", POS, "_chunk")


def choose_transcript(versions: DataFrame) -> DataFrame:
    """Keep the longer of two transcripts where the first looks sparse.

    ``versions``: media_id, version (1 = first, 2 = second try), text, segment_count, duration_ms.
    Sparse: fewer than 40 characters, at most 2 segments, at least 12 s of media.
    """
    length = F.length(tx.strip(F.col("text")))
    first, second = F.col("version") == 1, F.col("version") == 2
    per_media = versions.groupBy("media_id").agg(
        F.max(F.when(first, length)).alias("_len1"),
        F.max(F.when(second, length)).alias("_len2"),
        F.max(F.when(first, F.col("segment_count"))).alias("_count1"),
        F.max("duration_ms").alias("_duration"),
        F.max_by(F.when(first, F.col("text")), F.when(first, 1)).alias("_text1"),
        F.max_by(F.when(second, F.col("text")), F.when(second, 1)).alias("_text2"),
    )
    sparse = (F.col("_len1") < 40) & (F.col("_count1") <= 2) & (F.col("_duration") >= 12_000)
    swap = sparse & (F.coalesce("_len2", F.lit(-1)) > F.col("_len1"))
    return per_media.select(
        "media_id",
        sparse.alias("sparse"),
        F.when(swap, 2).otherwise(1).cast("bigint").alias("version"),
        F.when(swap, F.col("_text2")).otherwise(F.col("_text1")).alias("text"),
    )
