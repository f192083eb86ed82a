"""Job records, token plans, status streams in batch form, editing and versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesheet.operators.segments import number_id
from cuesheet.ordering import POS, Ordered, arrange
from cuesheet.sources.records import INTERRUPTED, RUNNING, TERMINAL

# Fixed values of the token budget.
OUT_PER_SEC, IN_PER_SEC, STEP, LEAST, MOST, CONTEXT = 14.0, 12.5, 512, 2048, 65_536, 131_072


def recommended_tokens(duration_sec: Column, max_length: int | Column = CONTEXT) -> Column:
    """Output budget for a recording: a multiple of 512, within the context; null without a duration."""
    room = (max_length if isinstance(max_length, Column) else F.lit(max_length)).cast("bigint")
    wanted = F.greatest(F.lit(LEAST), F.floor((duration_sec * OUT_PER_SEC + (STEP - 1)) / STEP).cast("bigint") * STEP)
    ceiling = F.greatest(F.lit(LEAST), room - F.floor(duration_sec * IN_PER_SEC).cast("bigint") - STEP)
    return F.when(duration_sec > 0, F.greatest(F.lit(LEAST), F.least(wanted, ceiling, F.lit(MOST)))).cast("bigint")


def raised_tokens(current: Column, recommended: Column) -> Column:
    """A recommendation only ever raises the setting."""
    return F.greatest(current, F.coalesce(recommended, current))


def _between(ratio: Column, lo: float, hi: float) -> Column:
    return F.lit(lo) + F.lit(hi - lo) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio))


def generation_progress(generated: Column, max_new: Column) -> Column:
    return F.when(F.coalesce(max_new, F.lit(0)) <= 0, F.lit(0.25)).otherwise(_between(generated / F.nullif(max_new, F.lit(0)), 0.25, 0.85))


def duration_progress(position: Column, duration: Column) -> Column:
    return F.when(F.coalesce(duration, F.lit(0)) <= 0, F.lit(0.25)).otherwise(_between(position / F.nullif(duration, F.lit(0)), 0.10, 0.85))


def render_progress(current: Column, ratio: Column) -> Column:
    return F.greatest(current, F.lit(0.95) + F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio)) * 0.049)


def possibly_truncated(generated: Column, max_new: Column) -> Column:
    return generated.isNotNull() & (max_new > 0) & (generated >= max_new)


def audio_token_plan(
    samples: Column, *, chunk: int = 480_000, hop: int = 160, merge: int = 4, per_second: float = 12.5, every: int = 2
) -> tuple[Column, Column]:
    """(audio tokens, time-marker digits) of a recording.

    Every chunk gives one token per ``2 * hop * merge`` samples, the last one rounded up.
    A marker with the second in decimal digits follows every ``every`` seconds; the digits
    are counted per number of digits instead of being listed.
    """
    stride = hop * 2 * merge
    whole, rest = F.floor(samples / chunk).cast("bigint"), samples % chunk
    tokens = whole * ((chunk - 1) // stride + 1) + F.when(rest > 0, F.floor((rest - 1) / stride).cast("bigint") + 1).otherwise(0)
    last = F.floor(tokens / per_second).cast("bigint")
    lengths = F.sequence(F.lit(1), F.length(last.cast("string")))

    def with_digits(d: Column) -> Column:
        """Digits of all markers whose second has ``d`` digits; powers of ten up to 10**18 are exact doubles."""
        top = F.least(last, F.pow(F.lit(10.0), d).cast("bigint") - 1)
        below = F.pow(F.lit(10.0), d - 1).cast("bigint") - 1
        return (F.floor(top / every) - F.floor(below / every)).cast("bigint") * d

    marks = F.aggregate(lengths, F.lit(0).cast("bigint"), lambda sum_, d: sum_ + with_digits(d))
    return tokens, marks


def prompt_fits(tokens: Column, marks: Column, before: Column, after: Column, placeholders: Column, max_length: Column) -> Column:
    """Null if a prompt of ``before`` and ``after`` tokens around the audio can be built, else what is wrong."""
    count = F.concat(F.lit("expected one audio placeholder, got "), placeholders.cast("string"))
    return F.when(placeholders != 1, count).when(before + tokens + marks + after > max_length, "prompt and audio exceed the greatest length")


def is_running(status: Column) -> Column:
    return status.isin(*RUNNING)


def is_terminal(status: Column) -> Column:
    return status.isin(*TERMINAL)


def reload_jobs(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs that were running when the service stopped come back as failed."""
    cut = is_running(F.col("status"))
    return jobs.withColumns(
        {
            "progress": F.when(cut, 1.0).otherwise(F.col("progress")),
            "error": F.when(cut, INTERRUPTED).otherwise(F.col("error")),
            "updated_at": F.when(cut, now).otherwise(F.col("updated_at")),
            "status": F.when(cut, "failed").otherwise(F.col("status")),
        }
    )


def recent_first(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy(F.desc("updated_at"), "id")


def job_summary(jobs: DataFrame) -> DataFrame:
    """Nested inference, usage and files next to the plain fields."""
    path = lambda name: F.concat("job_dir", F.lit("/"), F.lit(name)).alias
    files = {"raw_transcript": "raw_transcript.txt", "segments": "segments.json", "srt": "subtitle.srt", "ass": "subtitle.ass", "mp4": "output.mp4", "clips": "clips"}
    return jobs.select(
        "id", "status", "media_name", "progress", "updated_at",
        F.struct(F.col("inference_prompt").alias("prompt"), "max_length", "max_new_tokens", "decoding", "temperature").alias("inference"),
        F.struct(
            F.col("prompt_len").alias("prompt_tokens"), "generated_tokens", "max_new_tokens",
            possibly_truncated(F.col("generated_tokens"), F.col("max_new_tokens")).alias("possibly_truncated"), "elapsed_sec",
        ).alias("usage"),
        F.struct(*[path(f)(n) for n, f in files.items()]).alias("files"),
    )


# ---- status events -----------------------------------------------------------


def latest_status(events: DataFrame) -> DataFrame:
    """Last event per job (job_id, event_id, at_ms, status, progress); progress within 0..1."""
    last = F.max_by(F.struct("status", "progress", "at_ms"), F.struct("at_ms", "event_id"))
    out = events.groupBy("job_id").agg(last.alias("s"))
    return out.select("job_id", "s.status", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "s.progress")).alias("progress"), "s.at_ms")


def before_cancel(events: DataFrame, cancelled: DataFrame) -> DataFrame:
    """Events up to the cancellation of their job; ``cancelled``: job_id, cancel_ms."""
    at = cancelled.groupBy("job_id").agg(F.min("cancel_ms").alias("_c"))
    return events.join(at, "job_id", "left").filter(F.col("_c").isNull() | (F.col("at_ms") < F.col("_c"))).drop("_c")


def render_ratios(events: DataFrame) -> DataFrame:
    """Never-falling render ratio per job over events (job_id, event_id, at_ms, ratio)."""
    o = arrange(events, ("job_id",), ("at_ms", "event_id"))
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("ratio")))
    return o.running({"best": ("max", clamped)}).plain()


def _throttle_step(every: int):
    def step(state, live, gap):
        waited = min(state - 1 + gap, every) if state else 0
        if not live:
            return (waited + 1 if state else 0), 1
        if not state or waited >= every:
            return 1, 1
        return waited + 1, 0

    return step


def throttle(events: DataFrame, every_ms: int = 500) -> DataFrame:
    """Events to persist: live ones at most every ``every_ms`` per job, all others."""
    o = arrange(events, ("job_id",), ("at_ms", "event_id"))
    o = o.local({"_gap": lambda w: F.col("at_ms") - F.lag("at_ms").over(w)}, before=1)
    gap = F.least(F.coalesce("_gap", F.lit(0)), F.lit(every_ms)).cast("int")
    o = o.fold("_keep", {"live": F.col("live"), "gap": gap}, _throttle_step(every_ms), states=every_ms + 2)
    return o.of(o.df.filter("_keep = 1").drop("_keep", "_gap")).plain()


def fold_deltas(lines: DataFrame) -> DataFrame:
    """Server-sent lines (stream_id, seq, line) -> text and last usage per stream."""
    data = F.trim(F.regexp_extract(F.trim("line"), "^data:(.*)$", 1))
    schema = "struct<choices:array<struct<delta:struct<content:string>>>,usage:struct<prompt_tokens:bigint,completion_tokens:bigint>>"
    rows = lines.withColumn("_d", data).filter((F.length("_d") > 0) & (F.col("_d") != "[DONE]")).withColumn("_j", F.from_json("_d", schema))
    piece = F.array_join(F.transform("_j.choices", lambda c: F.coalesce(c["delta"]["content"], F.lit(""))), "")
    last = lambda f: F.max_by(F.col(f"_j.usage.{f}"), F.when(F.col(f"_j.usage.{f}").isNotNull(), F.col("seq"))).alias(f)
    packed = F.array_sort(F.collect_list(F.struct("seq", F.coalesce(piece, F.lit("")).alias("t"))))  # the text is the result
    out = rows.groupBy("stream_id").agg(packed.alias("_p"), last("prompt_tokens"), last("completion_tokens"))
    return out.select("stream_id", F.array_join(F.transform("_p", lambda x: x["t"]), "").alias("text"), "prompt_tokens", "completion_tokens")


def token_progress(puts: DataFrame, max_new: int) -> DataFrame:
    """Running token count per stream without the first put, with its progress."""
    o = arrange(puts, ("stream_id",), ("seq",))
    o = o.running({"generated": ("sum", F.when(F.col(POS) == 0, 0).otherwise(F.col("tokens")).cast("bigint"))})
    out = o.df.filter(F.col(POS) > 0).drop(POS, "_chunk")
    return out.withColumn("progress", generation_progress(F.col("generated").cast("double"), F.lit(float(max_new))))


# ---- edits and versions ------------------------------------------------------


def _cs(c: Column) -> Column:
    """Times of edits are kept to hundredths, halves up."""
    return (F.floor((c + 5) / 10) * 10).cast("bigint")


def nudged(kind: Column, delta: Column, start: Column, end: Column, media_end: Column) -> tuple[Column, Column]:
    """shift / start / end nudges with 0.1 s at least and the media end as a limit (0 = unknown)."""
    s = F.greatest(F.lit(0), start)
    e = F.greatest(s + 100, end)
    limited = media_end > 0
    length = e - s
    moved = F.greatest(s + delta, F.lit(0))
    over = limited & (moved + length > media_end)
    shift_s = F.when(over, F.greatest(F.lit(0), media_end - length)).otherwise(moved)
    shift_e = F.when(over, media_end).otherwise(moved + length)
    start_s = F.greatest(F.lit(0), F.least(e - 100, s + delta))
    end_e = F.greatest(s + 100, e + delta)
    end_e = F.when(limited, F.least(media_end, end_e)).otherwise(end_e)
    new_s = F.when(kind == "shift", shift_s).when(kind == "start", start_s).otherwise(s)
    new_e = F.when(kind == "shift", shift_e).when(kind == "end", end_e).otherwise(e)
    return _cs(new_s), _cs(new_e)


def _beside(side: Column, media_end: Column) -> tuple[Column, Column]:
    """Range of a blank segment above or below a row, between its neighbours (2.5 s wanted, 0.25 s at least)."""
    a = F.greatest(F.lit(0), F.col("start_ms"))
    b = F.greatest(a, F.col("end_ms"))
    limited = media_end > 0
    # above
    floor = F.coalesce(F.greatest(F.lit(0), F.col("_pe")), F.lit(0))
    up_s = F.greatest(floor, a - 2500)
    tight = a - up_s < 250
    up_s2 = F.when(tight, F.greatest(F.lit(0), a - 250)).otherwise(up_s)
    up_e = F.when(tight & (a <= up_s2), up_s2 + 250).otherwise(a)
    # below
    wanted = F.when(limited, F.least(media_end, b + 2500)).otherwise(b + 2500)
    ceiling = F.coalesce("_ns", F.when(limited, media_end).otherwise(b + 2500))
    down_e = F.greatest(b + 250, F.least(ceiling, wanted))
    s = F.when(side == "above", up_s2).otherwise(b)
    e = F.when(side == "above", up_e).otherwise(down_e)
    s2 = F.when(limited, F.least(s, F.greatest(F.lit(0), media_end - 250))).otherwise(s)
    e2 = F.when(limited, F.least(F.greatest(s2 + 250, e), media_end)).otherwise(e)
    rs = _cs(s2)
    re = _cs(F.greatest(rs + 250, e2))
    return rs, F.when(limited, _cs(F.least(re, media_end))).otherwise(re)


def apply_edits(o: Ordered, edits: DataFrame, media: DataFrame | None = None) -> DataFrame:
    """An edit log over the segments of many media.

    ``edits``: media_id, edit_no, idx, op, delta_ms, text, speaker.  The latest edit of a
    row wins.  ops: delete, shift, start, end, set (text and speaker), above, below
    (insert a blank segment next to the row).  ``media``: media_id, duration_ms.
    """
    whole = F.struct("edit_no", "op", "delta_ms", F.col("text").alias("new_text"), F.col("speaker").alias("new_speaker"))
    last = edits.groupBy("media_id", "idx").agg(F.max_by(whole, "edit_no").alias("x")).select("media_id", F.col("idx").alias("_i"), "x.*")
    o = o.local({"_pe": lambda w: F.lag("end_ms").over(w), "_ns": lambda w: F.lead("start_ms").over(w)}, before=1, after=1)
    df = o.df.join(last.withColumnRenamed("_i", "idx"), ["media_id", "idx"], "left")
    if media is not None:
        df = df.join(media.select("media_id", F.col("duration_ms").alias("_end")), "media_id", "left")
    end = F.coalesce("_end", F.lit(0)) if media is not None else F.lit(0)
    op = F.coalesce("op", F.lit("keep"))
    ns, ne = nudged(op, F.coalesce("delta_ms", F.lit(0)), F.col("start_ms"), F.col("end_ms"), end)
    moves = op.isin("shift", "start", "end")
    row = F.struct(
        F.lit(1).alias("place"), F.coalesce("id", number_id(F.col("idx"))).alias("id"), F.when(moves, ns).otherwise(F.col("start_ms")).alias("start_ms"),
        F.when(moves, ne).otherwise(F.col("end_ms")).alias("end_ms"), F.when(op == "set", F.coalesce("new_speaker", "speaker")).otherwise(F.col("speaker")).alias("speaker"),
        F.when(op == "set", F.coalesce("new_text", "text")).otherwise(F.col("text")).alias("text"),
    )
    bs, be = _beside(op, end)
    speaker = F.coalesce(F.when(F.length("speaker") > 0, F.col("speaker")), F.lit("S01"))
    blank = F.struct(
        F.when(op == "above", 0).otherwise(2).alias("place"), F.concat(F.lit("seg_new_"), F.col("edit_no").cast("string")).alias("id"),
        bs.alias("start_ms"), be.alias("end_ms"), speaker.alias("speaker"), F.lit("").alias("text"),
    )
    rows = F.when(op == "delete", F.array().cast("array<struct<place:int,id:string,start_ms:bigint,end_ms:bigint,speaker:string,text:string>>"))
    rows = rows.when(op.isin("above", "below"), F.array(row, blank)).otherwise(F.array(row))
    df = df.withColumn("_at", F.col(POS)).select("media_id", "_at", F.explode(rows).alias("r")).select("media_id", "_at", "r.*")
    out = arrange(df, ("media_id",), ("_at", "place"), like=o)
    return out.df.select("media_id", (F.col(POS) + 1).alias("idx"), "id", "start_ms", "end_ms", "speaker", "text")


def insert_at(o: Ordered, inserts: DataFrame, media: DataFrame | None = None) -> DataFrame:
    """Blank segments at given times: inserts (media_id, insert_no, at_ms) -> their rows.

    A new row ends at the next start after it, at most 2.5 s and at least 0.25 s later.
    """
    marks = o.df.select("media_id", F.col("start_ms").alias("at"), F.lit(1).alias("w"), F.col(POS).alias("n"), F.col("start_ms").alias("mark"))
    at = _cs(F.greatest(F.lit(0), F.col("at_ms")))
    # Same-time starts do not count as next, so probes sort after them.
    probes = inserts.select("media_id", at.alias("at"), F.lit(2).alias("w"), F.col("insert_no").alias("n"), F.lit(None).cast("bigint").alias("mark"))
    line = arrange(marks.unionByName(probes), ("media_id",), ("at", "w", "n"), limit=o.limit)
    line = line.running({"next": ("min", F.col("mark"))}, reverse=True)
    df = line.df.filter("w = 2")
    if media is not None:
        df = df.join(media.select("media_id", F.col("duration_ms").alias("_end")), "media_id", "left")
    end = F.coalesce("_end", F.lit(0)) if media is not None else F.lit(0)
    wanted = F.when(end > 0, F.least(end, F.col("at") + 2500)).otherwise(F.col("at") + 2500)
    stop = F.greatest(F.col("at") + 250, F.least(F.coalesce("next", wanted), wanted))
    return df.select("media_id", F.col("n").alias("insert_no"), F.col("at").alias("start_ms"), _cs(stop).alias("end_ms"), F.lit("").alias("text"))


def latest_version(versions: DataFrame, *, source: bool = False) -> DataFrame:
    """Rows of one version per media: the newest, or the source snapshot (the first).

    ``versions``: media_id, version, idx, ...  Re-translation always starts from the source.
    """
    pick = versions.groupBy("media_id").agg((F.min if source else F.max)("version").alias("version"))
    return versions.join(pick, ["media_id", "version"])


def put_segments(current: DataFrame, payload: DataFrame) -> DataFrame:
    """A full replacement per media: payload rows win for the media they cover."""
    kept = current.join(payload.select("media_id").distinct(), "media_id", "left_anti")
    return kept.unionByName(payload.select(*current.columns))

