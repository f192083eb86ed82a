"""Queries over jobs, token plans, edits, versions and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cuesheet.functions import times as tm
from cuesheet.operators import jobs as jb
from cuesheet.operators import segments as sg
from cuesheet.ordering import arrange
from cuesheet.plans import derived
from cuesheet.queries.cleanup import _LOOP, query as cleanup_query
from cuesheet.queries.registry import Registry
from cuesheet.queries.sources import _job_texts, _transcripts, query as source_query
from cuesheet.queries.sql import SEG, pad
from cuesheet.session import shared_dir
from cuesheet.sources import records as rec
from cuesheet.streaming import jobs as st

query = Registry()


@query("recommended_tokens", """
SELECT event_id, CASE WHEN d > 0 THEN greatest(2048, least(greatest(2048, CAST(floor((d * 14.0::DOUBLE + 511) / 512) AS BIGINT) * 512), greatest(2048, 131072 - CAST(floor(d * 12.5::DOUBLE) AS BIGINT) - 512), 65536)) END AS tokens,
       greatest(4096, coalesce(CASE WHEN d > 0 THEN greatest(2048, least(greatest(2048, CAST(floor((d * 14.0::DOUBLE + 511) / 512) AS BIGINT) * 512), greatest(2048, 131072 - CAST(floor(d * 12.5::DOUBLE) AS BIGINT) - 512), 65536)) END, 4096)) AS setting
FROM (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 10 = 1 THEN -5.0::DOUBLE ELSE value * 90 END AS d FROM events)""")
def recommended_tokens(spark, sf_dir):
    d = F.expr("case when event_id % 10 = 0 then null when event_id % 10 = 1 then -5.0D else value * 90 end")
    tokens = jb.recommended_tokens(d)
    return derived.table(spark, sf_dir, "events").select("event_id", tokens.alias("tokens"), jb.raised_tokens(F.lit(4096).cast("bigint"), tokens).alias("setting"))


@query("progress_mapping", """
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 0.25::DOUBLE ELSE 0.25::DOUBLE + (0.85::DOUBLE - 0.25::DOUBLE) * least(1.0::DOUBLE, value / (50 + event_id % 7)) END AS generation,
       0.10::DOUBLE + (0.85::DOUBLE - 0.10::DOUBLE) * least(1.0::DOUBLE, value / 120.0::DOUBLE) AS duration, greatest(0.96::DOUBLE, 0.95::DOUBLE + least(1.0::DOUBLE, value / 100) * 0.049::DOUBLE) AS render,
       event_id % 9 <> 0 AND event_id % 5 > 0 AND event_id % 4 >= event_id % 5 AS truncated FROM events""")
def progress_mapping(spark, sf_dir):
    e = derived.table(spark, sf_dir, "events")
    most = F.expr("if(event_id % 7 = 0, 0, 50 + event_id % 7)").cast("double")
    return e.select(
        "event_id", jb.generation_progress(F.col("value"), most).alias("generation"), jb.duration_progress(F.col("value"), F.lit(120.0)).alias("duration"),
        jb.render_progress(F.lit(0.96), F.col("value") / 100).alias("render"),
        jb.possibly_truncated(F.expr("if(event_id % 9 = 0, null, event_id % 4)"), F.expr("event_id % 5")).alias("truncated"),
    )


@query("audio_token_plan", """
SELECT event_id, tokens, CAST(coalesce((SELECT sum(length((2 * g)::VARCHAR)) FROM range(1, CAST(floor(tokens / 12.5::DOUBLE) AS BIGINT) // 2 + 1) r(g)), 0) AS BIGINT) AS marks FROM (
 SELECT event_id, CAST((SELECT sum((least(480000, n - 480000 * g) - 1) // 1280 + 1) FROM range(0, (n + 479999) // 480000) r(g)) AS BIGINT) AS tokens
 FROM (SELECT event_id, 1 + (event_id * 7919) % 30000000 AS n FROM events))""")
def audio_token_plan(spark, sf_dir):
    tokens, marks = jb.audio_token_plan(F.expr("1 + (event_id * 7919) % 30000000"))
    return derived.table(spark, sf_dir, "events").select("event_id", tokens.alias("tokens"), marks.alias("marks"))


_JOBS = source_query.oracles["parse_jobs"]


@query("reload_jobs", f"""
SELECT id, CASE WHEN run THEN 'failed' ELSE status END AS status, CASE WHEN run THEN 1.0::DOUBLE ELSE progress END AS progress, CASE WHEN run THEN '{rec.INTERRUPTED}' END AS error,
       CASE WHEN run THEN 5.0::DOUBLE ELSE updated_at END AS updated_at, NOT run AND status IN ('waiting_review', 'done', 'failed', 'cancelled') AS terminal FROM (SELECT *, status IN ('queued', 'transcribing') AS run FROM ({_JOBS}))""")
def reload_jobs(spark, sf_dir):
    jobs = rec.parse_jobs(_job_texts(spark, sf_dir))
    before = jobs.withColumn("terminal", jb.is_terminal(F.col("status")))
    return jb.reload_jobs(before, F.lit(5.0)).select("id", "status", "progress", "error", "updated_at", "terminal")


@query("job_summary", f"""
SELECT id, inference_prompt AS prompt, max_length, max_new_tokens, decoding, generated_tokens, max_new_tokens > 0 AND generated_tokens >= max_new_tokens AS possibly_truncated, '/subtitle.srt' AS srt FROM ({_JOBS})""")
def job_summary(spark, sf_dir):
    s = jb.job_summary(rec.parse_jobs(_job_texts(spark, sf_dir)))
    return s.select("id", "inference.prompt", "inference.max_length", "inference.max_new_tokens", "inference.decoding", "usage.generated_tokens", "usage.possibly_truncated", "files.srt")


@query("recent_jobs", f"SELECT id, status, updated_at FROM ({_JOBS}) ORDER BY updated_at DESC, id")
def recent_jobs(spark, sf_dir):
    return jb.recent_first(rec.parse_jobs(_job_texts(spark, sf_dir))).select("id", "status", "updated_at")


_STATUS = "case event_type when 'signup' then 'queued' when 'view' then 'transcribing' when 'click' then 'rendering' when 'error' then 'failed' else 'done' end"
_EV = f""" ev AS (SELECT user_id AS job_id, event_id, epoch_us(ts) // 1000 AS at_ms, {_STATUS} AS status, value / 100 AS progress FROM events)"""


def _events(spark, sf_dir):
    e = derived.table(spark, sf_dir, "events")
    return e.selectExpr("user_id job_id", "event_id", "unix_millis(cast(ts as timestamp)) at_ms", f"{_STATUS} status", "value / 100 progress")


_LATEST = "SELECT job_id, arg_max(status, (at_ms, event_id)) AS status, greatest(0.0::DOUBLE, least(1.0::DOUBLE, arg_max(progress, (at_ms, event_id)))) AS progress, max(at_ms) AS at_ms FROM ev GROUP BY job_id"


@query("latest_status", "WITH" + _EV + _LATEST)
def latest_status(spark, sf_dir):
    return jb.latest_status(_events(spark, sf_dir))


@query("before_cancel", "WITH" + _EV + """, c AS (SELECT job_id, min(at_ms) AS c FROM ev WHERE status = 'failed' AND job_id % 2 = 0 GROUP BY job_id)
SELECT ev.* FROM ev LEFT JOIN c USING (job_id) WHERE c IS NULL OR at_ms < c""")
def before_cancel(spark, sf_dir):
    ev = _events(spark, sf_dir)
    return jb.before_cancel(ev, ev.filter("status = 'failed' and job_id % 2 = 0").select("job_id", F.col("at_ms").alias("cancel_ms")))


@query("render_ratios", "WITH" + _EV + """SELECT job_id, event_id, max(greatest(0.0::DOUBLE, least(1.0::DOUBLE, progress))) OVER (PARTITION BY job_id ORDER BY at_ms, event_id) AS best FROM ev WHERE status = 'rendering'""")
def render_ratios(spark, sf_dir):
    ev = _events(spark, sf_dir).filter("status = 'rendering'").withColumnRenamed("progress", "ratio")
    return jb.render_ratios(ev).select("job_id", "event_id", "best")


# Twenty jobs get the events of all users, a tenth of the real distances apart, so that throttling bites.
_DENSE = f"""WITH RECURSIVE{_EV}, dn AS (SELECT job_id % 20 AS job_id, event_id, at_ms // 1000 AS at_ms, status, status = 'transcribing' OR status = 'rendering' AS live FROM ev),
 nn AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY at_ms, event_id) AS pos FROM dn),
 th AS (SELECT job_id, event_id, at_ms, status, pos, true AS keep, CASE WHEN live THEN at_ms END AS saved FROM nn WHERE pos = 1
        UNION ALL SELECT n.job_id, n.event_id, n.at_ms, n.status, n.pos, NOT n.live OR t.saved IS NULL OR n.at_ms - t.saved >= 500,
                         CASE WHEN n.live AND (t.saved IS NULL OR n.at_ms - t.saved >= 500) THEN n.at_ms ELSE t.saved END
        FROM th t JOIN nn n ON n.job_id = t.job_id AND n.pos = t.pos + 1)"""


def _dense(spark, sf_dir):
    return _events(spark, sf_dir).selectExpr("job_id % 20 job_id", "event_id", "at_ms div 1000 at_ms", "status", "progress", "status in ('transcribing', 'rendering') live")


@query("throttle_events", _DENSE + "SELECT job_id, event_id, at_ms, status FROM th WHERE keep")
def throttle_events(spark, sf_dir):
    return jb.throttle(_dense(spark, sf_dir)).select("job_id", "event_id", "at_ms", "status")


_SSE = """WITH q AS (SELECT conv_id, turn, text, unnest(range(0, (length(text) + 16) // 17)) AS n FROM conversations),
 lines AS (SELECT conv_id AS stream_id, turn * 100000 + n AS seq, substring(text, n * 17 + 1, 17) AS piece FROM q)
SELECT stream_id, string_agg(piece, '' ORDER BY seq) AS text, arg_max(7 + seq, seq) AS prompt_tokens, arg_max(seq, seq) FILTER (seq % 3 = 0) AS completion_tokens FROM lines GROUP BY stream_id"""


def _sse(spark, sf_dir):
    turns = derived.table(spark, sf_dir, "conversations")
    cut = turns.select(F.col("conv_id").alias("stream_id"), "turn", F.posexplode(F.regexp_extract_all("text", F.lit("(?s).{1,17}"), F.lit(0))).alias("n", "piece"))
    data = F.expr(
        "to_json(struct(array(struct(struct(piece as content) as delta)) as choices, struct(7 + turn * 100000 + n as prompt_tokens, if((turn * 100000 + n) % 3 = 0, turn * 100000 + n, null) as completion_tokens) as usage))"
    )
    rows = cut.select("stream_id", F.expr("turn * 100000 + n").alias("seq"), F.concat(F.lit("data: "), data).alias("line"))
    noise = turns.selectExpr("conv_id stream_id", "turn * 100000 + 99990 seq", "explode(array(': ping', 'data: [DONE]', 'data:')) line")
    return rows, noise


@query("fold_deltas", _SSE)
def fold_deltas(spark, sf_dir):
    rows, noise = _sse(spark, sf_dir)
    return jb.fold_deltas(rows.unionByName(noise))


@query("token_progress", """
SELECT conv_id AS stream_id, turn AS seq, generated, 0.25::DOUBLE + (0.85::DOUBLE - 0.25::DOUBLE) * least(1.0::DOUBLE, generated::DOUBLE / 800.0::DOUBLE) AS progress FROM (
 SELECT conv_id, turn, CAST(sum(CASE WHEN r = 1 THEN 0 ELSE length(text) END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS generated, r FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations)) WHERE r > 1""")
def token_progress(spark, sf_dir):
    puts = derived.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("seq"), F.length("text").alias("tokens"))
    return jb.token_progress(puts, 800).select("stream_id", "seq", "generated", "progress")


# ---- edits and versions ------------------------------------------------------

_OPS = "CASE WHEN idx % 31 = 0 THEN 'delete' WHEN idx % 13 = 0 THEN 'shift' WHEN idx % 11 = 0 THEN 'start' WHEN idx % 7 = 0 THEN 'end' WHEN idx % 37 = 0 THEN 'below' WHEN idx % 17 = 0 THEN 'above' WHEN idx % 5 = 0 THEN 'set' END"
_DELTA = "CASE WHEN idx % 2 = 0 THEN 120 ELSE -7000 END"


@query("apply_edits", SEG + f""",
 md AS (SELECT media_id, max(end_ms) - 400 AS d FROM seg GROUP BY media_id),
 e0 AS (SELECT s.*, d, {_OPS} AS op, {_DELTA} AS delta, lag(end_ms) OVER w AS pe, lead(start_ms) OVER w AS ns, greatest(end_ms, start_ms + 100) AS e FROM seg s JOIN md USING (media_id) WINDOW w AS (PARTITION BY media_id ORDER BY idx)),
 e1 AS (SELECT *, e - start_ms AS len, greatest(start_ms + delta, 0) AS mv FROM e0),
 mvd AS (SELECT media_id, idx, 1 AS place, {pad('idx', 4, 'seg_')} AS id,
    CASE op WHEN 'shift' THEN (CASE WHEN mv + len > d THEN greatest(0, d - len) ELSE mv END + 5) // 10 * 10 WHEN 'start' THEN (greatest(0, least(e - 100, start_ms + delta)) + 5) // 10 * 10 WHEN 'end' THEN (start_ms + 5) // 10 * 10 ELSE start_ms END AS start_ms,
    CASE op WHEN 'shift' THEN (CASE WHEN mv + len > d THEN d ELSE mv + len END + 5) // 10 * 10 WHEN 'start' THEN (e + 5) // 10 * 10 WHEN 'end' THEN (least(d, greatest(start_ms + 100, e + delta)) + 5) // 10 * 10 ELSE end_ms END AS end_ms,
    CASE WHEN op = 'set' THEN 'S09' ELSE speaker END AS speaker, CASE WHEN op = 'set' THEN 'edited' ELSE text END AS text FROM e1 WHERE op IS NULL OR op <> 'delete'),
 ab0 AS (SELECT *, greatest(coalesce(greatest(0, pe), 0), start_ms - 2500) AS s0 FROM e1 WHERE op = 'above'),
 ab AS (SELECT *, CASE WHEN start_ms - s0 < 250 THEN greatest(0, start_ms - 250) ELSE s0 END AS s1 FROM ab0),
 nw AS (SELECT media_id, idx, 0 AS place, s1 AS s, CASE WHEN start_ms - s0 < 250 AND start_ms <= s1 THEN s1 + 250 ELSE start_ms END AS t, d, speaker FROM ab
        UNION ALL SELECT media_id, idx, 2, end_ms, greatest(end_ms + 250, least(coalesce(ns, d), least(d, end_ms + 2500))), d, speaker FROM e1 WHERE op = 'below'),
 nw2 AS (SELECT *, (least(s, greatest(0, d - 250)) + 5) // 10 * 10 AS rs, least(greatest(least(s, greatest(0, d - 250)) + 250, t), d) AS t2 FROM nw),
 al AS (SELECT * FROM mvd UNION ALL SELECT media_id, idx, place, 'seg_new_' || (1000 + idx), rs, (least((greatest(rs + 250, t2) + 5) // 10 * 10, d) + 5) // 10 * 10, speaker, '' FROM nw2)
SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY idx, place) AS idx, id, start_ms, end_ms, speaker, text FROM al""")
def apply_edits(spark, sf_dir):
    o = derived.conversation_segments(spark, sf_dir).with_columns({"id": sg.number_id(F.col("idx"))})
    media = o.df.groupBy("media_id").agg((F.max("end_ms") - 400).alias("duration_ms"))
    old = o.df.selectExpr("media_id", "idx edit_no", "idx", "'delete' op", "0 delta_ms", "'x' text", "'y' speaker")  # overtaken by the later log
    new = o.df.selectExpr("media_id", "1000 + idx edit_no", "idx", f"coalesce({_OPS}, 'keep') op", f"{_DELTA} delta_ms", "'edited' text", "'S09' speaker")
    return jb.apply_edits(o, old.unionByName(new), media)


@query("insert_at", SEG + """,
 ins AS (SELECT media_id, idx AS insert_no, (end_ms + 37 + 5) // 10 * 10 AS s FROM seg WHERE idx % 6 = 0),
 nx AS (SELECT i.media_id, insert_no, s, min(start_ms) AS n FROM ins i LEFT JOIN seg g ON g.media_id = i.media_id AND g.start_ms > i.s GROUP BY ALL)
SELECT media_id, insert_no, s AS start_ms, (greatest(s + 250, least(coalesce(n, s + 2500), s + 2500)) + 5) // 10 * 10 AS end_ms, '' AS text FROM nx""")
def insert_at(spark, sf_dir):
    o = derived.conversation_segments(spark, sf_dir)
    return jb.insert_at(o, o.df.filter("idx % 6 = 0").selectExpr("media_id", "idx insert_no", "end_ms + 37 at_ms"))


def _versions(spark, sf_dir):
    o = derived.conversation_segments(spark, sf_dir)
    v = F.explode(F.expr("if(media_id % 3 = 0, array(1, 2, 3), array(1))")).alias("version")
    return o.df.select("media_id", v, "idx", "text").withColumn("text", F.concat("text", F.lit(" v"), "version"))


@query("latest_version", SEG + "SELECT media_id, idx, CASE WHEN media_id % 3 = 0 THEN 3 ELSE 1 END AS version, text || ' v' || CASE WHEN media_id % 3 = 0 THEN 3 ELSE 1 END AS text FROM seg")
def latest_version(spark, sf_dir):
    return jb.latest_version(_versions(spark, sf_dir)).select("media_id", "idx", "version", "text")


@query("restore_source", SEG + "SELECT media_id, idx, 1 AS version, text || ' v1' AS text FROM seg")
def restore_source(spark, sf_dir):
    return jb.latest_version(_versions(spark, sf_dir), source=True).select("media_id", "idx", "version", "text")


@query("put_segments", SEG + "SELECT media_id, idx, CASE WHEN media_id % 4 = 0 THEN 'new' ELSE text END AS text FROM seg WHERE media_id % 4 <> 0 OR idx <= 3")
def put_segments(spark, sf_dir):
    now = derived.conversation_segments(spark, sf_dir).df.select("media_id", "idx", "text")
    return jb.put_segments(now, now.filter("media_id % 4 = 0 and idx <= 3").withColumn("text", F.lit("new")))


# ---- streams -----------------------------------------------------------------


def _stream(df, parts: int | None = None):
    """Write ``df`` as a table of as many files as a shuffle has partitions and open it as a stream of two batches."""
    spark = df.sparkSession
    parts = parts or max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    path = f"{shared_dir(spark)}/cuesheet/in_{uuid.uuid4().hex}"
    df.repartition(parts).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", (parts + 1) // 2).parquet(path)


def _drain(spark, df, mode="append"):
    st.use_rocksdb(spark)
    base = f"{shared_dir(spark)}/cuesheet/out_{uuid.uuid4().hex}"
    return st.run_once(df, f"{base}/rows", f"{base}/checkpoint", mode)


@query("stream_transcripts", source_query.oracles["parse_transcripts"])
def stream_transcripts(spark, sf_dir):
    """Transcripts cut every 17 characters and fed in no particular order."""
    pieces = _transcripts(spark, sf_dir).select("media_id", F.regexp_extract_all("text", F.lit("(?s).{1,17}"), F.lit(0)).alias("p"))
    chunks = pieces.select("media_id", F.size("p").alias("n"), F.posexplode("p").alias("i", "chunk"))
    chunks = chunks.select("media_id", (F.col("i") + 1).cast("bigint").alias("seq"), "chunk", (F.col("i") + 1 == F.col("n")).alias("eof"))
    return _drain(spark, st.parse_stream(_stream(chunks)))


@query("stream_repeated_phrases", cleanup_query.oracles["drop_repeated_phrases"])
def stream_repeated_phrases(spark, sf_dir):
    o = derived.conversation_segments(spark, sf_dir)
    rows = o.df.select("media_id", F.col("idx").alias("seq"), "idx", F.expr(_LOOP).alias("text"))
    return _drain(spark, st.guard_stream(_stream(rows)))


@query("stream_deltas", _SSE)
def stream_deltas(spark, sf_dir):
    rows, _ = _sse(spark, sf_dir)
    last = rows.groupBy("stream_id").agg((F.max("seq") + 1).alias("seq")).select("stream_id", "seq", F.lit("data: [DONE]").alias("line"))
    o = arrange(rows.unionByName(last), ("stream_id",), ("seq",))
    return _drain(spark, st.fold_deltas_stream(_stream(o.df.select("stream_id", (F.col("_pos") + 1).alias("seq"), "line"))))


@query("stream_throttle", _DENSE + "SELECT job_id, at_ms, status FROM th WHERE keep")
def stream_throttle(spark, sf_dir):
    o = arrange(_dense(spark, sf_dir), ("job_id",), ("at_ms", "event_id"))
    rows = o.df.select("job_id", (F.col("_pos") + 1).alias("seq"), "at_ms", "status", "progress", "live")
    return _drain(spark, st.throttle_stream(_stream(rows))).select("job_id", "at_ms", "status")


@query("stream_token_counts", """
SELECT conv_id AS stream_id, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) - first_value(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS generated FROM conversations
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) > 1""")
def stream_token_counts(spark, sf_dir):
    t = derived.table(spark, sf_dir, "conversations").selectExpr("conv_id stream_id", "turn", "bigint(length(text)) tokens")
    o = arrange(t, ("stream_id",), ("turn",))
    return _drain(spark, st.count_tokens_stream(_stream(o.df.select("stream_id", (F.col("_pos") + 1).alias("seq"), "tokens"))))


@query("stream_uncancelled", "WITH" + _EV + "SELECT * FROM ev WHERE job_id NOT IN (SELECT job_id FROM ev WHERE status = 'failed' AND event_id % 50 = 0)")
def stream_uncancelled(spark, sf_dir):
    ev = _events(spark, sf_dir)
    return _drain(spark, st.without_cancelled(_stream(ev), ev.filter("status = 'failed' and event_id % 50 = 0")))


@query("stream_until_cancelled", "WITH" + _EV + """,
 cut AS (SELECT job_id, min(at_ms) AS cancel_ms FROM ev WHERE status = 'failed' GROUP BY job_id)
SELECT ev.* FROM ev LEFT JOIN cut USING (job_id) WHERE cancel_ms IS NULL OR at_ms < cancel_ms""")
def stream_until_cancelled(spark, sf_dir):
    """Events and cancellations as two streams; the cancellations come with the first batch."""
    ev = _events(spark, sf_dir)
    cancels = ev.filter("status = 'failed'").select("job_id", F.col("at_ms").alias("cancel_ms"))
    return _drain(spark, st.until_cancelled(_stream(ev), _stream(cancels, 1)))


@query("seconds_of_segments", SEG + "SELECT media_id, idx, start_ms::DOUBLE / 1000.0 AS start, end_ms::DOUBLE / 1000.0 AS \"end\" FROM seg")
def seconds_of_segments(spark, sf_dir):
    o = derived.conversation_segments(spark, sf_dir)
    return o.df.select("media_id", "idx", tm.seconds(F.col("start_ms")).alias("start"), tm.seconds(F.col("end_ms")).alias("end"))
