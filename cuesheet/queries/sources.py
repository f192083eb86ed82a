"""Queries that parse derived transcripts, subtitle texts and JSON back into rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cuesheet.functions import text as tx
from cuesheet.operators import segments as sg
from cuesheet.plans import derived
from cuesheet.queries.intervals import events_sql
from cuesheet.queries.registry import Registry
from cuesheet.queries.sql import NORMAL, SEG, half_even_cs, pad, seconds_text, srt_time, strip
from cuesheet.session import shared_dir
from cuesheet.sinks import ass as ass_sink
from cuesheet.sinks import files as fl
from cuesheet.sinks import subtitles as sb
from cuesheet.sources import records as rec
from cuesheet.sources import subtitle_files as sf
from cuesheet.sources import transcripts as tr

query = Registry()

_NOISY = f""",
 tx AS (SELECT media_id, idx, {half_even_cs('start_ms')} * 10 AS start_ms, {half_even_cs('end_ms')} * 10 AS end_ms, speaker,
               {strip("CASE WHEN idx % 7 = 0 THEN '[99999]  ' || text WHEN idx % 5 = 0 THEN text || ' [2024.5] x' ELSE text END")} AS text FROM (SELECT * REPLACE (replace(text, '[', '(') AS text) FROM seg))"""


def _transcripts(spark, sf_dir):
    """Transcripts with leading noise and numeric brackets inside the text."""
    o = derived.conversation_segments(spark, sf_dir)
    o = o.with_columns({"text": F.replace("text", F.lit("["), F.lit("("))})  # own brackets come from the rules below
    text = F.expr("case when idx % 7 = 0 then concat('[99999]  ', text) when idx % 5 = 0 then concat(text, ' [2024.5] x') else text end")
    out = sb.render_transcript(o.with_columns({"text": text}))
    return out.withColumn("text", F.concat(F.lit("noise [bad] [1.2.3] [["), "text", F.lit("\n")))


@query("parse_transcripts", SEG + _NOISY + "SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY idx) AS idx, start_ms, end_ms, speaker, text FROM tx WHERE text <> ''")
def parse_transcripts(spark, sf_dir):
    return tr.parse_transcripts(_transcripts(spark, sf_dir))


_RAW = f""",
 seg0 AS (SELECT media_id, idx, {half_even_cs('start_ms')} * 10 AS start_ms, {half_even_cs('end_ms')} * 10 AS end_ms, speaker, {strip("replace(text, '[', '(')")} AS text FROM seg),
 c AS (SELECT *, {pad('idx', 4, 'seg_')} AS id FROM (SELECT * REPLACE (row_number() OVER (PARTITION BY media_id ORDER BY idx) AS idx) FROM seg0 WHERE text <> '')),
 prep AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, end_ms, idx) AS pos FROM c WHERE text <> '')"""


@query("transcript_to_subtitles", SEG + _RAW + NORMAL[NORMAL.index(",\n fixed"):] + f"SELECT media_id, pos AS idx, {pad('pos', 4, 'seg_')} AS id, start_ms, end_ms, speaker, text FROM norm")
def transcript_to_subtitles(spark, sf_dir):
    o = derived.conversation_segments(spark, sf_dir)
    texts = sb.render_transcript(o.with_columns({"text": F.replace("text", F.lit("["), F.lit("("))}))
    return sg.normalize(tr.parse_transcripts(texts)).plain().select(*sg.COLUMNS)


@query("parse_srt", SEG + f"""
SELECT media_id, idx, {pad('idx', 4, 'seg_')} AS id, start_ms, end_ms, CASE WHEN t = '' THEN 'S00' ELSE speaker END AS speaker,
       CASE WHEN t = '' THEN speaker || ':' ELSE t END AS text
FROM (SELECT *, {strip('text')} AS t FROM seg) WHERE idx % 8 <> 3""")
def parse_srt(spark, sf_dir):
    """SRT texts back to rows; every eighth block has a broken time and is skipped."""
    blocks = sb.srt_blocks(derived.conversation_segments(spark, sf_dir))
    block = F.when(F.col("block_no") % 8 == 3, F.replace("block", F.lit(" --> "), F.lit(" --> x"))).otherwise(F.col("block"))
    texts = sb.joined(blocks, ["media_id"], "block_no", block, "\r\n \n")
    return sf.parse_srt(texts)


@query("parse_ass", SEG + events_sql("false", "l.speaker || ': ' || l.text") + f""",
 u AS (SELECT media_id, 13 + event_no AS idx, {half_even_cs('start_ms')} * 10 AS start_ms, {half_even_cs('end_ms')} * 10 AS end_ms, {strip("replace(text, chr(92) || 'N', chr(10))")} AS t FROM events),
 v AS (SELECT *, split_part(t, chr(10), 1) AS head FROM u)
SELECT media_id, idx, {pad('idx', 4, 'seg_')} AS id, start_ms, greatest(start_ms, end_ms) AS end_ms, left(t, 3) AS speaker,
       {strip(strip('substr(head, 5)') + " || substr(t, length(head) + 1)")} AS text FROM v""")
def parse_ass(spark, sf_dir):
    texts = ass_sink.export_ass(derived.conversation_segments(spark, sf_dir), {"show_speaker": True})
    return sf.parse_ass(texts.withColumnRenamed("ass", "text"))


@query("parse_segment_json", SEG + f"""
SELECT media_id, idx, CASE WHEN idx % 3 = 0 THEN {pad('idx', 4, 'seg_')} ELSE 'own_' || idx END AS id, start_ms, end_ms, speaker, text FROM seg WHERE idx % 10 <> 0""")
def parse_segment_json(spark, sf_dir):
    return rec.parse_segment_json(_segment_json(spark, sf_dir))[0]


@query("segment_json_rejects", SEG + "SELECT media_id, idx, 'missing start or end' AS reason FROM seg WHERE idx % 10 = 0")
def segment_json_rejects(spark, sf_dir):
    return rec.parse_segment_json(_segment_json(spark, sf_dir))[1]


def _segment_json(spark, sf_dir):
    o = derived.conversation_segments(spark, sf_dir)
    item = F.to_json(
        F.struct(
            F.expr("if(idx % 3 = 0, null, concat('own_', idx))").alias("id"), F.expr("if(idx % 10 = 0, null, start_ms / 1000.0D)").alias("start"),
            (F.col("end_ms") / 1000.0).alias("end"), "speaker", "text",
        )
    )
    out = sb.joined(o.df, ["media_id"], "idx", item, ",")
    return out.withColumn("text", F.concat(F.lit("["), "text", F.lit("]")))


_JOB_SQL = """
 j AS (SELECT event_id, user_id, ['queued','transcribing','done','waiting_review','']
         [CAST(event_id % 5 + 1 AS INTEGER)] AS st, value, (epoch_us(ts) // 1000) / 1000.0::DOUBLE AS at0 FROM events WHERE event_id % 11 <> 0)"""


def _job_texts(spark, sf_dir):
    doc = F.to_json(
        F.struct(
            F.format_string("job_%d", "event_id").alias("id"),
            F.expr("element_at(array('queued','transcribing','done','waiting_review',''), int(event_id % 5 + 1))").alias("status"),
            F.expr("if(event_id % 3 = 0, null, concat('clip ', user_id, '.mp4'))").alias("media_name"),
            F.struct(F.lit("p").alias("prompt"), F.expr("1000 + event_id % 100").alias("max_length"), F.lit(512).alias("max_new_tokens")).alias("inference"),
            F.expr("if(event_id % 2 = 0, 2048, 0)").alias("max_new_tokens"),
            F.expr("event_id % 4000").alias("generated_tokens"),
            F.expr("least(value / 100, 1.0D)").alias("progress"),
            F.expr("unix_millis(cast(ts as timestamp)) / 1000.0D").alias("updated_at"),
            F.expr("unix_millis(cast(ts as timestamp)) / 1000.0D").alias("created_at"),
            F.expr("if(event_id % 7 = 0, user_id % 3, null)").alias("speaker_count"),
        )
    )
    events = derived.table(spark, sf_dir, "events")
    broken = F.expr("event_id % 11 = 0")
    return events.select("event_id", F.when(broken, F.substring(doc, 1, 30)).otherwise(doc).alias("text"))


@query("parse_jobs", "WITH" + _JOB_SQL + """
SELECT 'job_' || event_id AS id, CASE WHEN st = '' THEN 'failed' ELSE st END AS status, CASE WHEN event_id % 3 = 0 THEN 'input.media' ELSE 'clip ' || user_id || '.mp4' END AS media_name,
       'p' AS inference_prompt, 1000 + event_id % 100 AS max_length, CASE WHEN event_id % 2 = 0 THEN 2048 ELSE 512 END AS max_new_tokens, 'greedy' AS decoding,
       event_id % 4000 AS generated_tokens, least(value / 100, 1.0::DOUBLE) AS progress, at0 AS updated_at, CASE WHEN event_id % 7 = 0 THEN user_id % 3 END AS speaker_count, 'auto' AS diarization_backend
FROM j""")
def parse_jobs(spark, sf_dir):
    jobs = rec.parse_jobs(_job_texts(spark, sf_dir))
    return jobs.select(
        "id", "status", "media_name", "inference_prompt", "max_length", "max_new_tokens", "decoding", "generated_tokens", "progress", "updated_at",
        "speaker_count", "diarization_backend",
    )


_MANIFEST_LINE = """case when conv_id % 4 = 1 and turn = 1 then '  '
            when conv_id % 5 = 2 and turn = 0 then to_json(named_struct('conversation', array(named_struct('role', 'user', 'message_type', 'text', 'content', text))))
            else to_json(named_struct('conversation', array(
              named_struct('role', 'user', 'message_type', 'text', 'content', if(turn = 3, ' ', concat(' say ', turn, ' '))),
              named_struct('role', 'user', 'message_type', 'audio', 'content', concat(if(turn % 2 = 0, '/abs/', 'audio/'), conv_id, '.wav')),
              named_struct('role', 'assistant', 'message_type', 'text', 'content', concat('[0.00][S01]', role, '[1.00]'))))) end"""


def _manifests(spark, sf_dir):
    turns = derived.table(spark, sf_dir, "conversations")
    return sb.joined(turns, ["conv_id"], "turn", F.expr(_MANIFEST_LINE), "\n").select(F.format_string("/data/m%d/train.jsonl", "conv_id").alias("path"), "text")


_MAN = """
WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS line_no, '/data/m' || conv_id AS root FROM conversations)"""


@query("parse_manifest", _MAN + """
SELECT root || '/train.jsonl' AS path, line_no, CASE WHEN turn % 2 = 0 THEN '/abs/' ELSE root || '/audio/' END || conv_id || '.wav' AS audio,
       'say ' || turn AS prompt, '[0.00][S01]' || role || '[1.00]' AS target
FROM m WHERE NOT (conv_id % 4 = 1 AND turn = 1) AND NOT (conv_id % 5 = 2 AND turn = 0) AND turn <> 3""")
def parse_manifest(spark, sf_dir):
    return rec.parse_manifest(_manifests(spark, sf_dir))[0]


@query("manifest_rejects", _MAN + """
SELECT root || '/train.jsonl' AS path, line_no, CASE WHEN turn = 3 THEN 'blank prompt, audio path or target' ELSE 'messages are not user text, user audio, assistant text' END AS reason
FROM m WHERE NOT (conv_id % 4 = 1 AND turn = 1) AND ((conv_id % 5 = 2 AND turn = 0) OR turn = 3)""")
def manifest_rejects(spark, sf_dir):
    return rec.parse_manifest(_manifests(spark, sf_dir))[1]


@query("manifest_from_files", """
WITH m AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) AS line_no FROM conversations)
SELECT line_no, CASE WHEN turn % 2 = 0 THEN '/abs/' ELSE '/m/audio/' END || conv_id || '.wav' AS audio, 'say ' || turn AS prompt, '[0.00][S01]' || role || '[1.00]' AS target
FROM m WHERE NOT (conv_id % 4 = 1 AND turn = 1) AND NOT (conv_id % 5 = 2 AND turn = 0) AND turn <> 3""")
def manifest_from_files(spark, sf_dir):
    """One manifest of all samples, written as a text file and read in splits; its folder counts as /m."""
    path = f"{shared_dir(spark)}/cuesheet/manifest_{uuid.uuid4().hex}"
    lines = derived.table(spark, sf_dir, "conversations").orderBy("conv_id", "turn").select(F.expr(_MANIFEST_LINE).alias("value"))
    lines.coalesce(1).write.text(path)
    good, _ = rec.read_manifest(spark, path)
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    return good.select("line_no", F.when(F.col("audio").startswith(folder), F.concat(F.lit("/m"), F.substring("audio", F.length(folder) + 1, F.length("audio")))).otherwise(F.col("audio")).alias("audio"), "prompt", "target")


@query("parse_styles", """
SELECT doc_id AS media_id, CASE WHEN doc_id % 2 = 0 THEN doc_id % 60 + 20 END AS font_size, CASE WHEN doc_id % 3 = 0 THEN 80 ELSE 56 END AS margin_v, toxic = 1 AS show_speaker,
       CASE WHEN quality = 1 THEN 'bar' ELSE 'blur' END AS mask_mode, 0.82::DOUBLE AS mask_opacity, CASE WHEN doc_id % 5 = 0 THEN 'S01=Ann' END AS names FROM labels""")
def parse_styles(spark, sf_dir):
    raw = derived.table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("media_id"),
        F.expr(
            """to_json(named_struct('font_size', if(doc_id % 2 = 0, string(doc_id % 60 + 20), ''), 'margin_v', if(doc_id % 3 = 0, 80, null), 'show_speaker', toxic = 1,
               'mask_mode', if(quality = 1, 'bar', 'fog'), 'speaker_names', map('S01', if(doc_id % 5 = 0, ' Ann ', '  '))))"""
        ).alias("text"),
    )
    s = rec.parse_styles(raw)
    names = F.when(F.col("speaker_names").isNotNull(), F.concat_ws("=", F.map_keys("speaker_names")[0], F.map_values("speaker_names")[0]))
    return s.select("media_id", "font_size", "margin_v", "show_speaker", "mask_mode", "mask_opacity", names.alias("names"))


_KIND = "case event_type when 'click' then 'srt' when 'view' then 'ass' else 'json' end"


def _files(spark, sf_dir):
    return derived.table(spark, sf_dir, "events").select(F.expr("user_id * 100 + event_id % 60").alias("media_id"), F.expr(_KIND).alias("kind"), F.col("ts").alias("modified"))


_PICK = f"""
WITH f AS (SELECT user_id * 100 + event_id % 60 AS media_id, {_KIND} AS kind, ts FROM events),
 m AS (SELECT media_id, max(ts) FILTER (kind = 'srt') AS srt, max(ts) FILTER (kind = 'ass') AS ass, max(ts) FILTER (kind = 'json') AS js FROM f GROUP BY media_id)"""


@query("pick_subtitle_source", _PICK + """
SELECT media_id, CASE WHEN srt IS NOT NULL THEN 'srt' ELSE 'ass' END AS kind, coalesce(srt, ass) AS modified FROM m
WHERE coalesce(srt, ass) IS NOT NULL AND (js IS NULL OR js < coalesce(srt, ass))""")
def pick_subtitle_source(spark, sf_dir):
    return sf.pick_subtitle_source(_files(spark, sf_dir))


@query("pick_subtitle_source_forced", _PICK + """
SELECT media_id, CASE WHEN srt IS NOT NULL THEN 'srt' WHEN ass IS NOT NULL THEN 'ass' ELSE 'json' END AS kind, coalesce(srt, ass, js) AS modified FROM m""")
def pick_subtitle_source_forced(spark, sf_dir):
    return sf.pick_subtitle_source(_files(spark, sf_dir), force=True)


@query("pick_source_version", """
WITH f AS (SELECT DISTINCT user_id * 10 + event_id % 30 AS media_id, CASE event_type WHEN 'click' THEN 'segments.source.json' WHEN 'view' THEN 'segments_original.json' WHEN 'error' THEN 'other.json' ELSE 'segments.json' END AS name FROM events)
SELECT media_id, ['segments.source.json','segments_original.json','segments.json'][min(list_position(['segments.source.json','segments_original.json','segments.json'], name))] AS name
FROM f WHERE name <> 'other.json' GROUP BY media_id""")
def pick_source_version(spark, sf_dir):
    name = "case event_type when 'click' then 'segments.source.json' when 'view' then 'segments_original.json' when 'error' then 'other.json' else 'segments.json' end"
    files = derived.table(spark, sf_dir, "events").select(F.expr("user_id * 10 + event_id % 30").alias("media_id"), F.expr(name).alias("name")).distinct()
    return sf.pick_first_file(files, sf.SOURCE_VERSIONS)


@query("ass_resolution", """
SELECT doc_id AS media_id, CASE WHEN doc_id % 2 = 0 THEN 640 + doc_id ELSE 1920 END AS width, CASE WHEN doc_id % 3 = 0 THEN 360 + doc_id ELSE 1080 END AS height FROM labels""")
def ass_resolution(spark, sf_dir):
    text = "concat('[Script Info]\n', if(doc_id % 2 = 0, concat('PlayResX: ', 640 + doc_id, '\r\n'), ''), if(doc_id % 3 = 0, concat('PlayResY:', 360 + doc_id, ' \n'), ''), '[Events]')"
    return sf.ass_resolution(derived.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("media_id"), F.expr(text).alias("text")))


@query("written_sets", SEG + f"""
 SELECT media_id, 'segments' AS name, '[' || string_agg('{{"id":' || to_json({pad('idx', 4, 'seg_')}) || ',"start":' || to_json(start_ms::DOUBLE / 1000.0) || ',"end":' || to_json(end_ms::DOUBLE / 1000.0)
       || ',"speaker":' || to_json(speaker) || ',"text":' || to_json(text) || '}}', ',' ORDER BY idx) || ']' AS text FROM seg GROUP BY media_id
 UNION ALL SELECT media_id, 'srt', chr(65279) || string_agg(idx || chr(10) || {srt_time('start_ms')} || ' --> ' || {srt_time('end_ms')} || chr(10) || text, chr(10) || chr(10) ORDER BY idx) || chr(10) FROM seg GROUP BY media_id""")
def written_sets(spark, sf_dir):
    """Segments and SRT of a committed set, read back; an older version and one that was never committed don't show."""
    path = f"{shared_dir(spark)}/cuesheet/set_{uuid.uuid4().hex}"
    o = derived.conversation_segments(spark, sf_dir).with_columns({"id": F.format_string("seg_%04d", "idx")})
    fl.write_media_set(o.with_columns({"text": F.lit("old")}), path, version=1)
    fl.write_media_set(o, path, version=2)
    o.df.select("media_id", F.lit("torn").alias("text")).distinct().write.parquet(f"{path}/srt/version=3")
    read = lambda name: fl.read_texts(spark, f"{path}/{name}").select("media_id", F.lit(name).alias("name"), "text")
    return read("segments").unionByName(read("srt"))


@query("transcripts_from_files", SEG + f"""
SELECT media_id, string_agg('[' || {seconds_text('start_ms')} || '][' || speaker || ']' || text || '[' || {seconds_text('end_ms')} || ']', '' ORDER BY idx) AS text FROM seg GROUP BY media_id""")
def transcripts_from_files(spark, sf_dir):
    """Transcripts written as one file per media and read back."""
    path = f"{shared_dir(spark)}/cuesheet/texts_{uuid.uuid4().hex}"
    fl.export_files(sb.render_transcript(derived.conversation_segments(spark, sf_dir)), path)
    back = tr.read_transcripts(spark, path)
    return back.select(F.regexp_extract("media_id", "media_id=([0-9]+)/", 1).cast("bigint").alias("media_id"), F.regexp_replace("text", r"\n\z", "").alias("text"))
