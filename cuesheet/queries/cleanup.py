"""Queries over scalar functions, clean-up and text exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuesheet.functions import text as tx
from cuesheet.functions import times as tm
from cuesheet.operators import segments as sg
from cuesheet.ordering import POS
from cuesheet.plans import derived
from cuesheet.queries import sql
from cuesheet.queries.registry import Registry
from cuesheet.queries.sql import NORMAL, PREP, SEG, SPLIT, MERGED, ascii_gap, ass_time, pad, seconds_text, srt_time, strip, sweep
from cuesheet.sinks import subtitles as sb

OUT = ["media_id", "idx", "id", "start_ms", "end_ms", "speaker", "text"]
query = Registry()


def placed(o):
    """Rows with their position as ``pos`` (1-based)."""
    return o.df.select(*OUT, (F.col(POS) + 1).alias("pos"))


@query("coerce_segments", SEG + f"""
SELECT media_id, idx, CASE WHEN idx % 3 = 0 THEN {pad('idx', 4, 'seg_')} ELSE 'own_' || idx END AS id, start_ms, end_ms,
       CASE WHEN idx % 4 = 0 THEN 'S00' ELSE speaker END AS speaker, CASE WHEN idx % 5 = 0 THEN '' ELSE text END AS text FROM seg""")
def coerce_segments(spark, sf_dir):
    o = derived.conversation_segments(spark, sf_dir)
    idx = F.col("idx")
    rough = o.plain().select(
        "media_id", "idx", F.when(idx % 3 == 0, "").otherwise(F.concat(F.lit("own_"), idx)).alias("id"), "start_ms", "end_ms",
        F.when(idx % 4 == 0, F.lit(None)).otherwise(F.col("speaker")).alias("speaker"),
        F.when(idx % 5 == 0, F.lit(None)).otherwise(F.col("text")).alias("text"),
    )
    return sg.coerce_segments(rough)


@query("prepare_segments", SEG + PREP + "SELECT media_id, idx, id, start_ms, end_ms, speaker, text, pos FROM prep")
def prepare_segments(spark, sf_dir):
    return placed(sg.prepare(derived.conversation_segments(spark, sf_dir)))


@query("prepare_for_clips", SEG + f""",
 v AS (SELECT media_id, idx, {pad('idx', 4, 'seg_')} AS id, start_ms, CASE WHEN idx % 9 = 0 THEN start_ms ELSE end_ms END AS end_ms,
              speaker, {strip("text")} AS text FROM seg)
SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, end_ms, idx) AS pos FROM v WHERE text <> '' AND end_ms > start_ms""")
def prepare_for_clips(spark, sf_dir):
    o = derived.conversation_segments(spark, sf_dir)
    o = o.with_columns({"end_ms": F.when(F.col("idx") % 9 == 0, F.col("start_ms")).otherwise(F.col("end_ms"))})
    return placed(sg.prepare_for_clips(o))


@query("assign_ids", SEG + PREP + f"SELECT media_id, pos AS idx, {pad('pos', 4, 'seg_')} AS id, start_ms FROM prep")
def assign_ids(spark, sf_dir):
    o = sg.renumber(sg.prepare(derived.conversation_segments(spark, sf_dir)))
    return o.df.select("media_id", "idx", "id", "start_ms")


@query("format_times", SEG + f"SELECT media_id, idx, {srt_time('start_ms * 7')} AS srt, {ass_time('start_ms * 7')} AS ass FROM seg")
def format_times(spark, sf_dir):
    t = F.col("start_ms") * 7
    return derived.conversation_segments(spark, sf_dir).df.select("media_id", "idx", tm.srt_time(t).alias("srt"), tm.ass_time(t).alias("ass"))


@query("parse_times", SEG + """
SELECT media_id, idx, CASE WHEN idx % 6 <> 0 THEN (idx % 30) * 3600000 + (start_ms // 60000) % 90 * 60000 + (start_ms // 1000) % 60 * 1000 + start_ms % 1000 END AS srt_ms,
       CASE WHEN idx % 6 <> 0 THEN (idx % 30) * 3600000 + (start_ms // 60000) % 90 * 60000 + (start_ms // 1000) % 60 * 1000 + start_ms % 100 * 10 END AS ass_ms
FROM seg""")
def parse_times(spark, sf_dir):
    """Unpadded stamps: ``,5`` is 5 ms and ``.5`` is 5 hundredths; every sixth stamp is broken."""
    o = derived.conversation_segments(spark, sf_dir)
    head = "concat(idx % 30, ':', (start_ms div 60000) % 90, if(idx % 6 = 0, ';', ':'), (start_ms div 1000) % 60"
    return o.df.select(
        "media_id", "idx",
        tm.parse_srt_time(F.expr(f"{head}, ',', start_ms % 1000)")).alias("srt_ms"),
        tm.parse_ass_time(F.expr(f"{head}, '.', start_ms % 100)")).alias("ass_ms"),
    )


@query("split_speaker_prefix", SEG + f"""
SELECT media_id, idx, CASE WHEN idx % 3 = 0 THEN 'S00' ELSE 'Dr Who-' || idx END AS speaker,
       CASE WHEN idx % 3 = 0 THEN t ELSE t || chr(10) || 'next: line' END AS body
FROM (SELECT *, {strip("'. ' || replace(text, ':', ';')")} AS t FROM seg)""")
def split_speaker_prefix(spark, sf_dir):
    o = derived.conversation_segments(spark, sf_dir)
    t = tx.strip(F.concat(F.lit(". "), F.replace("text", F.lit(":"), F.lit(";"))))  # prefixes come from the rule below
    said = F.when(F.col("idx") % 3 == 0, t).otherwise(
        F.concat(F.lit(" Dr Who-"), "idx", F.lit(":  "), t, F.lit("\nnext: line "))
    )
    return o.df.select("media_id", "idx", tx.prefixed_speaker(said).alias("s")).select("media_id", "idx", "s.speaker", "s.body")


@query("ass_markup", SEG + r"""
SELECT media_id, idx, replace(text, '{', '') || ' x' || chr(10) || 'y' AS bare,
       replace(replace(replace(replace('{\b1}' || text || '\' || chr(10) || '}', '\', '\\'), '{', '('), '}', ')'), chr(10), '\N') AS escaped
FROM (SELECT * REPLACE (replace(replace(text, '{', '('), '\', '/') AS text) FROM seg)""")
def ass_markup(spark, sf_dir):
    df = derived.conversation_segments(spark, sf_dir).df.withColumn("text", F.translate("text", "{\\", "(/"))  # marks come from below
    marked = F.concat(F.lit("{\\pos(1,2)}"), "text", F.lit("\\hx{\\i0}\\Ny"))
    raw = F.concat(F.lit("{\\b1}"), "text", F.lit("\\\n}"))
    return df.select("media_id", "idx", tx.strip_ass_markup(marked).alias("bare"), tx.escape_ass(raw).alias("escaped"))


@query("display_text", SEG + """
SELECT media_id, idx, CASE speaker WHEN 'S01' THEN 'Alice' WHEN 'S02' THEN 'S02' ELSE 'S03' END || ': ' || text AS shown FROM seg""")
def display_text(spark, sf_dir):
    o = derived.conversation_segments(spark, sf_dir)
    names = o.df.select("media_id", "speaker").distinct().withColumn("name", F.expr("case speaker when 'S01' then 'Alice' when 'S02' then '' end"))
    df = sb.with_names(o.df, names)
    shown = tx.display_text(F.col("speaker"), F.col("text"), show_speaker=True, name=F.col("speaker_name"))
    return df.select("media_id", "idx", shown.alias("shown"))


@query("join_texts", SEG + f"""
SELECT a.media_id, a.idx, a.text || {ascii_gap('a.text', 'b.text')} || b.text AS joined,
       a.text || CASE WHEN regexp_matches(b.text, '^[,.;:!?，。！、；：）】》\\])？]') OR regexp_matches(a.text, '[(\\[{{（【《]$') THEN '' ELSE ' ' END || b.text AS subtitle
FROM (SELECT media_id, idx, {strip('text')} AS text FROM seg WHERE {strip('text')} <> '') a
JOIN (SELECT media_id, idx, {strip('text')} AS text FROM seg WHERE {strip('text')} <> '') b ON b.media_id = a.media_id AND b.idx = a.idx + 1""")
def join_texts(spark, sf_dir):
    o = derived.conversation_segments(spark, sf_dir)
    o = o.with_columns({"text": tx.strip(F.col("text"))}).local({"next": lambda w: F.lead("text").over(w)}, after=1)
    df = o.df.filter((F.col("text") != "") & (F.col("next") != ""))
    return df.select(
        "media_id", "idx", tx.join_text(F.col("text"), F.col("next")).alias("joined"),
        tx.join_subtitle_parts(F.array("text", "next")).alias("subtitle"),
    )


@query("split_long_text", SEG + PREP + sweep("fixed", "prep") + ", merged AS (SELECT media_id, idx, id, start_ms, end_ms, speaker, text, pos FROM fixed)" + SPLIT + """
SELECT media_id, pos, CAST(g AS BIGINT) AS chunk_no, t AS chunk FROM chunks
UNION ALL SELECT media_id, pos, 1, text FROM merged WHERE length(text) <= 24""")
def split_long_text(spark, sf_dir):
    o = sg.prepare(derived.conversation_segments(spark, sf_dir))
    df = o.df.select("media_id", (F.col(POS) + 1).alias("pos"), F.posexplode(tx.split_long_text(F.col("text"), 24)).alias("k", "chunk"))
    return df.select("media_id", "pos", (F.col("k") + 1).cast("bigint").alias("chunk_no"), "chunk")


_PHRASE = "trim(regexp_replace(regexp_replace(lower(text), '[''`]', '', 'g'), '[^a-z0-9\\x{4E00}-\\x{9FFF}]+', ' ', 'g'))"


@query("normal_phrase", SEG + f"""
SELECT media_id, idx, p AS phrase, p <> '' AND length(p) <= 64 AND len(string_split(p, ' ')) <= 6 AS short FROM (SELECT *, {_PHRASE} AS p FROM seg)""")
def normal_phrase(spark, sf_dir):
    p = tx.normal_phrase(F.col("text"))
    return derived.conversation_segments(spark, sf_dir).df.select("media_id", "idx", p.alias("phrase"), tx.is_short_phrase(p).alias("short"))


@query("sentence_ends", SEG + f"""
SELECT media_id, idx, regexp_matches(text, '[.!?。！？…]["'')\\]}}）】》]*{sql.WS}*$') AS ends_sentence,
       regexp_matches(text, '[.!?。！？]{sql.WS}*$') AS looks_complete
FROM (SELECT media_id, idx, CASE WHEN idx % 4 = 0 THEN text || '")' WHEN idx % 7 = 0 THEN text || ' …' ELSE text END AS text FROM seg)""")
def sentence_ends(spark, sf_dir):
    t = F.expr("case when idx % 4 = 0 then concat(text, '\")') when idx % 7 = 0 then concat(text, ' …') else text end")
    df = derived.conversation_segments(spark, sf_dir).df
    return df.select("media_id", "idx", tx.ends_sentence(t).alias("ends_sentence"), tx.looks_complete(t).alias("looks_complete"))


@query("fix_overlaps", SEG + PREP + sweep("fixed", "prep") + "SELECT media_id, idx, id, start_ms, end_ms, speaker, text, pos FROM fixed")
def fix_overlaps(spark, sf_dir):
    return placed(sg.fix_overlaps(sg.prepare(derived.conversation_segments(spark, sf_dir))))


@query("merge_adjacent", SEG + PREP + sweep("fixed", "prep") + MERGED + "SELECT media_id, idx, id, start_ms, end_ms, speaker, text, pos FROM merged")
def merge_adjacent(spark, sf_dir):
    return placed(sg.merge_adjacent(sg.fix_overlaps(sg.prepare(derived.conversation_segments(spark, sf_dir)))))


@query("split_long_segments", SEG + PREP + sweep("fixed", "prep") + ", merged AS (SELECT media_id, idx, id, start_ms, end_ms, speaker, text, pos FROM fixed)" + SPLIT
       + "SELECT media_id, idx, id, start_ms, end_ms, speaker, text, pos FROM split")
def split_long_segments(spark, sf_dir):
    return placed(sg.split_long(sg.fix_overlaps(sg.prepare(derived.conversation_segments(spark, sf_dir)))))


@query("normalize_segments", SEG + NORMAL + f"SELECT media_id, pos AS idx, {pad('pos', 4, 'seg_')} AS id, start_ms, end_ms, speaker, text FROM norm")
def normalize_segments(spark, sf_dir):
    return sg.normalize(derived.conversation_segments(spark, sf_dir)).plain().select(*OUT)


_LOOP = "CASE WHEN idx % 5 < 4 THEN 'Ok, then!' ELSE text END"


@query("drop_repeated_phrases", SEG + f""",
 r AS (SELECT media_id, idx, {_LOOP} AS text FROM seg),
 ph AS (SELECT *, CASE WHEN p <> '' AND length(p) <= 64 AND len(string_split(p, ' ')) <= 6 THEN p ELSE '' END AS ph,
               row_number() OVER (PARTITION BY media_id ORDER BY idx) AS pos
        FROM (SELECT *, {_PHRASE} AS p FROM r) WHERE {strip('text')} <> ''),
 g AS (
   SELECT media_id, pos, idx, text, ph, CAST(CASE WHEN ph = '' THEN 0 ELSE 1 END AS BIGINT) AS run FROM ph WHERE pos = 1
   UNION ALL
   SELECT s.media_id, s.pos, s.idx, s.text, s.ph, CASE WHEN s.ph = '' THEN 0 WHEN s.ph = g.ph THEN g.run + 1 ELSE 1 END
   FROM g JOIN ph s ON s.media_id = g.media_id AND s.pos = g.pos + 1)
SELECT media_id, idx, text FROM (SELECT *, count(*) OVER (PARTITION BY media_id, ph ORDER BY pos) AS total FROM g)
WHERE ph = '' OR (run <= 3 AND total <= 24)""")
def drop_repeated_phrases(spark, sf_dir):
    o = derived.conversation_segments(spark, sf_dir).with_columns({"text": F.expr(_LOOP)})
    return sg.drop_repeated_phrases(o).select("media_id", "idx", "text")


@query("choose_transcript", """
WITH v AS (SELECT conv_id * 100000 + turn // 2 AS media_id, 1 + turn % 2 AS version, CASE WHEN conv_id % 2 = 0 AND turn % 2 = 0 THEN left(text, 20 + conv_id % 30) ELSE text END AS text,
                  1 + conv_id % 4 AS n, 9000 + 1000 * (conv_id % 7) AS dur FROM conversations),
 s AS (SELECT media_id, max(CASE WHEN version = 1 THEN text END) AS t1, max(CASE WHEN version = 2 THEN text END) AS t2, max(n) AS n, max(dur) AS dur FROM v GROUP BY media_id),
 z AS (SELECT *, """ + f"length({strip('t1')}) < 40 AND n <= 2 AND dur >= 12000 AS sparse, length({strip('t1')}) AS l1, length({strip('t2')}) AS l2" + """ FROM s)
SELECT media_id, sparse, CAST(CASE WHEN sparse AND coalesce(l2, -1) > l1 THEN 2 ELSE 1 END AS BIGINT) AS version,
       CASE WHEN sparse AND coalesce(l2, -1) > l1 THEN t2 ELSE t1 END AS text FROM z""")
def choose_transcript(spark, sf_dir):
    """Each two turns of a conversation stand for two transcripts of one media."""
    turns = derived.table(spark, sf_dir, "conversations")
    versions = turns.selectExpr(
        "conv_id * 100000 + turn div 2 media_id", "1 + turn % 2 version",
        "if(conv_id % 2 = 0 and turn % 2 = 0, left(text, int(20 + conv_id % 30)), text) text",
        "1 + conv_id % 4 segment_count", "9000 + 1000 * (conv_id % 7) duration_ms",
    )
    return sg.choose_transcript(versions)


_BLOCK = f"pos || chr(10) || {srt_time('start_ms')} || ' --> ' || {srt_time('end_ms')} || chr(10) || speaker || ': ' || text"


@query("export_srt", SEG + PREP + sweep("fixed", "prep") + f"SELECT media_id, string_agg({_BLOCK}, chr(10) || chr(10) ORDER BY pos) || chr(10) AS srt FROM fixed GROUP BY media_id")
def export_srt(spark, sf_dir):
    return sb.export_srt(sg.fix_overlaps(sg.prepare(derived.conversation_segments(spark, sf_dir))))


@query("export_json", SEG + """
SELECT media_id, '[' || string_agg('{"id":' || to_json('seg_' || idx) || ',"start":' || to_json(start_ms::DOUBLE / 1000.0) || ',"end":' || to_json(end_ms::DOUBLE / 1000.0)
       || ',"speaker":' || to_json(speaker) || ',"text":' || to_json(text) || '}', ',' ORDER BY idx) || ']' AS json FROM seg GROUP BY media_id""")
def export_json(spark, sf_dir):
    o = derived.conversation_segments(spark, sf_dir).with_columns({"id": F.concat(F.lit("seg_"), "idx")})
    return sb.export_json(o)


@query("render_transcript", SEG + f"""
SELECT media_id, string_agg('[' || {seconds_text('start_ms')} || '][' || speaker || ']' || text || '[' || {seconds_text('end_ms')} || ']', '' ORDER BY idx) AS text FROM seg GROUP BY media_id""")
def render_transcript(spark, sf_dir):
    return sb.render_transcript(derived.conversation_segments(spark, sf_dir))
