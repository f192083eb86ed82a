"""Queries over interval operators and the outputs built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuesheet.operators import intervals as iv
from cuesheet.plans import derived
from cuesheet.queries.registry import Registry
from cuesheet.queries.sql import PREP, SEG, ass_time, pad, strip
from cuesheet.sinks import ass as ass_sink
from cuesheet.sinks import files as file_sink

query = Registry()

EVENTS = """,
 live AS (SELECT * FROM seg WHERE text <> '' AND end_ms > start_ms),
 edge AS (SELECT media_id, start_ms AS t0 FROM live UNION SELECT media_id, end_ms FROM live),
 cell AS (SELECT media_id, t0, lead(t0) OVER (PARTITION BY media_id ORDER BY t0) AS until FROM edge),
 act AS (
   SELECT c.media_id, c.t0, c.until,
          CASE WHEN count(*) = 1 AND {colors} THEN 'Speaker_' || max(l.speaker) ELSE 'Default' END AS style,
          string_agg(replace(replace(replace(replace({shown}, '\\', '\\\\'), '{{', '('), '}}', ')'), chr(10), '\\N'), '\\N' ORDER BY l.start_ms, l.end_ms, l.idx) AS text
   FROM cell c JOIN live l ON l.media_id = c.media_id AND l.start_ms < c.until AND l.end_ms > c.t0
   WHERE c.until IS NOT NULL GROUP BY c.media_id, c.t0, c.until),
 flag AS (SELECT *, CASE WHEN lag(until) OVER w = t0 AND lag(style) OVER w = style AND lag(text) OVER w = text THEN 0 ELSE 1 END AS opens
          FROM act WINDOW w AS (PARTITION BY media_id ORDER BY t0)),
 isl AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY media_id ORDER BY t0) AS BIGINT) AS event_no FROM flag),
 events AS (SELECT media_id, event_no, min(t0) AS start_ms, max(until) AS end_ms, max(style) AS style, max(text) AS text FROM isl GROUP BY media_id, event_no)"""


def events_sql(colors="false", shown="l.text"):
    return EVENTS.format(colors=colors, shown=shown)


@query("flatten_overlaps", SEG + events_sql() + "SELECT * FROM events")
def flatten_overlaps(spark, sf_dir):
    return iv.flatten_overlaps(derived.conversation_segments(spark, sf_dir))


@query("flatten_overlaps_styled", SEG + events_sql("true", "l.speaker || ': ' || l.text") + "SELECT * FROM events")
def flatten_overlaps_styled(spark, sf_dir):
    return iv.flatten_overlaps(derived.conversation_segments(spark, sf_dir), show_speaker=True, speaker_colors=True)


_STYLE = "'Style: ' || {n} || ',Noto Sans CJK SC,49,' || {c} || ',&H000000FF,&H00000000,&H64000000,0,0,0,0,100,100,0,0,1,3,1,2,48,48,56,1'"
_STYLES = (
    ", rk AS (SELECT media_id, speaker, row_number() OVER (PARTITION BY media_id ORDER BY speaker) - 1 AS r FROM (SELECT DISTINCT media_id, speaker FROM seg)),"
    " styles AS (SELECT DISTINCT media_id, CAST(0 AS BIGINT) AS style_no, " + _STYLE.format(n="'Default'", c="'&H00FFFFFF'") + " AS line FROM seg"
    " UNION ALL SELECT media_id, r + 1, " + _STYLE.format(n="'Speaker_' || speaker", c="(['&H00FFFFFF','&H005BE7FF','&H0086F28F','&H00BBA7FF','&H0000D7FF','&H00FFB56B','&H00FF8EDB','&H00D8D8D8'])[r % 8 + 1]") + " FROM rk)"
)


@query("ass_style_rows", SEG + _STYLES + "SELECT * FROM styles")
def ass_style_rows(spark, sf_dir):
    return ass_sink.style_rows(derived.conversation_segments(spark, sf_dir), {"speaker_colors": True})


_HEAD = "\n".join(
    [
        "[Script Info]", "ScriptType: v4.00+", "WrapStyle: 2", "ScaledBorderAndShadow: yes", "PlayResX: 1920", "PlayResY: 1080", "",
        "[V4+ Styles]", f"Format: {ass_sink.STYLE_FIELDS}", "",
    ]
)


@query("export_ass", SEG + events_sql("true") + _STYLES + f"""
SELECT s.media_id, '{_HEAD}' || s.x || chr(10) || chr(10) || '[Events]' || chr(10) || 'Format: {ass_sink.EVENT_FIELDS}' || chr(10) || e.x || chr(10) AS ass
FROM (SELECT media_id, string_agg(line, chr(10) ORDER BY style_no) AS x FROM styles GROUP BY media_id) s
JOIN (SELECT media_id, string_agg('Dialogue: 0,' || {ass_time('start_ms')} || ',' || {ass_time('end_ms')} || ',' || style || ',,0,0,0,,' || text, chr(10) ORDER BY event_no) AS x
      FROM events GROUP BY media_id) e USING (media_id)""")
def export_ass(spark, sf_dir):
    return ass_sink.export_ass(derived.conversation_segments(spark, sf_dir), {"speaker_colors": True})


_POINTS = ", pt AS (SELECT media_id, idx AS point_id, greatest(end_ms - (idx % 5) * 100 + 150, 0) AS at_ms FROM seg)"


def _points(o):
    return o.df.select("media_id", F.col("idx").alias("point_id"), F.expr("greatest(end_ms - (idx % 5) * 100 + 150, 0)").alias("at_ms"))


@query("visible_at", SEG + _POINTS + """
SELECT p.media_id, p.point_id, p.at_ms, min(s.idx) AS seg_idx FROM pt p
LEFT JOIN seg s ON s.media_id = p.media_id AND s.start_ms <= p.at_ms AND p.at_ms < s.end_ms GROUP BY ALL""")
def visible_at(spark, sf_dir):
    o = derived.conversation_segments(spark, sf_dir)
    return iv.visible_at(_points(o), o.df)


@query("text_at", SEG + _POINTS + f"""
SELECT p.media_id, p.point_id, p.at_ms, coalesce(string_agg(s.text, chr(10) ORDER BY s.start_ms, s.idx), '') AS shown FROM pt p
LEFT JOIN seg s ON s.media_id = p.media_id AND s.start_ms <= p.at_ms AND p.at_ms < s.end_ms AND {strip('s.text')} <> '' GROUP BY ALL""")
def text_at(spark, sf_dir):
    o = derived.conversation_segments(spark, sf_dir)
    return iv.text_at(_points(o), o.df)


@query("snap_edges", SEG + """,
 mv AS (SELECT media_id, idx, start_ms + 170 AS ns, end_ms + 170 AS ne FROM seg),
 ed AS (SELECT media_id, idx, 0 AS edge_no, 'start' AS edge, ns AS t0 FROM mv UNION ALL SELECT media_id, idx, 1, 'end', ne FROM mv),
 cand AS (SELECT media_id, idx AS owner, idx * 2 AS cand_no, 'head' AS label, start_ms AS cand_ms FROM seg
          UNION ALL SELECT media_id, idx, idx * 2 + 1, 'tail', end_ms FROM seg
          UNION ALL SELECT DISTINCT media_id, 0, 0, 'origin', 0 FROM seg),
 best AS (SELECT e.media_id, e.idx, arg_min({'edge': edge, 'label': label, 'snap_ms': cand_ms, 'dist': abs(t0 - cand_ms)}, (abs(t0 - cand_ms), edge_no, cand_no)) AS b
          FROM ed e JOIN cand c ON c.media_id = e.media_id AND c.owner <> e.idx AND abs(t0 - cand_ms) <= 250 GROUP BY e.media_id, e.idx)
SELECT m.media_id, m.idx, b.edge AS edge, b.label AS label, b.snap_ms AS snap_ms, b.dist AS dist FROM mv m LEFT JOIN best USING (media_id, idx)""")
def snap_edges(spark, sf_dir):
    o = derived.conversation_segments(spark, sf_dir)
    moves = o.df.select(
        "media_id", "idx", F.lit("both").alias("mode"), (F.col("start_ms") + 170).alias("new_start_ms"), (F.col("end_ms") + 170).alias("new_end_ms")
    )
    return iv.snap_edges(moves, o.df, threshold_ms=250)


@query("lane_layout", SEG + """,
 it AS (SELECT media_id, idx, start_ms AS s, greatest(end_ms + 2500 * (idx % 3), start_ms + 10) AS held,
               row_number() OVER (PARTITION BY media_id ORDER BY start_ms, end_ms + 2500 * (idx % 3), idx) AS pos FROM seg),
 ln AS (
   SELECT media_id, idx, pos, CAST(0 AS BIGINT) AS lane, [held] AS ends FROM it WHERE pos = 1
   UNION ALL
   SELECT i.media_id, i.idx, i.pos, k - 1, l.ends[1:k - 1] || [i.held] || l.ends[k + 1:]
   FROM ln l JOIN it i ON i.media_id = l.media_id AND i.pos = l.pos + 1,
        LATERAL (SELECT CAST(coalesce(nullif(list_position([e <= i.s + 1 for e in l.ends], true), 0), len(l.ends) + 1) AS BIGINT) AS k) z)
SELECT media_id, idx, lane FROM ln""")
def lane_layout(spark, sf_dir):
    o = derived.conversation_segments(spark, sf_dir)
    return iv.lane_layout(o.with_columns({"end_ms": F.col("end_ms") + 2500 * (F.col("idx") % 3)}))


@query("max_concurrency", SEG + """,
 ed AS (SELECT media_id, start_ms AS t0, 1 AS d FROM seg WHERE end_ms > start_ms UNION ALL SELECT media_id, end_ms, -1 FROM seg WHERE end_ms > start_ms)
SELECT media_id, CAST(max(n) AS BIGINT) AS lanes FROM (SELECT media_id, sum(d) OVER (PARTITION BY media_id ORDER BY t0 RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM ed) GROUP BY media_id""")
def max_concurrency(spark, sf_dir):
    return iv.max_concurrency(derived.conversation_segments(spark, sf_dir))


_CLIPS = """,
 clip AS (SELECT DISTINCT media_id, unnest([1, 2]) AS clip_id, 10000 AS lo, 70000 AS hi FROM seg),
 clips AS (SELECT media_id, clip_id, lo + (clip_id - 1) * 45000 AS lo, hi + (clip_id - 1) * 45000 AS hi FROM clip),
 fc AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, end_ms, idx) AS n
        FROM (SELECT media_id, idx, start_ms, end_ms, speaker, """ + strip("text") + """ AS text FROM seg) WHERE text <> '' AND end_ms > start_ms),
 rb AS (SELECT f.media_id, c.clip_id, n AS idx, """ + pad("n", 4, "clip_seg_") + """ AS id, greatest(start_ms, lo) - lo AS start_ms, least(end_ms, hi) - lo AS end_ms, speaker, text
        FROM fc f JOIN clips c ON c.media_id = f.media_id AND f.start_ms < c.hi AND f.end_ms > c.lo)"""


def _clips(o):
    media = o.df.select("media_id").distinct()
    two = media.select("media_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("clip_id"))
    shift = (F.col("clip_id") - 1) * 45_000
    return two.withColumn("clip_start_ms", (F.lit(10_000) + shift).cast("bigint")).withColumn("clip_end_ms", (F.lit(70_000) + shift).cast("bigint"))


@query("rebase_to_clips", SEG + _CLIPS + "SELECT * FROM rb")
def rebase_to_clips(spark, sf_dir):
    o = derived.conversation_segments(spark, sf_dir)
    return iv.rebase_to_clips(o, _clips(o))


def _sec(x):
    return f"to_json(({x})::DOUBLE / 1000.0)"


@query("clip_metadata", SEG + _CLIPS + f"""
SELECT c.media_id, c.clip_id, '{{"source_media":"media_' || c.media_id || '","source_start":' || {_sec('lo')} || ',"source_end":' || {_sec('hi')} || ',"duration":' || {_sec('hi - lo')}
       || ',"clip_timeline_start":0.0,"clip_timeline_end":' || {_sec('hi - lo')} || ',"segments":[' || s.x || ']}}' AS json
FROM clips c JOIN (SELECT media_id, clip_id, string_agg('{{"id":' || to_json(id) || ',"start":' || {_sec('start_ms')} || ',"end":' || {_sec('end_ms')} || ',"speaker":' || to_json(speaker)
                          || ',"text":' || to_json(text) || '}}', ',' ORDER BY idx) AS x FROM rb GROUP BY media_id, clip_id) s USING (media_id, clip_id)""")
def clip_metadata(spark, sf_dir):
    o = derived.conversation_segments(spark, sf_dir)
    clips = _clips(o)
    media = o.df.select("media_id").distinct().withColumn("media_name", F.concat(F.lit("media_"), "media_id"))
    return file_sink.clip_metadata(iv.rebase_to_clips(o, clips), clips, media)


@query("speaker_dimension", SEG + """
SELECT media_id, speaker, row_number() OVER (PARTITION BY media_id ORDER BY speaker) - 1 AS rank, CASE WHEN speaker = 'S02' THEN 'Guest' ELSE speaker END AS name
FROM (SELECT DISTINCT media_id, speaker FROM seg)""")
def speaker_dimension(spark, sf_dir):
    o = derived.conversation_segments(spark, sf_dir)
    names = o.df.filter("speaker = 'S02'").select("media_id", "speaker").distinct().withColumn("name", F.lit("Guest"))
    return iv.speaker_dimension(o, names)
