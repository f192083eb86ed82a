"""Queries over highlight clips."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuesheet.functions import text as tx
from cuesheet.operators import clips as cl
from cuesheet.plans import derived
from cuesheet.queries.registry import Registry
from cuesheet.queries.sql import SEG, WS, ascii_gap, half_even_cs, pad, strip
from cuesheet.session import materialise

query = Registry()


def _hits(text, patterns):
    return " + ".join("contains(lower({}), '{}')::INT".format(text, p.replace("'", "''")) for p in patterns)


_TITLE = f"CASE WHEN length(z) = 0 THEN 'Untitled clip' WHEN length(z) <= 34 THEN z ELSE regexp_replace(left(z, 34), '{WS}+$', '') || '...' END"
_SQUEEZE = lambda x: strip(f"regexp_replace({x}, '{WS}+', ' ', 'g')")

# Every window is built and scored from its own text, row by row.
WINDOWS = f""",
 fc AS (SELECT media_id, id, start_ms, end_ms, text, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, end_ms, idx) AS pos
        FROM (SELECT media_id, idx, {pad('idx', 4, 'seg_')} AS id, start_ms, end_ms, {strip('text')} AS text FROM seg) WHERE text <> '' AND end_ms > start_ms),
 ff AS (SELECT *, lag(end_ms) OVER w AS pe, {ascii_gap('(lag(text) OVER w)', 'text')} AS sep FROM fc WINDOW w AS (PARTITION BY media_id ORDER BY pos)),
 gi AS (SELECT *, sum(CASE WHEN start_ms - pe > 12000 THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY pos) AS island FROM ff),
 pr AS (SELECT a.media_id, a.pos AS i, b.pos AS j, a.start_ms AS s, b.end_ms AS e, max(b.end_ms) OVER (PARTITION BY a.media_id, a.pos ORDER BY b.pos) AS latest,
               string_agg(CASE WHEN a.pos = b.pos THEN b.text ELSE b.sep || b.text END, '') OVER (PARTITION BY a.media_id, a.pos ORDER BY b.pos) AS text,
               sum(CASE WHEN b.pos > a.pos AND b.start_ms - b.pe BETWEEN 450 AND 4000 THEN 1 ELSE 0 END) OVER (PARTITION BY a.media_id, a.pos ORDER BY b.pos) AS pauses,
               b.text AS last_text
        FROM gi a JOIN gi b ON b.media_id = a.media_id AND b.island = a.island AND b.pos >= a.pos AND b.start_ms <= a.start_ms + 180000),
 pw AS (SELECT * FROM pr WHERE latest <= s + 180000 AND e - s >= 45000),
 ct AS (SELECT *, {_hits('text', cl.HOOKS)} AS hooks, {_hits('last_text', cl.ENDINGS)} AS endings,
               len(regexp_extract_all(text, '[?？]')) AS questions, len(regexp_extract_all(text, '[!！?？。]')) AS puncts,
               regexp_matches(last_text, '[.!?。！？]$') AS complete, greatest(0.1::DOUBLE, (e - s)::DOUBLE / 1000.0::DOUBLE) AS dur FROM pw),
 cand AS (SELECT media_id, i - 1 AS i, j - 1 AS j, s AS from_ms, e AS to_ms, {half_even_cs('s')} * 10 AS start_ms, {half_even_cs('e')} * 10 AS end_ms, hooks, endings, questions, text,
            floor((20.0::DOUBLE + hooks::DOUBLE * 4.0::DOUBLE + endings::DOUBLE * 3.0::DOUBLE + CASE WHEN questions > 0 THEN 8.0::DOUBLE ELSE 0.0::DOUBLE END
              + least(8.0::DOUBLE, puncts::DOUBLE * 1.4::DOUBLE) + least(6.0::DOUBLE, pauses::DOUBLE * 1.5::DOUBLE)
              + least(26.0::DOUBLE, length(text)::DOUBLE / greatest(dur, 1.0::DOUBLE) * 7.0::DOUBLE)
              + greatest(0.0::DOUBLE, 22.0::DOUBLE - abs(dur - 120.0::DOUBLE) / 120.0::DOUBLE * 22.0::DOUBLE)
              + CASE WHEN complete THEN 10.0::DOUBLE ELSE 3.0::DOUBLE END) * 100 + 0.5) / 100.0::DOUBLE AS score FROM ct)"""

KEPT = """,
 rk AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY score DESC, i, j) AS r FROM cand),
 nms AS (
   SELECT media_id, r, [{'s': start_ms, 'e': end_ms, 'i': i, 'j': j}] AS kept FROM rk WHERE r = 1
   UNION ALL
   SELECT k.media_id, k.r, CASE WHEN len([x FOR x IN n.kept IF least(x.e, k.end_ms) > greatest(x.s, k.start_ms)
              AND (least(x.e, k.end_ms) - greatest(x.s, k.start_ms)) * 100 > greatest(1000, least(x.e - x.s, k.end_ms - k.start_ms)) * 65]) > 0
            THEN n.kept ELSE n.kept || [{'s': k.start_ms, 'e': k.end_ms, 'i': k.i, 'j': k.j}] END
   FROM nms n JOIN rk k ON k.media_id = n.media_id AND k.r = n.r + 1),
 lastk AS (SELECT media_id, unnest(arg_max(kept, r)) AS x FROM nms GROUP BY media_id),
 kept AS (SELECT c.* FROM lastk l JOIN cand c ON c.media_id = l.media_id AND c.i = l.x.i AND c.j = l.x.j),
 tk AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY score DESC, i, j) AS rank FROM kept)"""

CLIPS = (
    KEPT
    + f""",
 clip AS (SELECT media_id, {pad('rank', 3, 'clip_')} AS id, rank, start_ms, end_ms, score, {_TITLE} AS title,
   ((to_ms - from_ms) // 1000 + CASE WHEN (to_ms - from_ms) % 1000 > 500 OR ((to_ms - from_ms) % 1000 = 500 AND ((to_ms - from_ms) // 1000) % 2 = 1) THEN 1 ELSE 0 END) || 's'
     || CASE WHEN hooks > 0 THEN ', hook' ELSE '' END || CASE WHEN questions > 0 THEN ', question' ELSE '' END || CASE WHEN endings > 0 THEN ', clear ending' ELSE '' END
     || CASE WHEN hooks + questions + endings = 0 THEN ', dense transcript window' ELSE '' END AS reason,
   left(text, 700) AS text, i, j FROM (SELECT *, {_SQUEEZE('text')} AS z FROM tk WHERE rank <= 24))"""
)

_SCORED = ["media_id", "i", "j", "start_ms", "end_ms", "score"]


@query("clip_windows", SEG + WINDOWS + "SELECT media_id, i, j, start_ms, end_ms, score FROM cand")
def clip_windows(spark, sf_dir):
    cands, _ = cl.candidate_windows(derived.conversation_segments(spark, sf_dir))
    return cands.select(*_SCORED)


@query("clip_overlap_removal", SEG + WINDOWS + KEPT + "SELECT media_id, i, j, start_ms, end_ms, score FROM kept")
def clip_overlap_removal(spark, sf_dir):
    kept, _ = cl.kept_windows(derived.conversation_segments(spark, sf_dir))
    return kept.select(*_SCORED)


@query("clip_candidates", SEG + WINDOWS + CLIPS + """
SELECT c.media_id, c.id, c.rank, c.start_ms, c.end_ms, c.score, c.title, c.reason, c.text, string_agg(f.id, ',' ORDER BY f.pos) AS segment_ids, 'rules' AS selection_method
FROM clip c JOIN fc f ON f.media_id = c.media_id AND f.pos - 1 BETWEEN c.i AND c.j GROUP BY ALL""")
def clip_candidates(spark, sf_dir):
    out = cl.clip_candidates(derived.conversation_segments(spark, sf_dir))
    return out.withColumn("segment_ids", F.array_join("segment_ids", ","))


@query("clip_candidates_documents")
def clip_candidates_documents(spark, sf_dir):
    """The heaviest plan: all documents read as single-speaker media."""
    out = cl.clip_candidates(derived.document_segments(spark, sf_dir))
    return out.withColumn("segment_ids", F.array_join("segment_ids", ","))


@query("clip_ranking", SEG + WINDOWS + CLIPS + """,
 picks AS (SELECT media_id, 1000 - rank AS pick_no, id, CAST((rank * 37) % 130 AS DOUBLE) AS score, CASE WHEN rank % 2 = 0 THEN 'picked ' || id ELSE '' END AS title, '' AS reason
           FROM clip WHERE rank % 3 = 1 UNION ALL SELECT DISTINCT media_id, 0, 'clip_999', 50.0, 'x', 'y' FROM clip),
 hit AS (SELECT c.media_id, c.id, c.start_ms, c.end_ms, p.score AS ps, p.title AS pt, c.title AS ct, row_number() OVER (PARTITION BY c.media_id ORDER BY p.pick_no) AS place
         FROM clip c JOIN picks p USING (media_id, id))
SELECT media_id, id, start_ms, end_ms, place, greatest(0.0::DOUBLE, least(100.0::DOUBLE, ps)) AS score, CASE WHEN pt <> '' THEN pt ELSE ct END AS title, '模型精选' AS reason, 'model' AS selection_method
FROM hit WHERE place <= 24""")
def clip_ranking(spark, sf_dir):
    clips = cl.clip_candidates(derived.conversation_segments(spark, sf_dir))
    cands = materialise(clips.select("media_id", "id", "rank", "start_ms", "end_ms", "score", "title", "reason", "selection_method"))
    picks = cands.filter("rank % 3 = 1").selectExpr(
        "media_id", "1000 - rank pick_no", "id", "double((rank * 37) % 130) score", "if(rank % 2 = 0, concat('picked ', id), '') title", "'' reason"
    )
    unknown = cands.select("media_id").distinct().selectExpr("media_id", "0L pick_no", "'clip_999' id", "50.0D score", "'x' title", "'y' reason")
    return cl.apply_ranking(cands.drop("rank"), picks.unionByName(unknown), limit=24)


@query("clip_ranking_outcomes", SEG + WINDOWS + CLIPS + """,
 picks AS (SELECT media_id, CASE WHEN media_id % 4 = 1 THEN 'clip_9' || right(id, 2) ELSE id END AS id FROM clip WHERE media_id % 4 <> 0 AND rank % 2 = 1
           UNION ALL SELECT media_id, id FROM clip WHERE media_id % 4 = 2),
 given AS (SELECT p.media_id, count(*) AS picks, count(c.id) AS valid FROM picks p LEFT JOIN clip c USING (media_id, id) GROUP BY p.media_id),
 known AS (SELECT media_id, count(*) AS candidates FROM clip GROUP BY media_id)
SELECT media_id, candidates, coalesce(picks, 0) AS picks, least(coalesce(valid, 0), 24) AS valid, CASE WHEN coalesce(valid, 0) = 0 THEN 'no pick names a candidate' END AS error FROM known LEFT JOIN given USING (media_id)""")
def clip_ranking_outcomes(spark, sf_dir):
    """Media whose picks name other clips, some twice, or that have no picks."""
    cands = materialise(cl.clip_candidates(derived.conversation_segments(spark, sf_dir)).select("media_id", "id", "rank"))
    some = cands.filter("media_id % 4 <> 0 and rank % 2 = 1").selectExpr("media_id", "if(media_id % 4 = 1, concat('clip_9', right(id, 2)), id) id")
    return cl.ranking_outcomes(cands, some.unionByName(cands.filter("media_id % 4 = 2").select("media_id", "id")), limit=24)


@query("clip_title_reason", SEG + f"""
SELECT media_id, idx, {_TITLE} AS title, {_hits('text', cl.HOOKS)} AS hooks, {_hits('text', cl.ENDINGS)} AS endings FROM (SELECT *, {_SQUEEZE('text')} AS z FROM seg)""")
def clip_title_reason(spark, sf_dir):
    t = F.col("text")
    return derived.conversation_segments(spark, sf_dir).df.select(
        "media_id", "idx", cl.clip_title(t).alias("title"), cl.pattern_hits(t, cl.HOOKS).alias("hooks"), cl.pattern_hits(t, cl.ENDINGS).alias("endings")
    )


@query("clip_requests", SEG + """
SELECT media_id, idx, greatest(start_ms - 500, 0) AS start_ms, greatest(greatest(start_ms - 500, 0) + 250, CASE WHEN idx % 4 = 0 THEN start_ms ELSE end_ms END) AS end_ms,
       (start_ms + 50) // 100 * 100 AS queued_start_ms,
       (greatest(start_ms + 250, CASE WHEN idx % 3 = 0 OR end_ms = 0 THEN start_ms + CASE WHEN idx % 2 = 0 THEN 120000 ELSE greatest(250, 40 * idx) END ELSE end_ms END) + 50) // 100 * 100 AS queued_end_ms FROM seg""")
def clip_requests(spark, sf_dir):
    o = derived.conversation_segments(spark, sf_dir)
    start, end = cl.normal_clip_request(F.col("start_ms") - 500, F.expr("if(idx % 4 = 0, start_ms, end_ms)"))
    qs, qe = cl.normal_queued_clip(F.col("start_ms"), F.expr("if(idx % 3 = 0, null, end_ms)"), F.expr("if(idx % 2 = 0, null, 40 * idx)"))
    return o.df.select("media_id", "idx", start.alias("start_ms"), end.alias("end_ms"), qs.alias("queued_start_ms"), qe.alias("queued_end_ms"))
