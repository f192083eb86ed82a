"""Pieces of the SQL twins: the derived inputs and the scalar rules, in DuckDB's dialect."""

from __future__ import annotations

WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

_TAIL = """
 l AS (SELECT media_id, turn, pos, speaker, raw FROM p WHERE raw <> ''),
 n AS (SELECT *, CAST(row_number() OVER (PARTITION BY media_id ORDER BY turn, pos) AS BIGINT) AS idx FROM l),
 d AS (SELECT *, 300 + 55 * CAST(length(raw) AS BIGINT) AS dur,
              ((media_id * 7 + idx * 13) % 11) * 150 - 300
              + CASE WHEN idx % 41 = 0 THEN 15000 WHEN idx % 17 = 0 THEN 2000 ELSE 0 END AS gap FROM n),
 t AS (SELECT *, CAST(sum(dur + gap) OVER (PARTITION BY media_id ORDER BY idx
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum FROM d),
 seg AS (SELECT media_id, idx, greatest(cum - dur, 0) AS start_ms, greatest(cum, 0) AS end_ms,
                speaker, raw AS text FROM t)"""

SEG = (
    """WITH RECURSIVE q AS (
  SELECT conv_id AS media_id, turn,
         CASE role WHEN 'user' THEN 'S01' WHEN 'assistant' THEN 'S02' ELSE 'S03' END AS speaker,
         string_split(replace(text, '. ', concat('.', chr(10))), chr(10)) AS a
  FROM conversations),
 p AS (SELECT media_id, turn, speaker,
              CAST(generate_subscripts(a, 1) - 1 AS BIGINT) AS pos, unnest(a) AS raw FROM q),"""
    + _TAIL
)

DOC_SEG = (
    """WITH RECURSIVE q AS (
  SELECT doc_id AS media_id, CAST(0 AS BIGINT) AS turn, 'S00' AS speaker,
         string_split(replace(text, '. ', concat('.', chr(10))), chr(10)) AS a
  FROM documents),
 p AS (SELECT media_id, turn, speaker,
              CAST(generate_subscripts(a, 1) - 1 AS BIGINT) AS pos, unnest(a) AS raw FROM q),"""
    + _TAIL
)


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def half_even_cs(ms: str) -> str:
    return (
        f"(({ms}) // 10 + CASE WHEN ({ms}) % 10 > 5 OR (({ms}) % 10 = 5 AND (({ms}) // 10) % 2 = 1) THEN 1 ELSE 0 END)"
    )


def seconds_text(ms: str) -> str:
    cs = half_even_cs(ms)
    return f"({cs} // 100)::VARCHAR || '.' || lpad(({cs} % 100)::VARCHAR, 2, '0')"


def srt_time(ms: str) -> str:
    p = lambda e, n: f"lpad(({e})::VARCHAR, greatest({n}, length(({e})::VARCHAR))::INTEGER, '0')"
    return (
        f"{p(f'({ms}) // 3600000', 2)} || ':' || {p(f'(({ms}) % 3600000) // 60000', 2)} || ':' || "
        f"{p(f'(({ms}) % 60000) // 1000', 2)} || ',' || {p(f'({ms}) % 1000', 3)}"
    )


def ass_time(ms: str) -> str:
    cs = half_even_cs(ms)
    p = lambda e: f"lpad(({e})::VARCHAR, 2, '0')"
    return (
        f"(({cs}) // 360000)::VARCHAR || ':' || {p(f'(({cs}) % 360000) // 6000')} || ':' || "
        f"{p(f'(({cs}) % 6000) // 100')} || '.' || {p(f'({cs}) % 100')}"
    )


def pad(n: str, width: int, prefix: str) -> str:
    return f"'{prefix}' || lpad(({n})::VARCHAR, greatest({width}, length(({n})::VARCHAR))::INTEGER, '0')"


# Prepared (C2) rows in time order with a dense position.
PREP = f""",
 c AS (SELECT media_id, idx, {pad('idx', 4, 'seg_')} AS id, greatest(start_ms, 0) AS start_ms,
              greatest(end_ms, greatest(start_ms, 0)) AS end_ms, speaker, {strip('text')} AS text FROM seg),
 prep AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, end_ms, idx) AS pos FROM c WHERE text <> '')"""


def sweep(name: str, source: str, d: int = 1000) -> str:
    """The cursor sweep of the overlap repair, row by row."""
    return f""",
 {name} AS (
   SELECT media_id, idx, id, greatest(start_ms, 0) AS start_ms, greatest(end_ms, greatest(start_ms, 0) + {d}) AS end_ms,
          speaker, text, pos
   FROM {source} WHERE pos = 1
   UNION ALL
   SELECT s.media_id, s.idx, s.id, greatest(s.start_ms, f.end_ms), greatest(s.end_ms, greatest(s.start_ms, f.end_ms) + {d}),
          s.speaker, s.text, s.pos
   FROM {name} f JOIN {source} s ON s.media_id = f.media_id AND s.pos = f.pos + 1)"""


def ascii_gap(left: str, right: str) -> str:
    return f"(CASE WHEN regexp_matches(right({left}, 1), '^[\\x00-\\x7F]') AND regexp_matches({right}, '^[\\x00-\\x7F]') THEN ' ' ELSE '' END)"


MERGED = f""",
 m AS (
   SELECT media_id, idx, id, start_ms, end_ms, speaker, text, pos, CAST(1 AS BIGINT) AS unit FROM fixed WHERE pos = 1
   UNION ALL
   SELECT s.media_id, CASE WHEN k THEN m.idx ELSE s.idx END, CASE WHEN k THEN m.id ELSE s.id END,
          CASE WHEN k THEN m.start_ms ELSE s.start_ms END, CASE WHEN k THEN greatest(m.end_ms, s.end_ms) ELSE s.end_ms END,
          s.speaker, CASE WHEN k THEN m.text || {ascii_gap('m.text', 's.text')} || s.text ELSE s.text END,
          s.pos, CASE WHEN k THEN m.unit ELSE m.unit + 1 END
   FROM m JOIN fixed s ON s.media_id = m.media_id AND s.pos = m.pos + 1,
        LATERAL (SELECT m.speaker = s.speaker AND s.start_ms - m.end_ms BETWEEN 0 AND 300
                 AND length(m.text || {ascii_gap('m.text', 's.text')} || s.text) <= 48 AS k) z),
 merged AS (SELECT media_id, arg_max(idx, pos) AS idx, arg_max(id, pos) AS id, arg_max(start_ms, pos) AS start_ms,
                   arg_max(end_ms, pos) AS end_ms, arg_max(speaker, pos) AS speaker, arg_max(text, pos) AS text, unit AS pos
            FROM m GROUP BY media_id, unit)"""

_CUTS = "[。！？!?；;，,、 ]"
# Cut a text one character at a time, then pack short pieces.
SPLIT = f""",
 long AS (SELECT media_id, pos, text, length(text) AS n FROM merged WHERE end_ms - start_ms > 6000 OR length(text) > 24),
 cuts AS (
   SELECT media_id, pos, text, n, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS held, CAST(0 AS BIGINT) AS piece FROM long WHERE n > 24
   UNION ALL
   SELECT media_id, pos, text, n, i + 1,
          CASE WHEN held + 1 >= 24 OR (held + 1 >= 12 AND regexp_matches(substring(text, i + 1, 1), '{_CUTS}')) THEN 0 ELSE held + 1 END,
          CASE WHEN held + 1 >= 24 OR (held + 1 >= 12 AND regexp_matches(substring(text, i + 1, 1), '{_CUTS}')) THEN piece + 1 ELSE piece END
   FROM cuts WHERE i < n),
 chars AS (SELECT media_id, pos, i, CASE WHEN held = 0 THEN piece - 1 ELSE piece END AS piece, substring(text, i, 1) AS ch FROM cuts WHERE i > 0),
 pieces0 AS (SELECT media_id, pos, piece, {strip("string_agg(ch, '' ORDER BY i)")} AS t FROM chars GROUP BY media_id, pos, piece),
 pieces AS (SELECT media_id, pos, t, row_number() OVER (PARTITION BY media_id, pos ORDER BY piece) AS k FROM pieces0 WHERE t <> ''),
 pack AS (
   SELECT media_id, pos, k, t, CAST(1 AS BIGINT) AS g FROM pieces WHERE k = 1
   UNION ALL
   SELECT p.media_id, p.pos, p.k, CASE WHEN length(a.t) + length(p.t) <= 24 THEN a.t || {ascii_gap('a.t', 'p.t')} || p.t ELSE p.t END,
          CASE WHEN length(a.t) + length(p.t) <= 24 THEN a.g ELSE a.g + 1 END
   FROM pack a JOIN pieces p ON p.media_id = a.media_id AND p.pos = a.pos AND p.k = a.k + 1),
 chunks AS (SELECT media_id, pos, g, arg_max(t, k) AS t FROM pack GROUP BY media_id, pos, g),
 sized AS (SELECT *, count(*) OVER (PARTITION BY media_id, pos) AS cnt, sum(length(t)) OVER (PARTITION BY media_id, pos) AS total FROM chunks),
 timed AS (
   SELECT z.media_id, z.pos, z.g, z.t, z.cnt, x.start_ms::DOUBLE AS s,
          greatest(CASE WHEN z.cnt = 1 THEN x.end_ms::DOUBLE
                        ELSE least(x.start_ms::DOUBLE + greatest(1000.0::DOUBLE, (x.end_ms - x.start_ms)::DOUBLE * (length(z.t)::DOUBLE / z.total::DOUBLE)),
                                   x.end_ms::DOUBLE - 1000.0::DOUBLE * (z.cnt - 1)::DOUBLE) END, x.start_ms::DOUBLE + 1000.0::DOUBLE) AS e
   FROM sized z JOIN merged x USING (media_id, pos) WHERE g = 1 AND cnt > 1
   UNION ALL
   SELECT z.media_id, z.pos, z.g, z.t, z.cnt, a.e,
          greatest(CASE WHEN z.cnt = z.g THEN x.end_ms::DOUBLE
                        ELSE least(a.e + greatest(1000.0::DOUBLE, (x.end_ms - x.start_ms)::DOUBLE * (length(z.t)::DOUBLE / z.total::DOUBLE)),
                                   x.end_ms::DOUBLE - 1000.0::DOUBLE * (z.cnt - z.g)::DOUBLE) END, a.e + 1000.0::DOUBLE)
   FROM timed a JOIN sized z ON z.media_id = a.media_id AND z.pos = a.pos AND z.g = a.g + 1 JOIN merged x ON x.media_id = z.media_id AND x.pos = z.pos),
 cut AS (
   SELECT x.media_id, x.idx, x.id || '_' || t.g AS id, CAST(floor(t.s + 0.5) AS BIGINT) AS start_ms, CAST(floor(t.e + 0.5) AS BIGINT) AS end_ms,
          x.speaker, t.t AS text, x.pos AS p1, t.g AS p2
   FROM timed t JOIN merged x USING (media_id, pos)
   UNION ALL
   SELECT x.media_id, x.idx, x.id, x.start_ms, x.end_ms, x.speaker, x.text, x.pos, 1
   FROM merged x WHERE NOT EXISTS (SELECT 1 FROM timed t WHERE t.media_id = x.media_id AND t.pos = x.pos)),
 split AS (SELECT media_id, idx, id, start_ms, end_ms, speaker, text, row_number() OVER (PARTITION BY media_id ORDER BY p1, p2) AS pos FROM cut)"""

NORMAL = PREP + sweep("fixed", "prep") + MERGED + SPLIT + sweep("norm", "split")
