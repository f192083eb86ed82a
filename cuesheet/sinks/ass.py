"""ASS subtitle files: header, style rows, events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuesheet.functions import times as tm
from cuesheet.operators.intervals import flatten_overlaps, speaker_dimension, speaker_style
from cuesheet.ordering import Ordered, as_ordered
from cuesheet.sinks.subtitles import joined
from cuesheet.sources.records import STYLE_DEFAULTS

# Fixed values of the file format.
PALETTE = [
    "&H00FFFFFF", "&H005BE7FF", "&H0086F28F", "&H00BBA7FF", "&H0000D7FF", "&H00FFB56B", "&H00FF8EDB", "&H00D8D8D8",
]
STYLE_FIELDS = (
    "Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, "
    "StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding"
)
EVENT_FIELDS = "Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text"


def default_font_size(height: int) -> int:
    return max(24, round(height * 0.045))


def _style_line(name, colour, style: dict, font_size: int):
    fixed = [
        f",{style['font_name']},{font_size},",
        f",&H000000FF,{style['outline_color']},{style['back_color']},0,0,0,0,100,100,0,0,1,"
        f"{style['outline']},{style['shadow']},{style['alignment']},48,48,{style['margin_v']},1",
    ]
    return F.concat(F.lit("Style: "), name, F.lit(fixed[0]), colour, F.lit(fixed[1]))


def style_rows(rows: DataFrame | Ordered, style: dict | None = None, height: int = 1080) -> DataFrame:
    """(media_id, style_no, line): Default first, then one per sorted speaker."""
    style = {**STYLE_DEFAULTS, **(style or {})}
    size = style.get("font_size") or default_font_size(height)
    o = as_ordered(rows)
    media = o.df.select("media_id").distinct()
    base = media.select(
        "media_id", F.lit(0).cast("bigint").alias("style_no"),
        _style_line(F.lit("Default"), F.lit(style["primary_color"]), style, size).alias("line"),
    )
    if not style["speaker_colors"]:
        return base
    speakers = speaker_dimension(o)
    colour = F.element_at(F.array(*[F.lit(c) for c in PALETTE]), (F.col("rank") % len(PALETTE) + 1).cast("int"))
    own = speakers.select(
        "media_id", (F.col("rank") + 1).alias("style_no"), _style_line(speaker_style(F.col("speaker")), colour, style, size).alias("line")
    )
    return base.unionByName(own)


def export_ass(
    rows: DataFrame | Ordered, style: dict | None = None, *, width: int = 1920, height: int = 1080, names: DataFrame | None = None
) -> DataFrame:
    """One ASS text per media."""
    style = {**STYLE_DEFAULTS, **(style or {})}
    o = as_ordered(rows)
    events = flatten_overlaps(o, show_speaker=style["show_speaker"], speaker_colors=style["speaker_colors"], names=names)
    line = F.concat(
        F.lit("Dialogue: 0,"), tm.ass_time(F.col("start_ms")), F.lit(","), tm.ass_time(F.col("end_ms")), F.lit(","), "style", F.lit(",,0,0,0,,"), "text"
    )
    styles = joined(style_rows(o, style, height), ["media_id"], "style_no", F.col("line"), "\n").withColumnRenamed("text", "styles")
    lines = joined(events, ["media_id"], "event_no", line, "\n").withColumnRenamed("text", "events")
    head = (
        f"[Script Info]\nScriptType: v4.00+\nWrapStyle: 2\nScaledBorderAndShadow: yes\nPlayResX: {width}\nPlayResY: {height}\n\n"
        f"[V4+ Styles]\nFormat: {STYLE_FIELDS}\n"
    )
    text = F.concat(
        F.lit(head), "styles", F.lit(f"\n\n[Events]\nFormat: {EVENT_FIELDS}\n"), F.coalesce(F.concat("events", F.lit("\n")), F.lit(""))
    )
    return styles.join(lines, "media_id", "left").select("media_id", text.alias("ass"))
