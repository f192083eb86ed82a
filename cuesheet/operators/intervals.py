"""Interval joins and sweeps within one media.

Spark has no range join, so intervals meet points, and one another, through equal keys with
the exact predicate as residual.  The keys are cells of a grid with one level per power of
two: an interval lies at the level whose cells are just as wide as it is long, where it
touches at most two of them, whether it lasts a second or ten years.  A probe asks its own cell at
each level that is in use.  Nearly all segments fit the cells of level 0; every further level costs
the probes a row each, and the intervals nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesheet.functions import text as tx
from cuesheet.operators.segments import number_id, prepare_for_clips
from cuesheet.ordering import POS, Ordered, arrange

BASE_BITS = 15  # cells of level 0 are 2**15 ms wide


def bucket(ms: Column, width: int) -> Column:
    return F.floor(ms / F.lit(width)).cast("bigint")


def grid_level(lo: Column, hi: Column, base_bits: int = BASE_BITS) -> Column:
    """The lowest level whose cells are at least as wide as the interval ``lo <= t < hi``."""
    return F.greatest(F.length(F.bin(hi - lo - 1)) - base_bits, F.lit(0))


def cell(at: Column, level: Column, base_bits: int = BASE_BITS) -> Column:
    return F.call_function("shiftright", at.cast("bigint"), level + base_bits)


def cells(lo: Column, hi: Column, level: Column, base_bits: int = BASE_BITS) -> Column:
    """The one or two cells that an interval touches at its own level or a higher one."""
    return F.array_distinct(F.array(cell(lo, level, base_bits), cell(hi - 1, level, base_bits)))


def points_in_intervals(points: DataFrame, intervals: DataFrame, at: str, lo: str, hi: str, *, base_bits: int = BASE_BITS) -> DataFrame:
    """Pairs with ``lo <= at < hi`` in the same media, each once.  Other column names must differ."""
    i = intervals.filter(F.col(hi) > F.col(lo)).withColumn("_l", grid_level(F.col(lo), F.col(hi), base_bits))
    in_use = i.agg(F.collect_set("_l")).scalar()
    i = i.withColumn("_c", F.explode(cells(F.col(lo), F.col(hi), F.col("_l"), base_bits))).withColumnRenamed("media_id", "_m")
    p = points.withColumn("_level", F.explode(in_use)).withColumn("_cell", cell(F.col(at), F.col("_level"), base_bits))
    same = (F.col("media_id") == F.col("_m")) & (F.col("_level") == F.col("_l")) & (F.col("_cell") == F.col("_c"))
    return p.join(i, same & (F.col(lo) <= F.col(at)) & (F.col(at) < F.col(hi))).drop("_m", "_l", "_c", "_level", "_cell")


def overlapping(left: DataFrame, right: DataFrame, lo: tuple[str, str], hi: tuple[str, str], *, base_bits: int = BASE_BITS) -> DataFrame:
    """Pairs that share positive time in the same media; each pair once.

    A pair meets at the higher of its two levels, in the cell where the shared time begins.  Each
    side lies at its own level and climbs to the higher levels of the other; rows that both climb
    never meet, as keys say which side is at home.
    """
    level = lambda side: grid_level(F.col(lo[side]), F.col(hi[side]), base_bits)
    a = left.filter(F.col(hi[0]) > F.col(lo[0])).withColumn("_own", level(0))
    b = right.filter(F.col(hi[1]) > F.col(lo[1])).withColumn("_own", level(1))
    a_levels, b_levels = (side.agg(F.collect_set("_own")).scalar() for side in (a, b))
    at_home = lambda home, k: F.struct(F.lit(home).alias("home"), k.alias("k"))
    climbs = F.transform(F.filter("_levels", lambda k: k > F.col("_own")), lambda k: at_home("right", k))
    a = a.withColumn("_levels", b_levels).withColumn("_at", F.explode(F.concat(F.array(at_home("left", F.col("_own"))), climbs)))
    visits = F.transform(F.filter("_levels", lambda k: k >= F.col("_own")), lambda k: at_home("left", k))
    own = F.when(F.array_min("_levels") < F.col("_own"), F.array(at_home("right", F.col("_own")))).otherwise(F.array().cast("array<struct<home:string,k:int>>"))
    b = b.withColumn("_levels", a_levels).withColumn("_at", F.explode(F.concat(visits, own)))
    a = a.withColumn("_c", F.explode(cells(F.col(lo[0]), F.col(hi[0]), F.col("_at.k"), base_bits))).drop("_levels", "_own")
    b = b.withColumn("_c2", F.explode(cells(F.col(lo[1]), F.col(hi[1]), F.col("_at.k"), base_bits))).drop("_levels", "_own")
    b = b.withColumnRenamed("media_id", "_m").withColumnRenamed("_at", "_at2")
    match = (
        (F.col("media_id") == F.col("_m"))
        & (F.col("_at.home") == F.col("_at2.home"))
        & (F.col("_at.k") == F.col("_at2.k"))
        & (F.col("_c") == F.col("_c2"))
        & (F.col(lo[0]) < F.col(hi[1]))
        & (F.col(lo[1]) < F.col(hi[0]))
        & (F.col("_c") == cell(F.greatest(F.col(lo[0]), F.col(lo[1])), F.col("_at.k"), base_bits))
    )
    return a.join(b, match).drop("_at", "_at2", "_c", "_c2", "_m")


def flatten_overlaps(
    o: Ordered, *, show_speaker: bool = False, speaker_colors: bool = False, names: DataFrame | None = None
) -> DataFrame:
    """Elementary intervals with the texts visible in each: (media_id, event_no, start_ms, end_ms, style, text).

    Boundaries are the distinct starts and ends; neighbours with the same style and text
    are merged.
    """
    from cuesheet.sinks.subtitles import with_names

    rows = o.df.filter((F.length("text") > 0) & (F.col("end_ms") > F.col("start_ms")))
    rows = with_names(rows, names)
    shown = tx.escape_ass(
        tx.display_text(F.col("speaker"), F.col("text"), show_speaker=show_speaker, name=F.col("speaker_name"))
    )
    rows = rows.select("media_id", F.col("start_ms").alias("s"), F.col("end_ms").alias("e"), F.col("idx").alias("i"), "speaker", shown.alias("shown"))
    edges = rows.select("media_id", F.explode(F.array("s", "e")).alias("at")).distinct()
    cells = arrange(edges, ("media_id",), ("at",), like=o).local({"until": lambda w: F.lead("at").over(w)}, after=1)
    cells = cells.df.filter(F.col("until").isNotNull()).select("media_id", "at", "until")
    hits = points_in_intervals(cells, rows, "at", "s", "e")
    # The list is what one event shows at once.
    active = F.array_sort(F.collect_list(F.struct("s", "e", "i", "shown", "speaker")))
    events = hits.groupBy("media_id", "at", "until").agg(active.alias("a"))
    style = F.lit("Default")
    if speaker_colors:
        style = F.when(F.size("a") == 1, speaker_style(F.col("a")[0]["speaker"])).otherwise(style)
    events = events.select(
        "media_id", "at", "until", style.alias("style"), F.array_join(F.transform("a", lambda x: x["shown"]), "\\N").alias("text")
    )
    e = arrange(events, ("media_id",), ("at",), like=o)
    e = e.local(
        {
            "_u": lambda w: F.lag("until").over(w),
            "_s": lambda w: F.lag("style").over(w),
            "_t": lambda w: F.lag("text").over(w),
        },
        before=1,
    )
    same = (F.col("_u") == F.col("at")) & (F.col("_s") == F.col("style")) & (F.col("_t") == F.col("text"))
    e = e.with_columns({"_new": F.when(same, 0).otherwise(1).cast("bigint")}).running({"event_no": ("sum", F.col("_new"))})
    # Merged cells share their text, so any value does; runs are pre-aggregated before the shuffle.
    return e.df.groupBy("media_id", "event_no").agg(
        F.min("at").alias("start_ms"), F.max("until").alias("end_ms"), F.min("style").alias("style"), F.min("text").alias("text")
    )


def speaker_style(speaker: Column) -> Column:
    return F.concat(F.lit("Speaker_"), F.regexp_replace(speaker, r"[^\p{L}\p{N}]", "_"))


def visible_at(points: DataFrame, segments: DataFrame) -> DataFrame:
    """First visible segment (lowest idx) per point (media_id, point_id, at_ms); null when none."""
    s = segments.select("media_id", F.col("idx").alias("seg_idx"), "start_ms", "end_ms")
    pairs = points_in_intervals(points, s, "at_ms", "start_ms", "end_ms")
    first = pairs.groupBy("media_id", "point_id").agg(F.min("seg_idx").alias("seg_idx"))
    return points.join(first, ["media_id", "point_id"], "left")


def text_at(points: DataFrame, segments: DataFrame) -> DataFrame:
    """All visible non-blank texts per point, in start order."""
    s = segments.filter(F.length(tx.strip(F.col("text"))) > 0).select("media_id", F.col("idx").alias("seg_idx"), "start_ms", "end_ms", "text")
    pairs = points_in_intervals(points, s, "at_ms", "start_ms", "end_ms")
    shown = F.array_sort(F.collect_list(F.struct("start_ms", "seg_idx", "text")))
    lines = pairs.groupBy("media_id", "point_id").agg(F.array_join(F.transform(shown, lambda x: x["text"]), "\n").alias("shown"))
    return points.join(lines, ["media_id", "point_id"], "left").withColumn("shown", F.coalesce("shown", F.lit("")))


def snap_edges(moves: DataFrame, segments: DataFrame, *, threshold_ms: int, playheads: DataFrame | None = None) -> DataFrame:
    """Nearest candidate edge within the threshold for each moved segment.

    ``moves``: media_id, idx, mode (start/end/both), new_start_ms, new_end_ms.  Candidates
    are time 0, the playhead and the edges of the *other* segments.  On equal distance the
    moved start wins over the end, then the earlier candidate in that list.
    """
    edge = F.filter(
        F.array(
            F.struct(F.lit(0).alias("edge_no"), F.lit("start").alias("edge"), F.col("new_start_ms").alias("edge_ms")),
            F.struct(F.lit(1).alias("edge_no"), F.lit("end").alias("edge"), F.col("new_end_ms").alias("edge_ms")),
        ),
        lambda e: (F.col("mode") == "both") | (e["edge"] == F.col("mode")),
    )
    width = max(1, threshold_ms)
    moved = moves.select("media_id", "idx", F.explode(edge).alias("m")).select("media_id", "idx", "m.*")
    target = lambda no, label, at: F.struct(no.cast("bigint").alias("cand_no"), F.lit(label).alias("label"), at.cast("bigint").alias("cand_ms"))
    own = segments.select(
        F.col("media_id").alias("_m"),
        F.col("idx").alias("_owner"),
        F.explode(
            F.array(target(F.col("idx") * 2, "head", F.col("start_ms")), target(F.col("idx") * 2 + 1, "tail", F.col("end_ms")))
        ).alias("c"),
    )
    if playheads is not None:
        own = own.unionByName(
            playheads.select(F.col("media_id").alias("_m"), F.lit(0).cast("bigint").alias("_owner"), target(F.lit(1), "playhead", F.col("at_ms")).alias("c"))
        )
    own = own.select("_m", "_owner", "c.*").withColumn("_b", bucket(F.col("cand_ms"), width))
    near = moved.withColumn("_k", F.explode(F.array(*[bucket(F.col("edge_ms"), width) + d for d in (-1, 0, 1)])))
    dist = F.abs(F.col("edge_ms") - F.col("cand_ms"))
    pairs = near.join(
        own, (F.col("media_id") == F.col("_m")) & (F.col("_k") == F.col("_b")) & (F.col("idx") != F.col("_owner")) & (dist <= threshold_ms)
    ).select("media_id", "idx", "edge_no", "edge", "cand_no", "label", "cand_ms", dist.alias("dist"))
    origin = moved.filter(F.abs("edge_ms") <= threshold_ms).select(
        "media_id", "idx", "edge_no", "edge", F.lit(0).cast("bigint").alias("cand_no"), F.lit("origin").alias("label"),
        F.lit(0).cast("bigint").alias("cand_ms"), F.abs("edge_ms").alias("dist"),
    )
    every = pairs.unionByName(origin)
    best = every.groupBy("media_id", "idx").agg(F.min(F.struct("dist", "edge_no", "cand_no", "edge", "label", "cand_ms")).alias("b"))
    return moves.select("media_id", "idx").join(best, ["media_id", "idx"], "left").select(
        "media_id", "idx", "b.edge", "b.label", F.col("b.cand_ms").alias("snap_ms"), "b.dist"
    )


def lane_layout(df: DataFrame | Ordered) -> DataFrame:
    """First-fit lanes per media: (media_id, idx, lane).

    A lane is free when its end is at most 1 ms past the start; every row holds its lane
    for at least 10 ms.  Lanes all fall free between groups of overlapping rows, so each
    such group is laid out on its own, streamed in order with only the lane ends held.
    """
    like = df if isinstance(df, Ordered) else None
    rows = df.plain() if isinstance(df, Ordered) else df
    start = F.greatest(F.col("start_ms"), F.lit(0))
    rows = rows.select("media_id", "idx", start.cast("bigint").alias("s"), F.greatest("start_ms", "end_ms").alias("e"))
    o = arrange(rows, ("media_id",), ("s", "e", "idx"), like=like)
    o = o.with_columns({"held": F.greatest(F.col("e"), F.col("s") + 10)}).running({"_reach": ("max", F.col("held"))})
    o = o.local({"_past": lambda w: F.lag("_reach").over(w)}, before=1)
    opens = F.when(F.col("_past") <= F.col("s") + 1, 1).when(F.col("_past").isNull(), 1).otherwise(0)
    o = o.with_columns({"_open": opens.cast("bigint")}).running({"grp": ("sum", F.col("_open"))})
    groups = o.df.select("media_id", "idx", "grp", "s", "held", POS, (F.col("_open") == 1).alias("first"))
    ordered = groups.repartition("media_id", "grp").sortWithinPartitions("media_id", "grp", POS)
    key = rows.schema["media_id"].dataType.simpleString()
    return ordered.mapInArrow(_lanes, f"media_id {key}, idx bigint, lane bigint")


def _lanes(batches):
    import pyarrow as pa

    ends: list[int] = []
    for batch in batches:
        lanes = []
        for first, s, held in zip(*(batch.column(c).to_pylist() for c in ("first", "s", "held"))):
            if first:
                ends = []
            lane = next((i for i, end in enumerate(ends) if end <= s + 1), len(ends))
            if lane == len(ends):
                ends.append(0)
            ends[lane] = held
            lanes.append(lane)
        yield pa.RecordBatch.from_arrays(
            [batch.column("media_id"), batch.column("idx"), pa.array(lanes, pa.int64())], names=["media_id", "idx", "lane"]
        )


def max_concurrency(df: DataFrame | Ordered) -> DataFrame:
    """Greatest number of rows on screen at once, by a sweep over +1/-1 edges."""
    like = df if isinstance(df, Ordered) else None
    rows = (df.plain() if isinstance(df, Ordered) else df).filter("end_ms > start_ms")
    edge = F.array(F.struct(F.col("start_ms").alias("at"), F.lit(1).cast("bigint").alias("d")), F.struct(F.col("end_ms").alias("at"), F.lit(-1).cast("bigint").alias("d")))
    steps = rows.select("media_id", F.explode(edge).alias("x")).groupBy("media_id", F.col("x.at").alias("at")).agg(F.sum("x.d").alias("d"))
    o = arrange(steps, ("media_id",), ("at",), like=like).running({"open": ("sum", F.col("d"))})
    return o.df.groupBy("media_id").agg(F.max("open").alias("lanes"))


def rebase_to_clips(df: DataFrame | Ordered, clips: DataFrame) -> DataFrame:
    """Segments cut to clip ranges and shifted to clip time zero.

    ``clips``: media_id, clip_id, clip_start_ms, clip_end_ms.  Ids carry the position of
    the segment among the prepared rows.
    """
    o = prepare_for_clips(df)
    lo = F.greatest(F.col("clip_start_ms"), F.lit(0)).cast("bigint")
    ranges = clips.select("media_id", "clip_id", lo.alias("lo"), F.greatest(lo, "clip_end_ms").alias("hi"))
    rows = o.df.select("media_id", (F.col(POS) + 1).alias("n"), "start_ms", "end_ms", "speaker", "text")
    pairs = overlapping(rows, ranges, ("start_ms", "lo"), ("end_ms", "hi"))
    return pairs.select(
        "media_id",
        "clip_id",
        F.col("n").alias("idx"),
        number_id(F.col("n"), "clip_seg_").alias("id"),
        (F.greatest("start_ms", "lo") - F.col("lo")).alias("start_ms"),
        (F.least("end_ms", "hi") - F.col("lo")).alias("end_ms"),
        "speaker",
        "text",
    )


def speaker_dimension(df: DataFrame | Ordered, names: DataFrame | None = None) -> DataFrame:
    """Distinct speakers per media with rank and display name."""
    like = df if isinstance(df, Ordered) else None
    rows = df.df if isinstance(df, Ordered) else df
    found = rows.filter(F.length("speaker") > 0).select("media_id", "speaker").distinct()
    ranked = arrange(found, ("media_id",), ("speaker",), like=like)
    out = ranked.df.select("media_id", "speaker", F.col(POS).alias("rank"))
    if names is None:
        return out.withColumn("name", F.col("speaker"))
    out = out.join(names.select("media_id", "speaker", F.col("name").alias("_n")), ["media_id", "speaker"], "left")
    return out.withColumn("name", F.coalesce(F.when(F.length("_n") > 0, F.col("_n")), F.col("speaker"))).drop("_n")


def without_dismissed(items: DataFrame, dismissed: DataFrame) -> DataFrame:
    """Drop review items whose (media_id, key) was dismissed."""
    return items.join(dismissed.select("media_id", "key").distinct(), ["media_id", "key"], "left_anti")
