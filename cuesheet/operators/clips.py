"""Highlight clips: candidate windows, scores, overlap removal, top-k, outside ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuesheet.functions import text as tx
from cuesheet.functions import times as tm
from cuesheet.functions import windows as wn
from cuesheet.operators.segments import number_id, prepare_for_clips
from cuesheet.ordering import POS, Ordered
from cuesheet.session import materialise

MIN_MS, TARGET_MS, MAX_MS, GAP_MS, LIMIT = 45_000, 120_000, 180_000, 12_000, 24

# Words whose presence marks a hook.
HOOKS = [
    "why", "how", "but", "actually", "problem", "key", "important", "secret", "mistake", "result", "because", "wait",
    "no way", "what happened", "the point is", "所以", "但是", "其实", "关键", "问题", "为什么", "怎么", "结果", "重点", "核心",
    "离谱", "真的假的", "不会吧", "破防", "绷不住", "等一下", "没想到", "到底",
]
# Words that close a thought.
ENDINGS = ["so", "therefore", "because", "that's why", "in short", "总结", "所以", "因此", "这就是", "结论", "最后"]
_REACH = max(len(p) for p in HOOKS) - 1
PART = 64  # cells of time of a media too large for one task
AT_ONCE = 1 << 18  # windows made at once, but for those of one start
UNTITLED = "Untitled clip"
NO_VALID_PICK = "no pick names a candidate"


def pattern_hits(text: Column, patterns: list[str]) -> Column:
    """How many different patterns occur, as plain substrings of the lower-case text."""
    low = F.lower(text)
    return sum((low.contains(p).cast("int") for p in patterns[1:]), low.contains(patterns[0]).cast("int"))


def clip_title(text: Column) -> Column:
    t = tx.strip(tx.squeeze(text))
    short = F.when(F.length(t) > 0, t).otherwise(UNTITLED)
    return F.when(F.length(t) <= 34, short).otherwise(F.concat(tx.rstrip(F.substring(t, 1, 34)), F.lit("...")))


def clip_reason(hooks: Column, endings: Column, questions: Column, duration_ms: Column) -> Column:
    low = F.pmod(duration_ms, F.lit(1000))
    whole = ((duration_ms - low) / 1000).cast("bigint")
    up = (low > 500) | ((low == 500) & (whole % 2 == 1))
    seconds = F.concat((whole + up.cast("bigint")).cast("string"), F.lit("s"))
    plain = (hooks == 0) & (questions == 0) & (endings == 0)
    return F.concat_ws(
        ", ",
        seconds,
        F.when(hooks > 0, "hook"),
        F.when(questions > 0, "question"),
        F.when(endings > 0, "clear ending"),
        F.when(plain, "dense transcript window"),
    )


def _pattern_table(patterns: list[str]) -> Column:
    """The patterns as an array of structs, to be walked by one lambda instead of one column each."""
    rows = [
        F.struct(F.lit(p).alias("p"), F.lit(p[::-1]).alias("rev"), F.lit(len(p)).alias("n"), F.lit(1 << HOOKS.index(p)).cast("bigint").alias("bit"))
        for p in patterns
    ]
    return F.array(*rows)


def _own_hooks(low: Column) -> Column:
    """Bit set of the hooks inside one segment."""
    return F.aggregate(
        _pattern_table(HOOKS), F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseOR(F.when(F.contains(low, x["p"]), x["bit"]).otherwise(F.lit(0).cast("bigint")))
    )


def _crossing_hooks(before: Column, sep: Column, low: Column, offset: Column) -> Column:
    """Hooks that begin in earlier segments and end in this one: array of (bit, offset of the start).

    A pattern of n characters crosses when it occurs in the n-1 characters on either side
    of the seam.  Touching ASCII characters get a blank, so only patterns with a blank or
    a non-ASCII character can cross.
    """
    able = [p for p in HOOKS if " " in p or not p.isascii()]

    def look(x: Column) -> Column:
        left, right = F.right(before, x["n"] - 1), F.left(low, x["n"] - 1)
        seam = F.concat(left, sep, right)
        back = F.instr(F.reverse(seam), x["rev"])
        start = offset + F.length(right) - (back + x["n"] - 1) + 1
        return F.struct(F.when(back > 0, x["bit"]).alias("bit"), start.cast("bigint").alias("at"))

    # Few seams hold a pattern at all; one regular expression over 25 characters finds them.
    seam = F.concat(F.right(before, F.lit(_REACH)), sep, F.left(low, F.lit(_REACH)))
    found = F.filter(F.transform(_pattern_table(able), look), lambda h: h["bit"].isNotNull())
    return F.when(seam.rlike("|".join(able)), found).otherwise(F.array().cast("array<struct<bit:bigint,at:bigint>>"))


def _features(df: DataFrame | Ordered, gap_ms: int) -> Ordered:
    """Per segment the running figures from which any window is scored by subtraction.

    Separators depend only on the touching characters, so the joined text of a media has
    fixed offsets.
    """
    o = prepare_for_clips(df)
    lag = lambda c: lambda w: F.lag(c).over(w)
    o = o.with_columns({"_low": F.lower("text")})
    o = o.local({"_pe": lag("end_ms"), "_pt": lag("text")}, before=1)
    gap = F.col("start_ms") - F.col("_pe")
    o = o.with_columns(
        {
            "sep": F.coalesce(tx.separator(F.col("_pt"), F.col("text")), F.lit("")),
            "_opens": F.coalesce((gap > gap_ms).cast("bigint"), F.lit(1).cast("bigint")),
            "_pause": F.coalesce(gap.between(450, 4000).cast("bigint"), F.lit(0).cast("bigint")),
            "own_q": tx.count_of(F.col("text"), "?？"),
            "own_p": tx.count_of(F.col("text"), "!！?？。"),
        }
    )
    # No row is empty: so many rows hold all characters that a hook may begin in.
    tail = F.right(F.concat("sep", "_low"), F.lit(_REACH))
    back = range(_REACH, 0, -1)
    o = o.with_columns({"_tail": tail}).local({f"_tail{k}": lambda w, k=k: F.lag("_tail", k).over(w) for k in back}, before=_REACH)
    o = o.with_columns({"_before": F.right(F.concat_ws("", *[f"_tail{k}" for k in back]), F.lit(_REACH))})
    o = o.of(o.df.drop("_tail", *[f"_tail{k}" for k in back]))
    o = o.running(
        {
            "chars": ("sum", (F.length("sep") + F.length("text")).cast("bigint")),
            "low_chars": ("sum", (F.length("sep") + F.length("_low")).cast("bigint")),
            "island": ("sum", F.col("_opens")),
            "pauses": ("sum", F.col("_pause")),
            "questions": ("sum", F.col("own_q")),
            "puncts": ("sum", F.col("own_p")),
            "_reach": ("max", F.col("end_ms")),
        }
    )
    o = o.local({"_over": lag("_reach")}, before=1)
    # Windows of different blocks never share time: no candidate can conflict across blocks.
    apart = F.coalesce((F.col("_opens") == 1) & (F.col("start_ms") >= F.col("_over")), F.lit(True))
    o = o.with_columns({"_apart": apart.cast("bigint")}).running({"block": ("sum", F.col("_apart"))})
    crossing = _crossing_hooks(F.col("_before"), F.col("sep"), F.col("_low"), F.col("low_chars") - F.length("_low"))
    o = o.select(
        "id", "start_ms", "end_ms", "text", "sep", "island", "block", "chars", "low_chars", "pauses", "questions", "puncts", "own_q", "own_p",
        _own_hooks(F.col("_low")).alias("hook_bits"), crossing.alias("crossing"), F.length("text").alias("n_text"), F.length("_low").alias("n_low"),
        pattern_hits(F.col("_low"), ENDINGS).alias("endings"), tx.looks_complete(F.col("text")).alias("complete"),
    )
    return o


def _figures(o: Ordered, *more: Column) -> DataFrame:
    """What windows are made from: the rows of ``_features`` without their texts."""
    return o.df.filter(F.col("media_id").isNotNull()).select(
        "media_id", "island", "block", *more, F.col(POS).alias("pos"), "start_ms", "end_ms",
        (F.col("chars") - F.col("n_text")).alias("c0"), (F.col("low_chars") - F.col("n_low") + 1).alias("l0"),
        (F.col("questions") - F.col("own_q")).alias("q0"), (F.col("puncts") - F.col("own_p")).alias("u0"), "chars", "pauses", "questions", "puncts",
        "hook_bits", F.col("crossing.bit").alias("cross_bits"), F.col("crossing.at").alias("cross_at"), F.col("endings").cast("int").alias("endings"), "complete",
    )


_WINDOW = (
    "block bigint, i bigint, j bigint, from_ms bigint, to_ms bigint, chars bigint, questions bigint, puncts bigint, pauses bigint, hooks int, endings int, "
    "complete boolean, score double, start_ms bigint, end_ms bigint"
)


def _window_schema(o: Ordered) -> str:
    return f"media_id {o.df.schema['media_id'].dataType.simpleString()}, {_WINDOW}"


def candidate_windows(
    df: DataFrame | Ordered, *, min_ms: int = MIN_MS, target_ms: int = TARGET_MS, max_ms: int = MAX_MS, gap_ms: int = GAP_MS
) -> tuple[DataFrame, Ordered]:
    """All scored windows i..j: (media_id, block, i, j, start_ms, end_ms, score, ...), and the segments.

    Rows pair up only inside one gap island and one time bucket of ``max_ms`` (each row also lies, as a later
    row only, in the bucket before its own), never across a whole media.  A bucket streams through its task in order; only its rows
    are sorted and held, never its windows.
    """
    o = _features(df, gap_ms)
    b = F.floor(F.col("start_ms") / max_ms)
    rows = materialise(_figures(o)).withColumn("_t", F.explode(F.array(F.struct(b.alias("b"), F.lit(True).alias("own")), F.struct((b - 1).alias("b"), F.lit(False).alias("own")))))
    rows = rows.select("*", "_t.b", "_t.own").drop("_t")
    rows = rows.repartition("media_id", "island", "b").sortWithinPartitions("media_id", "island", "b", "pos")
    return rows.mapInArrow(_windows(min_ms, target_ms, max_ms), _window_schema(o)), o


def _changes(t, columns):
    """Where one of the columns changes, but for the first row."""
    import numpy as np
    import pyarrow.compute as pc

    differs = [pc.not_equal(t.column(c)[1:], t.column(c)[:-1]).to_numpy(zero_copy_only=False) for c in columns]
    return np.flatnonzero(np.logical_or.reduce(differs)) + 1


def _arrays(t):
    """The columns of rows as arrays, the hooks that cross into them apart."""
    v = {c: t.column(c).to_numpy(zero_copy_only=False) for c in t.schema.names if c not in ("media_id", "cross_bits", "cross_at")}
    crossings = t.column("cross_bits").value_lengths().to_numpy(zero_copy_only=False)
    return v, (crossings, *(t.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("cross_bits", "cross_at")))


def _batch(media, columns):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([media, *map(pa.array, columns.values())], names=["media_id", *columns])


def _windows(min_ms, target_ms, max_ms):
    """mapInArrow body: the windows of rows sorted by media, island, bucket and position."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        bucket = ("media_id", "island", "b")

        def windows(t):
            v, crossing = _arrays(t)
            ends = np.append(_changes(t, bucket), t.num_rows)
            ends = ends[np.searchsorted(ends, np.arange(t.num_rows), "right")]
            for i, j, bits in wn.spans(v, np.flatnonzero(v["own"]), ends, *crossing, min_ms, max_ms):
                yield _batch(t.column("media_id").take(pa.array(i)), wn.figures(v, i, j, np.bitwise_count(bits), target_ms))

        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # The last bucket of what has come may go on.
            held.append(batch)
            t = pa.concat_batches(held) if len(held) > 1 else batch
            starts = _changes(t, bucket)
            cut = int(starts[-1]) if len(starts) else 0
            if cut:
                yield from windows(t.slice(0, cut))
            held = [t.slice(cut)]
        if held:
            yield from windows(pa.concat_batches(held))

    return run


def kept_windows(
    df: DataFrame | Ordered, *, min_ms: int = MIN_MS, target_ms: int = TARGET_MS, max_ms: int = MAX_MS, gap_ms: int = GAP_MS
) -> tuple[DataFrame, Ordered]:
    """``drop_overlapping`` of ``candidate_windows``, and the segments; windows that go never leave the task that makes them.

    Blocks share no time, so the rows of a block meet in a task and stream through it.  Of media too large for that, parts of
    ``PART`` cells of time do; the few windows that hang on what is in the next part are then settled in rounds.
    """
    o = _features(df, gap_ms)
    if o.chunked:
        cell = F.floor(tm.centiseconds(F.col("start_ms")) * 10 / _cell(max_ms))
        part = F.floor(cell / PART)
        # Windows end within the next cell; a part also gets the rows of the cell behind it, as later rows only.
        parts = F.array_compact(F.array(F.struct(part.alias("part"), F.lit(True).alias("own")), F.when(F.pmod(cell, F.lit(PART)) == 0, F.struct((part - 1).alias("part"), F.lit(False).alias("own")))))
        rows = _figures(o, F.explode(parts).alias("_t"))
        rows = rows.select("*", "_t.part", "_t.own").drop("_t")
    else:
        rows = _figures(o, F.lit(0).cast("bigint").alias("part"), F.lit(True).alias("own"))
    rows = rows.repartition("media_id", "block", "part").sortWithinPartitions("media_id", "block", "part", "pos")
    found = rows.mapInArrow(_keep(min_ms, target_ms, max_ms, o.chunked), f"{_window_schema(o)}, open boolean")
    if not o.chunked:
        return found.drop("open"), o
    found = materialise(found)
    return found.filter(~F.col("open")).drop("open").unionByName(_drop_in_rounds(found.filter("open").drop("open"), max_ms)), o


def _cell(max_ms):
    """Width of a cell of time: windows whose starts lie two cells apart share no time, though rounding may lengthen them."""
    return max_ms + 20


def _keep(min_ms, target_ms, max_ms, parts):
    """mapInArrow body: the windows that overlap removal keeps, of rows sorted by media, block, part and position.

    Starts are taken in stretches of a bounded number of windows.  Where a block goes on behind a stretch, windows near its end wait
    for the next one, with the kept ones that those may clash with.  What hangs on other ``parts`` leaves as open.
    """

    def run(batches):
        from itertools import chain

        import numpy as np
        import pyarrow as pa

        width, whole = _cell(max_ms), ("media_id", "block", "part")
        held, waiting, near = None, None, None

        for batch in chain((b for b in batches if b.num_rows), [None]):
            if batch is None and held is None:
                return
            t = held if batch is None else batch if held is None else pa.concat_batches([held, batch])
            n = t.num_rows
            v, crossing = _arrays(t)
            begins = np.append(0, _changes(t, whole))
            group = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, n)))
            ends = np.append(_changes(t, (*whole, "island")), n)
            ends = ends[np.searchsorted(ends, np.arange(n), "right")]
            reach = [a + np.searchsorted(v["start_ms"][a:z], v["start_ms"][a:z] + max_ms, "right") for a, z in zip(begins, [*begins[1:], n])]
            made = np.cumsum(np.minimum(np.concatenate(reach), ends) - np.arange(n))
            # Starts of the last group may still get later rows.
            ready = n if batch is None else int(begins[-1] + np.searchsorted(v["start_ms"][begins[-1] :], v["start_ms"][-1] - max_ms))
            a = 0
            while a < ready:
                z = min(ready, max(a + 1, int(np.searchsorted(made, (made[a - 1] if a else 0) + AT_ONCE, "right"))))
                spans = list(wn.spans(v, a + np.flatnonzero(v["own"][a:z]), ends, *crossing, min_ms, max_ms))
                i, j, bits = (np.concatenate(x) for x in zip(*spans)) if spans else (np.zeros(0, np.int64),) * 3
                order = np.argsort(i, kind="stable")
                i, j, bits = i[order], j[order], bits[order]
                f = wn.figures(v, i, j, np.bitwise_count(bits), target_ms)
                media, owner = t.column("media_id").take(pa.array(i)), group[i]
                if near is not None:  # kept before, in the block that went on
                    stay = np.ones(len(i), bool)
                    for s, e in zip(*near):
                        stop = int(np.searchsorted(f["start_ms"][: np.searchsorted(owner, group[a], "right")], e))
                        stay[:stop] &= ~wn.clash(f["start_ms"][:stop], f["end_ms"][:stop], s, e)
                    f, media, owner = {c: x[stay] for c, x in f.items()}, media.filter(pa.array(stay)), owner[stay]
                if waiting is not None:
                    f = {c: np.concatenate((waiting[c], x)) for c, x in f.items()}
                    more = len(f["i"]) - len(owner)
                    media = pa.concat_arrays([t.column("media_id").slice(a, 1).take(pa.array(np.zeros(more, np.int64))), media])
                    owner = np.append(np.full(more, group[a]), owner)
                goes_on = z < n and group[z] == group[z - 1]
                cell = f["start_ms"] // width
                edge = int(wn.centiseconds(v["start_ms"][z : z + 1])[0]) * 10 // width if goes_on else None
                may = (owner != group[z - 1]) | (cell < edge - 1) if goes_on else np.ones(len(cell), bool)
                if parts:
                    may &= (cell % PART > 0) & (cell % PART < PART - 1)
                step = np.where(owner[1:] == owner[:-1], np.minimum(np.diff(cell), 2), 2)
                kept, left = wn.settle(f["start_ms"], f["end_ms"], f["score"], np.cumsum(np.append(1, step)) if len(cell) else cell, may)
                later = left[owner[left] == group[z - 1]] if goes_on else left[:0]
                out = np.append(kept, left[: len(left) - len(later)])
                if len(out):
                    told = {c: x[out] for c, x in f.items()} | {"open": np.arange(len(out)) >= len(kept)}
                    yield _batch(media.take(pa.array(out)), told)
                old, near, waiting = near, None, None
                if goes_on:
                    last = kept[(owner[kept] == group[z - 1]) & (cell[kept] >= edge - 1)]
                    near = f["start_ms"][last], f["end_ms"][last]
                    if old is not None and group[a] == group[z - 1]:
                        still = old[0] // width >= edge - 1
                        near = np.append(old[0][still], near[0]), np.append(old[1][still], near[1])
                    waiting = {c: x[later] for c, x in f.items()}
                a = z
            held = t.slice(ready) if ready < n else None

    return run


def _conflict(s1, e1, s2, e2):
    """Shared time over the shorter duration (at least 1 s) above 0.65, in whole milliseconds."""
    shared = F.least(e1, e2) - F.greatest(s1, s2)
    shorter = F.greatest(F.lit(1000), F.least(e1 - s1, e2 - s2))
    return (shared > 0) & (shared * 100 > shorter * 65)


def drop_overlapping(cands: DataFrame, *, max_ms: int = MAX_MS, hot: bool = False) -> DataFrame:
    """Greedy by score: a candidate goes when it overlaps a kept better one too much.

    Ties keep the order of generation (i, j).  Blocks share no time and are walked
    independently: rows stream in score order and only kept ranges are held.  With ``hot``
    (some media too large for one task) the same result comes from rounds.
    """
    if hot:
        return _drop_in_rounds(cands, max_ms)
    ordered = cands.repartition("media_id", "block").sortWithinPartitions("media_id", "block", F.desc("score"), "i", "j")
    flagged = ordered.mapInArrow(
        _greedy(max_ms), T.StructType([*cands.schema.fields, T.StructField("kept", T.BooleanType())])
    )
    return flagged.filter("kept").drop("kept")


def _greedy(width):
    def run(batches):
        import pyarrow as pa

        block, kept = None, {}
        for batch in batches:
            flags = []
            for m, b, s, e in zip(*(batch.column(c).to_pylist() for c in ("media_id", "block", "start_ms", "end_ms"))):
                if (m, b) != block:
                    block, kept = (m, b), {}
                cell = s // width
                # Rounding may lengthen a range past the width by 10 ms, hence two cells back.
                clash = any(
                    min(e, e2) > max(s, s2) and (min(e, e2) - max(s, s2)) * 100 > max(1000, min(e - s, e2 - s2)) * 65
                    for c in (cell - 2, cell - 1, cell, cell + 1, cell + 2)
                    for s2, e2 in kept.get(c, ())
                )
                if not clash:
                    kept.setdefault(cell, []).append((s, e))
                flags.append(not clash)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(flags)], names=[*batch.schema.names, "kept"])

    return run


def _drop_in_rounds(cands: DataFrame, max_ms: int) -> DataFrame:
    """Rounds over time cells: the best candidate among its own and both neighbour cells has
    no better rival left, so it is kept and removes its conflicts.  Each round reduces cells
    with a partial aggregate; no pairs of candidates are formed."""
    cell = F.floor(F.col("start_ms") / (max_ms + 20))
    rank = F.struct((-F.col("score")).alias("k"), F.col("i").alias("ri"), F.col("j").alias("rj"), F.col("start_ms").alias("ws"), F.col("end_ms").alias("we"))
    open_rows = materialise(cands.withColumn("cell", cell))
    kept = None
    while not open_rows.isEmpty():
        best = open_rows.groupBy("media_id", "cell").agg(F.min(rank).alias("top"))
        around = best.select("media_id", F.explode(F.array(*[F.col("cell") + d for d in (-1, 0, 1)])).alias("cell"), "top")
        around = around.groupBy("media_id", "cell").agg(F.min("top").alias("lead"))
        winners = best.join(around, ["media_id", "cell"]).filter(F.col("top") == F.col("lead"))
        winners = winners.select("media_id", "cell", "top.*")
        chosen = winners.select("media_id", F.col("ri").alias("i"), F.col("rj").alias("j"))
        reach = winners.select(
            F.col("media_id").alias("_m"), F.explode(F.array(*[F.col("cell") + d for d in (-1, 0, 1)])).alias("_c"), "ri", "rj", "ws", "we"
        )
        took = open_rows.join(chosen, ["media_id", "i", "j"], "left_semi")
        kept_now = materialise(took)
        kept = kept_now if kept is None else kept.unionByName(kept_now)
        same = (F.col("i") == F.col("ri")) & (F.col("j") == F.col("rj"))
        gone = same | _conflict(F.col("start_ms"), F.col("end_ms"), F.col("ws"), F.col("we"))
        open_rows = materialise(
            open_rows.join(reach, (F.col("media_id") == F.col("_m")) & (F.col("cell") == F.col("_c")) & gone, "left_anti")
        )
    return (cands.limit(0) if kept is None else kept.drop("cell"))


def top_clips(kept: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Best ``limit`` per media.  Spark trims each task to ``limit`` rows before the shuffle."""
    w = Window.partitionBy("media_id").orderBy(F.desc("score"), "i", "j")
    ranked = kept.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
    return ranked.withColumn("id", number_id(F.col("rank"), "clip_", 3)).withColumn("rank", F.col("rank").cast("bigint"))


def describe_clips(clips: DataFrame, segments: Ordered) -> DataFrame:
    """Add title, reason, text (700 characters) and segment ids; only now is text touched.

    Clips of a media are few and meet its rows where these are; of media too large for one task, by position.
    """
    rows = segments.df.select(F.col("media_id").alias("_m"), F.col(POS).alias("_p"), F.col("id").alias("seg_id"), "sep", F.col("text").alias("t"))
    if segments.chunked:
        spans = clips.withColumn("_at", F.explode(F.sequence("i", "j")))
        hit = spans.join(rows, (F.col("media_id") == F.col("_m")) & (F.col("_at") == F.col("_p")))
    else:
        hit = rows.join(clips, (F.col("media_id") == F.col("_m")) & F.col("_p").between(F.col("i"), F.col("j"))).withColumn("_at", F.col("_p"))
    piece = F.struct("_at", F.when(F.col("_at") == F.col("i"), F.col("t")).otherwise(F.concat("sep", "t")).alias("t"), "seg_id")
    keep = [c for c in clips.columns if c not in ("media_id", "id")]
    full = hit.groupBy("media_id", "id").agg(*[F.first(c).alias(c) for c in keep], F.array_sort(F.collect_list(piece)).alias("_p"))
    text = F.array_join(F.transform("_p", lambda x: x["t"]), "")
    full = full.withColumn("_text", text)
    return full.select(
        "media_id", "id", "rank", "start_ms", "end_ms", "score",
        clip_title(F.col("_text")).alias("title"),
        clip_reason(F.col("hooks"), F.col("endings"), F.col("questions"), F.col("to_ms") - F.col("from_ms")).alias("reason"),
        F.substring("_text", 1, 700).alias("text"),
        F.transform("_p", lambda x: x["seg_id"]).alias("segment_ids"),
        F.lit("rules").alias("selection_method"),
    )


def clip_candidates(df: DataFrame | Ordered, *, min_ms=MIN_MS, target_ms=TARGET_MS, max_ms=MAX_MS, limit=LIMIT) -> DataFrame:
    """Windows -> scores -> overlap removal -> top-k -> descriptions."""
    kept, segments = kept_windows(df, min_ms=min_ms, target_ms=target_ms, max_ms=max_ms)
    return describe_clips(top_clips(kept, limit), segments)


def apply_ranking(candidates: DataFrame, picks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Outside picks (media_id, pick_no, id, score, title, reason) over candidates.

    Unknown ids vanish, pick order rules, a pick given twice stays twice, the first
    ``limit`` valid picks per media remain.
    """
    filled = lambda c, d: F.coalesce(F.when(F.length(c) > 0, F.col(c)), d)
    c = candidates.withColumnsRenamed({"score": "_s", "title": "_t", "reason": "_r", "selection_method": "_sm"})
    hit = c.join(picks, ["media_id", "id"])
    w = Window.partitionBy("media_id").orderBy("pick_no")
    hit = hit.withColumn("place", F.row_number().over(w).cast("bigint")).filter(F.col("place") <= max(1, limit))
    return hit.select(
        *[x for x in candidates.columns if x not in ("score", "title", "reason", "selection_method")],
        "place",
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(F.col("score").cast("double"), F.lit(0.0)))).alias("score"),
        # Title and reason where none is given.
        tx.strip(filled("title", filled("_t", F.lit("未命名片段")))).alias("title"),
        tx.strip(filled("reason", F.lit("模型精选"))).alias("reason"),
        F.lit("model").alias("selection_method"),
    )


def ranking_outcomes(candidates: DataFrame, picks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """What a ranking by outside picks gave, per media with candidates: (media_id, candidates, picks, valid, error).

    ``valid`` counts the picks that ``apply_ranking`` keeps; ``error`` is set where none names a candidate, so that a caller can tell
    a failed selection from a media without highlights.  Both sides are counted before they meet.
    """
    known = candidates.groupBy("media_id").agg(F.count(F.lit(1)).alias("candidates"))
    given = picks.groupBy("media_id", "id").agg(F.count(F.lit(1)).alias("n"))
    ids = candidates.select("media_id", "id").distinct().withColumn("_known", F.lit(True))
    counts = given.join(ids, ["media_id", "id"], "left").groupBy("media_id").agg(
        F.sum("n").alias("picks"), F.least(F.sum(F.when(F.col("_known"), F.col("n")).otherwise(0)), F.lit(max(1, limit))).alias("valid")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    out = known.join(counts, "media_id", "left").select("media_id", "candidates", zero("picks"), zero("valid"))
    return out.withColumn("error", F.when(F.col("valid") == 0, NO_VALID_PICK))


def normal_clip_request(start_ms: Column, end_ms: Column) -> tuple[Column, Column]:
    """A render request: start at or after 0, at least 0.25 s long."""
    start = F.greatest(F.lit(0), start_ms).cast("bigint")
    return start, F.greatest(start + 250, end_ms)


def normal_queued_clip(start_ms: Column, end_ms: Column, duration_ms: Column) -> tuple[Column, Column]:
    """A queued clip: a missing end means ``duration`` (default 120 s) after the start; tenths of seconds."""
    start = F.greatest(F.lit(0), F.coalesce(start_ms, F.lit(0))).cast("bigint")
    wanted = F.when(F.coalesce(duration_ms, F.lit(0)) != 0, duration_ms).otherwise(120_000)
    given = F.when(F.coalesce(end_ms, F.lit(0)) != 0, end_ms).otherwise(start + F.greatest(F.lit(250), wanted))
    end = F.greatest(start + 250, given)
    tenth = lambda c: (F.floor((c + 50) / 100) * 100).cast("bigint")
    return tenth(start), tenth(end)
