"""Speaker labels: from diarization turns, or from clustered segment features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuesheet.operators.intervals import overlapping
from cuesheet.operators.segments import number_id
from cuesheet.ordering import POS, Ordered, arrange
from cuesheet.session import materialise

MAX_K, MAX_ROUNDS, MIN_SILHOUETTE, MIN_ROWS = 8, 60, 0.12, 4
SHORT_ISLAND_MS = 1300
PACK = 256  # range of idx whose rows are measured together in a round
BLOCK, STRIP, REACH, WIDE = 512, 16, 32, 2048  # rows of a block, blocks of a strip, blocks one task takes to a strip, columns of a product


# ---- labels from turns -------------------------------------------------------


def assign_turns(o: Ordered, turns: DataFrame) -> Ordered:
    """Add ``source_speaker``: most shared time, else the turn nearest to the midpoint.

    ``turns``: media_id, turn_no, turn_start_ms, turn_end_ms, source.  Ties go to the earlier turn.
    """
    turns = turns.filter("turn_end_ms > turn_start_ms")
    segs = o.df.select("media_id", F.col(POS).alias("p"), "start_ms", "end_ms")
    pairs = overlapping(segs, turns, ("start_ms", "turn_start_ms"), ("end_ms", "turn_end_ms"))
    shared = F.least("end_ms", "turn_end_ms") - F.greatest("start_ms", "turn_start_ms")
    by_source = pairs.groupBy("media_id", "p", "source").agg(F.sum(shared).alias("shared"), F.min("turn_no").alias("first"))
    best = by_source.groupBy("media_id", "p").agg(F.max_by("source", F.struct("shared", -F.col("first"))).alias("by_overlap"))
    alone = segs.join(best, ["media_id", "p"], "left_anti")
    near = nearest_turn(alone, turns, o)
    df = o.df.withColumn("p", F.col(POS)).join(best, ["media_id", "p"], "left").join(near, ["media_id", "p"], "left")
    source = F.coalesce("by_overlap", "by_distance", F.lit("SPEAKER_00"))
    return o.of(df.withColumn("source_speaker", source).drop("p", "by_overlap", "by_distance"))


def nearest_turn(segs: DataFrame, turns: DataFrame, like: Ordered) -> DataFrame:
    """For rows that share time with no turn: the nearest turn before or after.

    An as-of join both ways: rows and turn ends (then starts) are merged on the timeline
    and a running maximum (minimum) carries the last turn seen.
    """

    def side(turn_at: str, seg_at: str, best: Column, kind: str, reverse: bool, name: str) -> DataFrame:
        marks = turns.select("media_id", F.col(turn_at).alias("at"), F.lit(0 if not reverse else 1).alias("what"), F.col("turn_no").alias("n"),
                             best.alias("mark"), F.lit(None).cast("bigint").alias("p"), F.lit(None).cast("bigint").alias("mid2"))
        probes = segs.select("media_id", F.col(seg_at).alias("at"), F.lit(1 if not reverse else 0).alias("what"), F.col("p").alias("n"),
                             F.lit(None).cast(marks.schema["mark"].dataType).alias("mark"), "p", (F.col("start_ms") + F.col("end_ms")).alias("mid2"))
        line = arrange(marks.unionByName(probes), ("media_id",), ("at", "what", "n"), like=measured, limit=like.limit)
        line = line.running({"seen": (kind, F.col("mark"))}, reverse=reverse)
        return line.df.filter(F.col("p").isNotNull()).select("media_id", "p", "mid2", F.col("seen").alias(name))

    # The rows are known to be few per media where ``like`` is not chunked, so only the turns are counted, once for both sides.
    measured = None
    if not like.chunked:
        most = turns.groupBy("media_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        measured = like if most <= like.limit else None
    # Doubled times keep midpoints whole.
    before = side("turn_end_ms", "start_ms", F.struct(F.col("turn_end_ms").alias("t"), (-F.col("turn_no")).alias("k"), "source"), "max", False, "b")
    after = side("turn_start_ms", "end_ms", F.struct(F.col("turn_start_ms").alias("t"), F.col("turn_no").alias("k"), "source"), "min", True, "a")
    both = before.join(after.drop("mid2"), ["media_id", "p"])
    db, da = F.col("mid2") - 2 * F.col("b.t"), 2 * F.col("a.t") - F.col("mid2")
    left_first = F.col("b").isNotNull() & (F.col("a").isNull() | (db < da) | ((db == da) & (-F.col("b.k") < F.col("a.k"))))
    return both.select("media_id", "p", F.when(left_first, F.col("b.source")).otherwise(F.col("a.source")).alias("by_distance"))


def name_by_appearance(o: Ordered, label: str, out: str = "speaker") -> Ordered:
    """S01, S02, ... in order of first appearance of each label."""
    seen = o.df.groupBy("media_id", label).agg(F.min(POS).alias("_first"))
    ranked = arrange(seen, ("media_id",), ("_first",), like=o).df
    names = ranked.select("media_id", F.col(label), number_id(F.col(POS) + 1, "S", 2).alias("_name"))
    joined = o.df.join(names, ["media_id", label])
    return o.of(joined.withColumn(out, F.col("_name")).drop("_name"))


def label_from_turns(o: Ordered, turns: DataFrame) -> Ordered:
    return o_drop(name_by_appearance(assign_turns(o, turns), "source_speaker"), "source_speaker")


def o_drop(o: Ordered, *cols: str) -> Ordered:
    return o.of(o.df.drop(*cols))


# ---- labels from clusters ----------------------------------------------------


def fill_labels(o: Ordered, label: str = "label") -> Ordered:
    """Unlabelled rows take the last label before them, else the first after, else 0."""
    o = o.running({"_back": ("last", F.col(label))})
    o = o.running({"_ahead": ("last", F.col(label))}, reverse=True)
    return o.of(o.df.withColumn(label, F.coalesce("_back", "_ahead", F.lit(0))).drop("_back", "_ahead"))


def smooth_islands(o: Ordered, label: str = "label", short_ms: int = SHORT_ISLAND_MS) -> Ordered:
    """A B A with a short B becomes A A A, left to right.

    A changed row equals its right neighbour, so of a run of candidates every other one
    changes, starting with the first.
    """
    o = o.local({"_l": lambda w: F.lag(label).over(w), "_r": lambda w: F.lead(label).over(w)}, before=1, after=1)
    short = F.col("end_ms") - F.col("start_ms") < short_ms
    fires = F.coalesce((F.col("_l") == F.col("_r")) & (F.col("_l") != F.col(label)) & short, F.lit(False))
    o = o.with_columns({"_c": fires}).running({"_off": ("max", F.when(~F.col("_c"), F.col(POS)))})
    odd = (F.col(POS) - F.coalesce("_off", F.lit(-1).cast("bigint"))) % 2 == 1
    o = o.with_columns({label: F.when(F.col("_c") & odd, F.col("_l")).otherwise(F.col(label))})
    return o_drop(o, "_l", "_r", "_c", "_off")


def apply_labels(o: Ordered, labels: DataFrame) -> Ordered:
    """labels (media_id, idx, label) onto segments: fill, smooth, name."""
    df = o.df.join(labels.select("media_id", "idx", "label"), ["media_id", "idx"], "left")
    return o_drop(name_by_appearance(smooth_islands(fill_labels(o.of(df))), "label"), "label")


def label_status(o: Ordered, *, enabled: bool = True) -> DataFrame:
    """Whether a media is fit for labelling; ``reason`` is null when it is."""
    live = (F.length("text") > 0) & (F.col("end_ms") > F.col("start_ms"))
    stats = o.df.groupBy("media_id").agg(
        F.count_if(live).alias("segments"), F.count_distinct(F.when(live & (F.length("speaker") > 0), F.col("speaker"))).alias("existing")
    )
    few, many = F.col("segments") < MIN_ROWS, F.col("existing") > 1
    reason = F.lit("disabled") if not enabled else F.when(few, "too few segments").when(many, "speaker labels already exist")
    speakers = F.lit(0) if not enabled else F.when(few | ~many, 1).otherwise(F.col("existing"))
    return stats.select(
        "media_id", F.lit(enabled).alias("enabled"), speakers.cast("bigint").alias("speakers"), "segments", reason.alias("reason")
    )


def choose_backend(o: Ordered, preferred: DataFrame, fallback: DataFrame, backend: str = "auto") -> Ordered:
    """Per media the labels of the preferred backend, else of the fallback, with the reason.

    ``preferred`` / ``fallback``: media_id, idx, speaker, error (a failed media has rows
    with ``error`` set).  With an explicit backend a failure leaves rows as they are.
    """
    p = preferred.select("media_id", "idx", F.col("speaker").alias("_ps"), F.col("error").alias("_pe"))
    f = fallback.select("media_id", "idx", F.col("speaker").alias("_fs"), F.col("error").alias("_fe"))
    df = o.df.join(p, ["media_id", "idx"], "left").join(f, ["media_id", "idx"], "left")
    # One backend names all speakers of a media: the preferred one if it gave labels there and no error.
    media = lambda t, s, e: t.groupBy("media_id").agg(F.max(e).alias(f"{e}_media"), F.max(s).alias(f"{s}_media"))
    df = df.join(media(p, "_ps", "_pe"), "media_id", "left").join(media(f, "_fs", "_fe"), "media_id", "left")
    p_fine, f_fine = F.col("_pe_media").isNull() & F.col("_ps_media").isNotNull(), F.col("_fe_media").isNull() & F.col("_fs_media").isNotNull()
    df = df.withColumns({"_pok": p_fine, "_fok": f_fine, "_pe": F.col("_pe_media"), "_fe": F.col("_fe_media")})
    first, second = F.when(F.col("_pok"), F.coalesce("_ps", "speaker")), F.when(F.col("_fok"), F.coalesce("_fs", "speaker"))
    if backend == "auto":
        method = F.when(first.isNotNull(), "preferred").when(second.isNotNull(), "fallback").otherwise("none")
        note = F.when(first.isNull(), F.concat(F.lit("preferred failed: "), F.coalesce("_pe", F.lit("no result"))))
        speaker = F.coalesce(first, second, F.col("speaker"))
    else:
        own = first if backend == "preferred" else second
        error = F.col("_pe") if backend == "preferred" else F.col("_fe")
        method = F.when(own.isNotNull(), backend).otherwise("none")
        note = F.when(own.isNull(), F.coalesce(error, F.lit("no result")))
        speaker = F.coalesce(own, F.col("speaker"))
    return o.of(df.withColumn("method", method).withColumn("note", note).withColumn("speaker", speaker).drop("_ps", "_pe", "_fs", "_fe", "_pe_media", "_ps_media", "_fe_media", "_fs_media", "_pok", "_fok"))


# ---- clustering: every media and every k in the same passes -------------------


def standardise(features: DataFrame, dims: int) -> DataFrame:
    """Per media zero mean and unit population deviation (deviations below 1e-6 count as 1)."""
    x = lambda i: F.col("vec")[i].cast("double")
    stats = features.groupBy("media_id").agg(
        F.array(*[F.avg(x(i)) for i in range(dims)]).alias("_mean"), F.array(*[F.stddev_pop(x(i)) for i in range(dims)]).alias("_std")
    )
    centred = F.zip_with(F.col("vec").cast("array<double>"), F.col("_mean"), lambda a, m: a - m)
    scaled = F.zip_with(centred, F.col("_std"), lambda a, s: a / F.when(s < 1e-6, F.lit(1.0)).otherwise(s))
    return features.join(stats, "media_id").select("media_id", "idx", scaled.alias("vec"))


def _to_centres(vec, flat, dims: int, pick):
    """``pick`` of each row's distances to its own list of centres (rows with equally many go together)."""
    import numpy as np

    sizes = np.diff(flat.offsets.to_numpy()) // dims
    centres = flat.flatten().to_numpy(zero_copy_only=False)
    starts = (np.cumsum(sizes) - sizes) * dims
    out = np.zeros(len(vec))
    for k in np.unique(sizes):
        rows = np.flatnonzero(sizes == k)
        cs = centres[starts[rows][:, None] + np.arange(k * dims)[None, :]].reshape(len(rows), k, dims)
        out[rows] = pick(np.sqrt(((vec[rows][:, None, :] - cs) ** 2).sum(axis=2)))
    return out


def _vectors(batch, dims: int):
    return batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)


def _distances(columns: dict[str, str], dims: int, pick):
    """mapInArrow body: for each centres column a new column with ``pick`` of the distances."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            vec = _vectors(batch, dims)
            new = [pa.array(_to_centres(vec, batch.column(c), dims, pick), pa.float64()) for c in columns]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *columns.values()])

    return run


def _round_sums(dims: int):
    """mapInArrow body of one Lloyd round over packs of rows: per batch only sums per (media, k, label) leave the task."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        matrix = lambda v: v.values.to_numpy(zero_copy_only=False).reshape(-1, dims)
        nearest = lambda vec, cs: np.sqrt(((vec[:, None, :] - cs) ** 2).sum(axis=2)).argmin(axis=1)
        for batch in batches:
            found = {}
            for m, k, *own in zip(*[batch.column(c) for c in ("media_id", "k", "vecs", "c", "before")]):
                vec, c, before = map(matrix, own)
                label, old = nearest(vec, c), nearest(vec, before)
                for at in np.unique(label):
                    here = label == at
                    add = (int(here.sum()), int((old[here] != at).sum()), vec[here].sum(axis=0))
                    key = (m.as_py(), k.as_py(), int(at))
                    found[key] = tuple(x + y for x, y in zip(found[key], add)) if key in found else add
            if found:
                media, ks, labels = zip(*found)
                n, moved, sums = zip(*found.values())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(media, batch.column("media_id").type), pa.array(ks, pa.int32()), pa.array(labels, pa.int32()), pa.array(n, pa.int64()),
                        pa.array(moved, pa.int64()), pa.array(sums, pa.list_(pa.float64())),
                    ],
                    names=["media_id", "k", "label", "n", "moved", "s"],
                )

    return run


def _measure(df: DataFrame, columns: dict[str, str], dims: int, how: str) -> DataFrame:
    """Add per centres column the least distance (``min``) or the nearest centre, first on ties (``argmin``)."""
    pick = (lambda d: d.min(axis=1)) if how == "min" else (lambda d: d.argmin(axis=1))
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.DoubleType()) for n in columns.values())])
    return df.mapInArrow(_distances(columns, dims, pick), schema)


def initial_centres(rows: DataFrame, k: int, dims: int) -> DataFrame:
    """Farthest-first starts per media: (media_id, c = flat array of k centres, n, ids = the rows that they are).

    Each round adds, for all media at once, the row farthest from its nearest centre, of equally far ones that of the smallest idx.  Only
    centres are carried between rounds, as written tables.
    """
    first = rows.groupBy("media_id").agg(F.min_by("vec", "idx").alias("c"), F.count(F.lit(1)).alias("n"), F.array(F.min("idx")).alias("ids"))
    centres = materialise(first)
    for _ in range(k - 1):
        far = _measure(rows.join(centres.select("media_id", "c"), "media_id"), {"c": "d"}, dims, "min")
        new = far.groupBy("media_id").agg(F.max_by(F.struct("vec", "idx"), F.struct("d", -F.col("idx"))).alias("v"))
        centres = materialise(centres.join(new, "media_id").select("media_id", F.concat("c", "v.vec").alias("c"), "n", F.concat("ids", F.array("v.idx")).alias("ids")))
    return centres


def kmeans(rows: DataFrame, starts: DataFrame, dims: int, rounds: int = MAX_ROUNDS) -> DataFrame:
    """Lloyd rounds for every (media, k) at once -> final centres (media_id, k, c).

    ``starts``: media_id, k, c.  A round is one pass over the rows: the labels under the
    previous and the current centres are both derived there, so only centres are kept.  A
    (media, k) whose labels did not change leaves the loop; an empty cluster keeps its centre.
    """
    key = rows.schema["media_id"].dataType.simpleString()
    # Packs of rows, so that centres are not copied beside every row in every round.
    packed = F.array_sort(F.collect_list(F.struct("idx", "vec")))
    packs = rows.groupBy("media_id", F.expr(f"idx div {PACK}").alias("_p")).agg(F.flatten(F.transform(packed, lambda r: r["vec"])).alias("vecs"))
    packs = materialise(packs.drop("_p"))
    mean = F.expr("array(" + ", ".join(f"sum(s[{i}]) / sum(n)" for i in range(dims)) + ")")
    active = materialise(starts.select("media_id", "k", "c", F.lit(None).cast("array<double>").alias("before")))
    done = None
    for _ in range(rounds):
        joined = packs.join(active, "media_id")
        joined = joined.withColumn("before", F.coalesce("before", F.slice("c", 1, dims)))  # the first labels are all 0
        sums = joined.select("media_id", "k", "vecs", "c", "before").mapInArrow(
            _round_sums(dims), f"media_id {key}, k int, label int, n bigint, moved bigint, s array<double>"
        )
        stats = sums.groupBy("media_id", "k", "label").agg(mean.alias("mean"), F.sum("moved").alias("moved"))
        means = F.map_from_entries(F.collect_list(F.struct("label", "mean")))  # at most k entries
        moved = stats.groupBy("media_id", "k").agg(F.sum("moved").alias("moved"), means.alias("means"))
        keep = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.coalesce(F.try_element_at("means", i), F.slice("c", i * dims + 1, dims)))
        step = materialise(active.drop("before").join(moved, ["media_id", "k"]).select("media_id", "k", "moved", F.col("c").alias("before"), F.flatten(keep).alias("c")))
        # Labels of a settled run are those under the centres it was last assigned with.
        settled = step.filter("moved = 0").select("media_id", "k", F.col("before").alias("c"))
        done = settled if done is None else done.unionByName(settled)
        active = step.filter("moved > 0").select("media_id", "k", "c", "before")
        if active.isEmpty():
            return done
    return done.unionByName(active.select("media_id", "k", F.col("before").alias("c")))


def label_rows(rows: DataFrame, centres: DataFrame, dims: int) -> DataFrame:
    out = _measure(rows.join(centres, "media_id"), {"c": "label"}, dims, "argmin")
    return out.select("media_id", F.col("k").cast("int").alias("k"), "idx", F.col("label").cast("int").alias("label"))


def silhouettes(rows: DataFrame, labels: DataFrame, dims: int, max_k: int = MAX_K) -> DataFrame:
    """Mean silhouette per (media, k).

    The measure needs every distance inside a media.  They are products of blocks and strips of rows, which leave only sums
    (``_distance_sums``), so pairs of rows are never emitted and a large media spreads over its strips.
    """
    sums = _distance_sums(rows, labels, dims, max_k)
    sums = sums.groupBy("media_id", "k", "idx").agg(*[F.sum(f"s{c}").alias(f"s{c}") for c in range(max_k)])
    sizes = labels.groupBy("media_id", "k").agg(*[F.count_if(F.col("label") == c).alias(f"n{c}") for c in range(max_k)])
    rows_k = sums.join(labels, ["media_id", "k", "idx"]).join(sizes, ["media_id", "k"])
    pick = lambda p: F.element_at(F.array(*[F.col(f"{p}{c}") for c in range(max_k)]), F.col("label") + 1)
    a = F.when(pick("n") > 1, pick("s") / (pick("n") - 1)).otherwise(F.lit(0.0))
    others = [F.when((F.col("label") != c) & (F.col(f"n{c}") > 0), F.col(f"s{c}") / F.col(f"n{c}")) for c in range(max_k)]
    scored = rows_k.select("media_id", "k", a.alias("a"), F.least(*others).alias("b"))
    score = (F.col("b") - F.col("a")) / F.greatest("a", "b", F.lit(1e-6))
    return scored.groupBy("media_id", "k").agg(F.coalesce(F.avg(F.when(F.col("b").isNotNull(), score)), F.lit(-1.0)).alias("silhouette"))


def _distance_sums(rows: DataFrame, labels: DataFrame, dims: int, max_k: int) -> DataFrame:
    """(media_id, idx, k, s0, s1, ...): parts of each row's summed distances to the rows of every cluster.

    A block has ``BLOCK`` rows, a strip ``STRIP`` blocks.  A strip meets the blocks up to its own last one, ``REACH`` of them in one task, and
    each distance counts for both of its rows.  A block leaves its sums once per strip, a strip once per ``REACH`` blocks.
    """
    packed_labels = labels.groupBy("media_id", "idx").agg(F.map_from_entries(F.collect_list(F.struct("k", "label"))).alias("_m"))
    ks = [r[0] for r in labels.select("k").distinct().orderBy("k").collect()]  # a handful of numbers
    by_k = F.array(*[F.coalesce(F.try_element_at("_m", F.lit(k)), F.lit(-1)) for k in ks]).cast("array<int>")
    o = arrange(rows.join(packed_labels, ["media_id", "idx"]).select("media_id", "idx", "vec", by_k.alias("l")), ("media_id",), ("idx",))
    placed = o.df.withColumn("b", F.expr(f"{POS} div {BLOCK}")).withColumn("strip", F.expr(f"b div {STRIP}"))
    lists = lambda n: [F.collect_list("idx").alias(f"ids{n}"), F.flatten(F.collect_list("vec")).alias(f"v{n}"), F.flatten(F.collect_list("l")).alias(f"l{n}")]
    blocks = placed.groupBy("media_id", "strip", "b").agg(*lists(1))
    ends = placed.groupBy("media_id").agg((F.max("strip")).alias("last"))
    left = blocks.join(ends, "media_id").withColumn("strip", F.explode(F.sequence("strip", "last"))).drop("last")
    left = left.withColumn("reach", F.expr(f"b div {REACH}"))
    strips = placed.groupBy("media_id", "strip").agg(F.collect_list("b").alias("b2"), *lists(2))
    right = strips.withColumn("reach", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"((strip + 1) * {STRIP} - 1) div {REACH}"))))
    key = rows.schema["media_id"].dataType.simpleString()
    # Merged by key, so that a strip's blocks come one after the other.
    return left.join(right.hint("merge"), ["media_id", "strip", "reach"]).mapInArrow(
        _strip_sums(ks, dims, max_k), f"media_id {key}, idx bigint, k int, " + ", ".join(f"s{c} double" for c in range(max_k))
    )


def _distance(a, b):
    import numpy as np

    size = (a**2).sum(1)[:, None] + (b**2).sum(1)[None, :]
    squares = size - 2 * a @ b.T
    # The expansion loses digits near zero; equal rows must be exactly 0 apart.
    r, c = np.nonzero(squares < 1e-6 * (size + 1))
    squares[r, c] = ((a[r] - b[c]) ** 2).sum(1)
    return np.sqrt(np.maximum(squares, 0))


def _strip_sums(ks, dims, width):
    """mapInArrow body: the sums of each block on the way, those of a strip when the next one begins."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def members(labels):
            """A column of zeros and ones for each k and cluster."""
            return (labels.reshape(-1, len(ks), 1) == np.arange(width)).reshape(len(labels), -1).astype(float)

        def out(media, ids, sums):
            for at, k in enumerate(ks):
                s = sums[:, at * width : (at + 1) * width]
                if own[:, at * width : (at + 1) * width].any():  # the strip has labels of this k
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([media] * len(s), key), pa.array(ids, pa.int64()), pa.array([k] * len(s), pa.int32()), *[pa.array(s[:, c]) for c in range(width)]],
                        names=["media_id", "idx", "k", *[f"s{c}" for c in range(width)]],
                    )

        matrix = lambda v, n: v.values.to_numpy(zero_copy_only=False).reshape(-1, n)
        held = None
        for batch in batches:
            key = batch.column("media_id").type
            for place in range(batch.num_rows):
                row = {name: batch.column(name)[place] for name in batch.schema.names}
                now = tuple(row[c].as_py() for c in ("media_id", "strip", "reach"))
                if held != now:
                    if held:
                        yield from out(held[0], ids, total)
                    held, ids = now, row["ids2"].values.to_numpy()
                    v2, own, block = matrix(row["v2"], dims), members(matrix(row["l2"], len(ks))), row["b2"].values.to_numpy()
                    total = np.zeros_like(own)
                b, v1, mine = row["b"].as_py(), matrix(row["v1"], dims), members(matrix(row["l1"], len(ks)))
                sums, later = np.zeros_like(mine), np.flatnonzero(block >= b)
                for cut in range(0, len(later), WIDE):
                    cols = later[cut : cut + WIDE]
                    dist = _distance(v1, v2[cols])
                    sums += dist @ own[cols]
                    both = block[cols] > b  # the block itself has its sums already
                    total[cols[both]] += dist[:, both].T @ mine
                yield from out(now[0], row["ids1"].values.to_numpy(), sums)
        if held:
            yield from out(held[0], ids, total)

    return run


def cluster_labels(features: DataFrame, dims: int, *, max_speakers: int = 4, target_speakers: int | None = None) -> DataFrame:
    """(media_id, idx, vec) -> (media_id, idx, label): k-means with a given or silhouette-chosen k.

    Fewer than four rows, or no k that separates well enough, give one cluster.
    """
    sizes = features.groupBy("media_id").agg(F.count(F.lit(1)).alias("n"))
    rows = materialise(standardise(features.join(sizes.filter(F.col("n") >= MIN_ROWS), "media_id", "left_semi"), dims))
    top = min(target_speakers, MAX_K) if target_speakers and target_speakers > 1 else min(max(1, max_speakers), 6)
    chosen = None
    if top > 1:
        starts = initial_centres(rows, top, dims)
        if target_speakers and target_speakers > 1:
            k = F.least(F.lit(top), F.col("n")).cast("int")
            starts = starts.select("media_id", k.alias("k"), F.slice("c", 1, k * dims).alias("c"))
            chosen = label_rows(rows, kmeans(rows, starts, dims), dims)
        else:
            ks = starts.select("media_id", "c", F.explode(F.sequence(F.lit(2), F.least(F.lit(top), F.col("n")).cast("int"))).alias("k"))
            starts = ks.select("media_id", "k", F.slice("c", F.lit(1), F.col("k") * dims).alias("c"))
            labels = materialise(label_rows(rows, kmeans(rows, starts, dims), dims))
            scores = silhouettes(rows, labels, dims)
            best = scores.groupBy("media_id").agg(F.max_by(F.struct("k", "silhouette"), F.struct("silhouette", -F.col("k"))).alias("b"))
            best = best.filter(F.col("b.silhouette") >= MIN_SILHOUETTE).select("media_id", F.col("b.k").alias("k"))
            chosen = labels.join(best, ["media_id", "k"])
    base = features.select("media_id", "idx")
    if chosen is None:
        return base.withColumn("label", F.lit(0))
    out = base.join(chosen.select("media_id", "idx", "label"), ["media_id", "idx"], "left")
    return out.withColumn("label", F.coalesce("label", F.lit(0)))


def distinct_speakers(o: Ordered) -> DataFrame:
    """Speaker, segment and duration figures per media."""
    return o.df.groupBy("media_id").agg(
        F.count_distinct("speaker").alias("speakers"), F.count(F.lit(1)).alias("segments"), F.max("end_ms").alias("duration_ms")
    )



def timeline_durations(o: Ordered, media: DataFrame) -> DataFrame:
    """(media_id, duration_ms): the later of the last segment's end and the media's own length.

    ``media``: media_id, duration_ms.  Media without segments, and segments of media that ``media`` does not list, count too; a missing or
    negative length counts as 0, and of several lengths the greatest.
    """
    ends = o.df.select("media_id", F.col("end_ms").alias("at")).unionByName(media.select("media_id", F.col("duration_ms").alias("at")))
    return ends.groupBy("media_id").agg(F.greatest(F.lit(0), F.max("at")).cast("bigint").alias("duration_ms"))
