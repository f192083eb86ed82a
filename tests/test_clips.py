"""Clip windows against their definition, overlap removal in both plans, rebasing."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cuesheet.operators import clips as cl
from cuesheet.operators import intervals as iv

SCHEMA = "media_id bigint, idx bigint, start_ms bigint, end_ms bigint, speaker string, text string"


def rows_of(seed, n=70, nested=True):
    rng = random.Random(seed)
    bits = ["所", "以", "why?", "no", "way", "the point", "is good", "为什", "么", "ok.", "so it goes!", "what", "happened", "İx", "plain words here"]
    rows = []
    for m in range(3):
        t = 0
        for i in range(1, n + 1):
            t += rng.choice([100, 900, 3000, 5000, 14000 if i % 20 == 0 else 200])
            d = rng.choice([2000, 4000, 8000, 90_000 if nested and i % 17 == 0 else 3000])
            rows.append((m, i, t, t + d, "S01", " ".join(rng.choices(bits, k=rng.randint(1, 2)))))
            t += 2500
    return rows


def test_windows_are_all_spans_of_the_right_length(spark):
    """Without nested rows: every span of 45 to 180 s with no gap over 12 s, and its counts as sums over its rows."""
    rows = rows_of(2, nested=False)
    cands, _ = cl.candidate_windows(spark.createDataFrame(rows, SCHEMA))
    got = {(r.media_id, r.i, r.j): (r.pauses, r.questions, r.puncts) for r in cands.collect()}
    want = {}
    for m in range(3):
        seq = sorted((s, e, t) for mm, _, s, e, _, t in rows if mm == m)
        gaps = [b[0] - a[1] for a, b in zip(seq, seq[1:])]
        spans = [(a, b) for a in range(len(seq)) for b in range(a, len(seq)) if seq[b][1] - seq[a][0] >= 45_000 and max(r[1] for r in seq[a : b + 1]) - seq[a][0] <= 180_000 and max(gaps[a:b], default=0) <= 12_000]
        for a, b in spans:
            text = "".join(r[2] for r in seq[a : b + 1])
            want[m, a, b] = (sum(450 <= g <= 4000 for g in gaps[a:b]), len([c for c in text if c in "?？"]), len([c for c in text if c in "!！?？。"]))
    assert got == want and want


def test_chunked_windows_and_rounds_equal_the_plain_plan(spark):
    rows = rows_of(4, nested=False)
    results = []
    for limit in ("1000000", "25"):
        spark.conf.set("spark.cuesheet.maxGroupRows", limit)
        cands, o = cl.candidate_windows(spark.createDataFrame(rows, SCHEMA))
        assert o.chunked == (limit == "25")
        kept = cl.drop_overlapping(cands, hot=o.chunked)
        results.append(sorted((r.media_id, r.i, r.j, r.score) for r in kept.collect()))
    spark.conf.unset("spark.cuesheet.maxGroupRows")
    assert results[0] == results[1] and results[0]


def test_kept_clips_do_not_overlap_too_much(spark):
    cands, _ = cl.candidate_windows(spark.createDataFrame(rows_of(6), SCHEMA))
    kept = cl.drop_overlapping(cands).collect()
    for a in kept:
        for b in kept:
            if a is not b and a.media_id == b.media_id:
                shared = min(a.end_ms, b.end_ms) - max(a.start_ms, b.start_ms)
                assert shared * 100 <= 65 * max(1000, min(a.end_ms - a.start_ms, b.end_ms - b.start_ms))


def test_twenty_segments_give_ranked_clips(spark):
    rows = [(1, i + 1, i * 10_000, i * 10_000 + 8000, "S01", "why is this the key problem?") for i in range(20)]
    out = cl.clip_candidates(spark.createDataFrame(rows, SCHEMA), limit=3).orderBy("rank").collect()
    assert [r.id for r in out] == [f"clip_{k:03d}" for k in range(1, len(out) + 1)] and out
    assert all(45_000 <= r.end_ms - r.start_ms <= 180_000 for r in out)
    assert all("hook" in r.reason and "question" in r.reason for r in out)


def test_rebase_case(spark):
    rows = [(1, 1, 57_000, 63_500, "S01", "a"), (1, 2, 66_000, 68_000, "S01", "b"), (1, 3, 88_000, 99_000, "S01", "c")]
    clips = spark.createDataFrame([(1, 1, 60_000, 90_000)], "media_id bigint, clip_id int, clip_start_ms bigint, clip_end_ms bigint")
    out = iv.rebase_to_clips(spark.createDataFrame(rows, SCHEMA), clips).orderBy("idx").collect()
    assert [(r.start_ms, r.end_ms, r.id) for r in out] == [
        (0, 3500, "clip_seg_0001"), (6000, 8000, "clip_seg_0002"), (28_000, 30_000, "clip_seg_0003"),
    ]


def test_long_rows_meet_in_every_bucket_once(spark):
    left = spark.createDataFrame([(1, 1, 0, 500_000), (1, 2, 30_000, 90_000)], "media_id bigint, a int, ls bigint, le bigint")
    right = spark.createDataFrame([(1, 7, 10_000, 400_000), (1, 8, 500_000, 500_001)], "media_id bigint, b int, rs bigint, re bigint")
    got = iv.overlapping(left, right, ("ls", "rs"), ("le", "re")).select("a", "b").orderBy("a", "b").collect()
    assert [tuple(r) for r in got] == [(1, 7), (2, 7)]


def test_flattening_case_and_cover(spark):
    rows = [(1, 1, 1000, 5000, "S01", "first"), (1, 2, 3000, 4000, "S02", "second")]
    from cuesheet.ordering import arrange

    df = spark.createDataFrame(rows, SCHEMA)
    out = iv.flatten_overlaps(arrange(df)).orderBy("event_no").collect()
    assert [(r.start_ms, r.end_ms, r.text) for r in out] == [(1000, 3000, "first"), (3000, 4000, "first\\Nsecond"), (4000, 5000, "first")]
    many = spark.createDataFrame(rows_of(8), SCHEMA)
    events = iv.flatten_overlaps(arrange(many)).filter(F.col("media_id") == 0).collect()
    shown = set()
    for e in events:
        shown.update(range(e.start_ms, e.end_ms, 100))
    want = set()
    for m, _, s, e, _, _ in rows_of(8):
        if m == 0:
            want.update(range(s, e, 100))
    assert shown == want


def interval_rows(n, seed):
    """Random intervals of very different lengths around random points, in a few media."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        lo = rng.choice([0, 2**15, 2**20]) + rng.randrange(-3, 200_000)
        rows.append((rng.randrange(3), k, lo, lo + rng.choice([-5, 0, 1, 700, 2**15 - 1, 2**15, 2**15 + 1, 100_000, 2**21, 10**9])))
    return rows


@pytest.mark.parametrize("base_bits", [iv.BASE_BITS, 4])
def test_pairs_of_all_lengths(spark, base_bits):
    left, right = interval_rows(60, 1), interval_rows(50, 2)
    a = spark.createDataFrame(left, "media_id bigint, a int, ls bigint, le bigint")
    b = spark.createDataFrame(right, "media_id bigint, b int, rs bigint, re bigint")
    got = [tuple(r) for r in iv.overlapping(a, b, ("ls", "rs"), ("le", "re"), base_bits=base_bits).select("a", "b").collect()]
    want = [(i, j) for m, i, s, e in left for n, j, t, f in right if m == n and e > s and f > t and s < f and t < e]
    assert sorted(got) == sorted(want) and len(want) > 100
    points = spark.createDataFrame([(m, k, s) for m, k, s, _ in left], "media_id bigint, a int, at bigint")
    got = [tuple(r) for r in iv.points_in_intervals(points, b, "at", "rs", "re", base_bits=base_bits).select("a", "b").collect()]
    assert sorted(got) == sorted((i, j) for m, i, s, _ in left for n, j, t, f in right if m == n and t <= s < f)
    assert not iv.points_in_intervals(points, b.filter("false"), "at", "rs", "re").count() and not iv.overlapping(a, b.filter("false"), ("ls", "rs"), ("le", "re")).count()


TEN_YEARS = 315_360_000_000


def test_one_segment_of_ten_years(spark):
    """No operator makes more rows of it than its few cells; every other row meets it once."""
    from cuesheet.operators import audio, speakers
    from cuesheet.ordering import arrange

    rows = [(1, 1, 0, TEN_YEARS, "S01", "always"), *[(1, k, 1_000_000 * k, 1_000_000 * k + 2_000, "S02", f"t{k}") for k in range(2, 40)]]
    df = spark.createDataFrame(rows, SCHEMA)
    o = arrange(df)
    pieces = df.filter("end_ms > start_ms").withColumn("c", iv.cells(F.col("start_ms"), F.col("end_ms"), iv.grid_level(F.col("start_ms"), F.col("end_ms"))))
    assert pieces.select(F.max(F.size("c"))).first()[0] <= 2
    points = df.select("media_id", F.col("idx").alias("point_id"), (F.col("start_ms") + 1).alias("at_ms"))
    assert {r.seg_idx for r in iv.visible_at(points, df).collect()} == {1}
    assert {r.shown for r in iv.text_at(points, df).collect()} == {"always"} | {f"always\nt{k}" for k in range(2, 40)}
    events = iv.flatten_overlaps(o).collect()
    assert len(events) == 77 and sum(e.end_ms - e.start_ms for e in events) == TEN_YEARS
    clips = spark.createDataFrame([(1, 1, 0, TEN_YEARS), (1, 2, 2_000_500, 2_001_000)], "media_id bigint, clip_id int, clip_start_ms bigint, clip_end_ms bigint")
    assert iv.rebase_to_clips(df, clips).count() == 39 + 2
    turns = spark.createDataFrame([(1, 1, 0, TEN_YEARS, "A"), (1, 2, 5_000_000, 5_001_500, "B")], "media_id bigint, turn_no bigint, turn_start_ms bigint, turn_end_ms bigint, source string")
    assert {r.source_speaker for r in speakers.assign_turns(o, turns).df.collect()} == {"A"}
    pcm = spark.createDataFrame([(1, 10_000 * k, [float(k)] * 10_000) for k in range(20)], "media_id bigint, first_sample bigint, samples array<double>")
    want = spark.createDataFrame([(1, 1, 0, TEN_YEARS), (1, 2, 3_000, 4_000)], "media_id bigint, idx bigint, start_ms bigint, end_ms bigint")
    assert {(r.idx, r.n) for r in audio.slice_segments(want, pcm, 1000).select("idx", F.size("samples").alias("n")).collect()} == {(1, 199_960), (2, 920)}


def test_grid_rows_in_the_plan(spark):
    """Of the rows that each side sends to the join, counted in the executed plan."""
    a = spark.createDataFrame([(1, 1, 0, TEN_YEARS)] + [(1, k, k * 40_000, k * 40_000 + 2_000) for k in range(2, 202)], "media_id bigint, a bigint, ls bigint, le bigint")
    points = a.select("media_id", F.col("a").alias("p"), F.col("ls").alias("at"))
    found = iv.points_in_intervals(points, a.drop("p"), "at", "ls", "le")
    assert found.count() == 401
    i = a.withColumn("_l", iv.grid_level(F.col("ls"), F.col("le"))).select(F.explode(iv.cells(F.col("ls"), F.col("le"), F.col("_l"))))
    assert i.count() <= 2 * 201


def test_slices_are_planned_without_samples(spark, monkeypatch):
    """Samples are neither broadcast nor gathered, whatever Spark takes their size to be, and features hold a bounded number at once."""
    import re

    import numpy as np

    from cuesheet.operators import audio

    waves = {(m, f): np.sin(np.arange(4000) * (0.1 + 0.05 * m) + f).astype("float32") for m in (1, 2) for f in (0, 4000, 8000)}
    pcm = spark.createDataFrame([(m, f, w.tolist()) for (m, f), w in waves.items()], "media_id bigint, first_sample bigint, samples array<float>")
    want = spark.createDataFrame([(m, i, i * 500, i * 500 + 1500) for m in (1, 2) for i in range(9)], "media_id bigint, idx bigint, start_ms bigint, end_ms bigint")
    whole = audio.slice_segments(want, pcm, 2000)
    assert re.search(r"SortMergeJoin \[media_id#\d+L?, first_sample#", whole._jdf.queryExecution().executedPlan().toString())
    cuts = audio.plan_slices(want, pcm.select("media_id", "first_sample", F.size("samples").alias("n")), 2000)
    read = audio.read_slices(cuts.withColumn("cuts", F.transform("cuts", lambda c: c.withField("m", F.col("media_id")))), lambda c: waves[c["m"], c["first_sample"]][c["skip"] : c["skip"] + c["length"]])
    rows = lambda df: sorted((r.media_id, r.idx, r[2]) for r in df.collect())
    assert rows(read) == rows(whole) and len(rows(whole)) == 18
    for m, i, samples in rows(whole):
        lo, hi = max(0, (i * 500 + 40) * 2), min(12_000, (i * 500 + 1460) * 2)
        assert samples == np.concatenate([waves[m, f] for f in (0, 4000, 8000)])[lo:hi].tolist()
    every = rows(audio.audio_features(whole, 2000))
    assert every
    monkeypatch.setattr(audio, "SAMPLES_AT_ONCE", 3000)
    few = rows(audio.audio_features(whole, 2000))
    assert [r[:2] for r in few] == [r[:2] for r in every] and np.allclose([r[2] for r in few], [r[2] for r in every], atol=1e-5)


def test_windows_stream_by_bucket(spark):
    """Rows are sorted, windows never; buckets that span several Arrow batches give the same windows."""
    rows = [(m, i, 900 * i + 70 * m, 900 * i + 70 * m + 1500, "S01", f"why {i}. but wait" if i % 3 else "no") for m in (1, 2) for i in range(150)]
    rows += [(3, i, 400_000 * i, 400_000 * i + 60_000, "S01", "alone") for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    cands, _ = cl.candidate_windows(df, min_ms=20_000)
    plan = cands._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
    want = sorted(map(tuple, cands.collect()))
    assert {r[0] for r in want} == {1, 2, 3} and len([r for r in want if r[0] == 3]) == 40
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        assert sorted(map(tuple, cl.candidate_windows(df, min_ms=20_000)[0].collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_rankings_read_candidates_written_once(spark):
    """The picks and the counts read a table; neither computes the candidates again."""
    from cuesheet.queries.clips import query

    plan = query.queries["clip_ranking_outcomes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "InArrow" not in plan and "MapIn" not in plan


@pytest.mark.parametrize(("limit", "at_once", "part", "rows_a_batch"), [(1_000_000, 1 << 18, 64, 10_000), (1_000_000, 40, 64, 16), (25, 40, 3, 16)])
def test_windows_are_dropped_where_they_are_made(spark, monkeypatch, limit, at_once, part, rows_a_batch):
    """Stretches, batches and parts of any size keep what the walk over all windows keeps; equal scores and long blocks included."""
    monkeypatch.setattr(cl, "AT_ONCE", at_once)
    monkeypatch.setattr(cl, "PART", part)
    rows = rows_of(4) + [(m + 3, *r) for m, *r in rows_of(11, n=150, nested=False)]
    rows += [(7, i, 3_000 * i, 3_000 * i + 2_500, "S01", "the same again") for i in range(700 if limit > 25 else 90)]
    rows += [(8, i, 90_000 * i, 90_000 * i + 80_000, "S01", "far apart") for i in range(20)] + [(9, 1, 0, 50_000, "S01", "alone"), (10, 1, 0, 900, "S01", "short")]
    df = spark.createDataFrame(rows, SCHEMA)
    cands, _ = cl.candidate_windows(df)
    want = sorted(map(tuple, cl.drop_overlapping(cands).collect()))
    spark.conf.set("spark.cuesheet.maxGroupRows", str(limit))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows_a_batch))
    try:
        kept, o = cl.kept_windows(df)
        assert o.chunked == (limit == 25)
        assert sorted(map(tuple, kept.select(*cands.columns).collect())) == want and {r[0] for r in want} == {0, 1, 2, 3, 4, 5, 7, 8, 9}
    finally:
        spark.conf.unset("spark.cuesheet.maxGroupRows")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_clips_shuffle_no_windows(spark):
    """Of a task's windows only the best of a media leave it, and the texts meet the clips where they are: no exchange follows the join."""
    from cuesheet.plans import derived

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = cl.clip_candidates(derived.document_segments(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    steps = re.findall(r"^[\s:+-]*(Exchange|MapInArrow|WindowGroupLimit|SortMergeJoin|ObjectHashAggregate)\b", plan, re.M)
    texts, figures = ["Exchange"], ["Exchange", "WindowGroupLimit", "MapInArrow", "Exchange", "Exchange"]
    assert steps == ["ObjectHashAggregate"] * 2 + ["SortMergeJoin"] + texts + ["WindowGroupLimit"] + figures
