"""Clean-up operators: small cases, properties on random rows, and the chunked plan."""

import random

import pytest
from pyspark.sql import functions as F

from cuesheet.functions import text as tx
from cuesheet.operators import segments as sg
from cuesheet.ordering import arrange

SCHEMA = "media_id bigint, idx bigint, start_ms bigint, end_ms bigint, speaker string, text string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def random_rows(seed, medias=5, n=60):
    rng = random.Random(seed)
    words = ["好", "ok", "then，", "go. ", "什么", "a", "well well", "《x》", "trim ", "longer words here, and there"]
    rows = []
    for m in range(medias):
        t = 0
        for i in range(1, n + 1):
            t = max(0, t + rng.choice([-300, 0, 0, 100, 250, 400, 2000]))
            d = rng.choice([0, 200, 900, 1500, 7000])
            rows.append((m, i, t, t + d, rng.choice(["S01", "S01", "S02"]), " ".join(rng.choices(words, k=rng.randint(1, 4)))))
            t += d
    return rows


def test_merge_then_split_cases(spark):
    df = frame(spark, [(1, 1, 0, 1500, "S01", "早上"), (1, 2, 1600, 2900, "S01", "天气")])
    out = sg.normalize(df).df.select("start_ms", "end_ms", "text", "id").collect()
    assert [tuple(r) for r in out] == [(0, 2900, "早上天气", "seg_0001")]


def test_overlap_case(spark):
    df = frame(spark, [(1, 1, 100, 350, "S01", "a"), (1, 2, 300, 700, "S02", "b")])
    out = sg.fix_overlaps(sg.prepare(df)).df.orderBy("_pos").select("start_ms", "end_ms").collect()
    assert [tuple(r) for r in out] == [(100, 1100), (1100, 2100)]


def bare(texts):
    return "".join("".join(texts).split())


@pytest.mark.parametrize("limit", [1_000_000, 7])
def test_overlaps_and_merges_keep_their_promises(spark, limit):
    """Rows begin at their own time or where the row before ends, last long enough, and lose no text; values against
    the SQL twins are in test_queries."""
    rows = random_rows(limit)
    o = sg.fix_overlaps(arrange(sg.cleaned_rows(frame(spark, rows)), order=sg.BY_TIME, limit=limit), 500)
    assert o.chunked == (limit == 7)
    fixed, joined = o.df.orderBy("media_id", "_pos").collect(), sg.merge_adjacent(o).df.orderBy("media_id", "_pos").collect()
    for media in range(5):
        given = sorted((r[2], r[3], r[1], r[5]) for r in rows if r[0] == media)
        f, m = [r for r in fixed if r.media_id == media], [r for r in joined if r.media_id == media]
        assert len(f) == len(given)
        ends = [0, *(r.end_ms for r in f)]
        assert all(r.start_ms == max(g[0], before) and r.end_ms == max(g[1], r.start_ms + 500) for r, g, before in zip(f, given, ends))
        assert bare(r.text for r in m) == bare(g[3] for g in given) and len(m) <= len(f)
        assert all(a.end_ms <= b.start_ms for a, b in zip(m, m[1:]))
        assert {r.start_ms for r in m} <= {r.start_ms for r in f} and {r.end_ms for r in m} <= {r.end_ms for r in f}
        assert all(len({x.speaker for x in f if r.start_ms <= x.start_ms < r.end_ms}) == 1 for r in m)


def test_hot_plan_equals_plain_plan(spark):
    rows = random_rows(3, medias=2, n=200)
    cols = ["media_id", "idx", "id", "start_ms", "end_ms", "speaker", "text"]
    result = []
    for limit in ("1000000", "11"):
        spark.conf.set("spark.cuesheet.maxGroupRows", limit)
        df = frame(spark, rows).withColumn("text", F.expr("if(idx % 5 < 4, 'Ok, then!', text)"))
        a = [tuple(r) for r in sg.normalize(df).df.select(*cols).collect()]
        b = [tuple(r) for r in sg.drop_repeated_phrases(df).select("media_id", "idx").collect()]
        result.append((sorted(a), sorted(b)))
    spark.conf.unset("spark.cuesheet.maxGroupRows")
    assert result[0] == result[1]


def test_normalised_rows_do_not_overlap(spark):
    rows = sg.normalize(frame(spark, random_rows(9))).df.orderBy("media_id", "_pos").collect()
    for a, b in zip(rows, rows[1:]):
        if a.media_id == b.media_id:
            assert b.start_ms >= a.end_ms and b.end_ms - b.start_ms >= 1000


def test_split_text_is_short_and_whole(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices("ab 。，!好x", k=rng.randint(1, 120))) for _ in range(300)]
    for n in (24, 7, 2, 1):
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        for r in df.select("t", tx.split_long_text(F.col("t"), n).alias("p")).collect():
            assert bare(r.p) == bare([r.t]) and all(len(p) <= n + 1 for p in r.p)  # two pieces may be joined by a space
            assert len(r.p) == 1 if len(r.t.strip()) <= n else all(r.p)


def test_phrase_guard_keeps_three_in_a_row(spark):
    df = frame(spark, [(1, i, i, i + 1, "S00", "Same phrase!") for i in range(1, 7)])
    flags = [r.repeated for r in sg.mark_repeated_phrases(arrange(df)).df.orderBy("idx").collect()]
    assert flags == [False] * 3 + [True] * 3


def test_coerce_keeps_order_and_times(spark):
    df = frame(spark, [(1, 1, 5000, 4000, None, None), (1, 2, 0, 10, "", "x")])
    out = sg.coerce_segments(df).orderBy("idx").collect()
    assert [(r.id, r.start_ms, r.end_ms, r.speaker, r.text) for r in out] == [
        ("seg_0001", 5000, 4000, "S00", ""), ("seg_0002", 0, 10, "S00", "x"),
    ]


def test_normalize_uses_two_shuffles(spark, capsys):
    plan = sg.normalize(frame(spark, random_rows(1)))
    text = plan.df._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") <= 2
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
