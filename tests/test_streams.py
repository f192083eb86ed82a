"""Streams: rows of a key in any order, noise, ends that free their state."""

import pytest

from cuesheet.operators import jobs as jb
from cuesheet.streaming import jobs as st


def drained(spark, folder, df, name, make):
    """(result rows, folder of the checkpoint) of a stream over ``df``, one file per batch."""
    st.use_rocksdb(spark)
    df.repartition(3).write.parquet(f"{folder}/{name}-in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{name}-in")
    rows = st.run_once(make(stream), f"{folder}/{name}-out", f"{folder}/{name}-check").collect()
    return rows, f"{folder}/{name}-check"


def held(spark, checkpoint, name, kind="value"):
    reader = spark.read.format("statestore").option("stateVarName", name)
    return (reader.option("flattenCollectionTypes", "true") if kind != "value" else reader).load(checkpoint).count()


LINES = [
    'data: {"choices":[{"delta":{"content":"al"}}],"usage":{"prompt_tokens":3,"completion_tokens":1}}', "event: ping", "data: {broken", "data: [1]", "data:",
    'data: {"choices":[{"delta":{"content":"pha"}}],"usage":{"prompt_tokens":null,"completion_tokens":2}}', 'data: {"choices":[{"delta":null}],"usage":null}', "data: [DONE]",
]


def test_deltas_with_noise_equal_the_batch(spark, tmp_path):
    rows = [(s, i + 1, line) for s in ("a", "b") for i, line in enumerate(LINES)]
    df = spark.createDataFrame(rows, "stream_id string, seq bigint, line string")
    got, checkpoint = drained(spark, f"file://{tmp_path}", df, "deltas", st.fold_deltas_stream)
    want = [("a", "alpha", 3, 2), ("b", "alpha", 3, 2)]
    assert sorted(tuple(r) for r in got) == want == sorted(tuple(r) for r in jb.fold_deltas(df).collect())
    assert [held(spark, checkpoint, n) for n in ("place", "usage", "mark")] == [0, 0, 2]
    assert held(spark, checkpoint, "pieces", "list") == held(spark, checkpoint, "waiting", "map") == 0


def test_transcripts_free_their_state_at_the_end(spark, tmp_path):
    texts = {1: "[3.5][S01]left[4.25][5][S02]right[6]", 2: "noise [x] [0][S01]alone[1.5]"}
    rows = [(m, i // 5 + 1, t[i : i + 5], i + 5 >= len(t)) for m, t in texts.items() for i in range(0, len(t), 5)] + [(3, 1, "[7][S01]open", False)]
    df = spark.createDataFrame(rows, "media_id bigint, seq bigint, chunk string, eof boolean")
    got, checkpoint = drained(spark, f"file://{tmp_path}", df, "texts", st.parse_stream)
    assert sorted((r.media_id, r.start_ms, r.end_ms, r.speaker, r.text) for r in got) == [(1, 3500, 4250, "S01", "left"), (1, 5000, 6000, "S02", "right"), (2, 0, 1500, "S01", "alone")]
    assert [held(spark, checkpoint, n) for n in ("place", "scanner", "count", "mark")] == [1, 1, 1, 2]  # the open one; the marks of the others


@pytest.mark.parametrize("usage", [True, 1.5, "7", {}])
def test_usage_takes_whole_numbers_only(usage):
    assert st._whole(usage, 4) == 4 and st._whole(9, 4) == 9


CHUNKS = "media_id bigint, seq bigint, chunk string, eof boolean"


def fed(spark, folder, steps, schema, make):
    """Rows that came out after each step; a step's rows are one file of the same stream."""
    st.use_rocksdb(spark)
    out = []
    for k, rows in enumerate(steps):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        got = st.run_once(make(spark.readStream.schema(schema).parquet(f"{folder}/in")), f"{folder}/out", f"{folder}/check")
        out.append(sorted(tuple(r) for r in got.collect()))
    return out


def test_a_replay_after_the_end_gives_nothing(spark, tmp_path):
    chunks = [(1, 1, "[1][S01]a[2]", False), (1, 2, "[3][S02]b[4]", False), (1, 3, "", True)]
    out = fed(spark, f"file://{tmp_path}", [chunks, chunks, chunks[:1], [(1, 4, "[5][S01]late[6]", False)]], CHUNKS, st.parse_stream)
    assert out[0] == [(1, 1, 1000, 2000, "S01", "a"), (1, 2, 3000, 4000, "S02", "b")]
    assert out[1] == out[2] == out[3] == out[0]
    assert [held(spark, f"file://{tmp_path}/check", n) for n in ("place", "scanner", "count", "mark")] == [0, 0, 0, 1]
    assert held(spark, f"file://{tmp_path}/check", "waiting", "map") == 0


def until(spark, df, folder, enough, seconds=90):
    """Run a stream by processing time until its output has ``enough`` rows (and a little longer)."""
    import time

    st.use_rocksdb(spark)
    query = df.writeStream.format("parquet").option("checkpointLocation", f"{folder}/check").trigger(processingTime="500 milliseconds").start(f"{folder}/out")
    try:
        for _ in range(seconds * 2):
            time.sleep(0.5)
            assert query.exception() is None
            rows = spark.read.schema(df.schema).parquet(f"{folder}/out").collect()
            if len(rows) >= enough:
                break
        time.sleep(2)
    finally:
        query.stop()
    return sorted(tuple(r) for r in spark.read.schema(df.schema).parquet(f"{folder}/out").collect())


def test_timers_give_what_is_confirmed_and_empty_the_store(spark, tmp_path):
    """A transcript and a delta stream that break off, a gap that never fills, phrases and tokens that just end."""
    folder = f"file://{tmp_path}"

    def source(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}/in")
        return spark.readStream.schema(schema).parquet(f"{folder}/{name}/in")

    chunks = source("texts", [(1, 1, "[1][S01]a[2][3][S02]b[4]", False), (2, 1, "[1][S01]open", False), (3, 1, "[1][S01]x[2]", False), (3, 3, "[5][S01]lost[6]", False)], CHUNKS)
    got = until(spark, st.parse_stream(chunks, idle_ms=1500), f"{folder}/texts", 3)
    assert got == [(1, 1, 1000, 2000, "S01", "a"), (1, 2, 3000, 4000, "S02", "b"), (3, 1, 1000, 2000, "S01", "x")]
    assert [held(spark, f"{folder}/texts/check", n) for n in ("place", "scanner", "count")] == [0, 0, 0]
    assert held(spark, f"{folder}/texts/check", "waiting", "map") == 0

    deltas = source("deltas", [("a", i + 1, line) for i, line in enumerate(LINES[:-1])], "stream_id string, seq bigint, line string")
    assert until(spark, st.fold_deltas_stream(deltas, idle_ms=1500), f"{folder}/deltas", 1) == [("a", "alpha", 3, 2)]
    assert held(spark, f"{folder}/deltas/check", "usage") == held(spark, f"{folder}/deltas/check", "place") == 0

    puts = source("puts", [("a", 1, 9), ("a", 2, 3), ("b", 1, 1)], "stream_id string, seq bigint, tokens bigint")
    assert until(spark, st.count_tokens_stream(puts, idle_ms=500), f"{folder}/puts", 1) == [("a", 3)]
    assert held(spark, f"{folder}/puts/check", "sum") == held(spark, f"{folder}/puts/check", "place") == 0


def test_a_cancellation_may_come_late(spark, tmp_path):
    """After the first event; later events go, also in later runs of the stream, other jobs stay."""
    st.use_rocksdb(spark)
    folder = f"file://{tmp_path}"
    events, cancels = "job_id string, at_ms bigint, status string", "job_id string, cancel_ms bigint"
    steps = [([("a", 1, "start"), ("b", 1, "start")], []), ([("a", 5, "run"), ("b", 5, None), ("a", 2, "early")], [("a", 3)]), ([("a", 9, "done"), ("b", 9, "done")], []), ([("a", 2, "late but before")], [("a", 8)])]
    seen = []
    for more, cut in steps:
        spark.createDataFrame(more, events).coalesce(1).write.mode("append").parquet(f"{folder}/events")
        spark.createDataFrame(cut, cancels).coalesce(1).write.mode("append").parquet(f"{folder}/cancels")
        df = st.until_cancelled(spark.readStream.schema(events).parquet(f"{folder}/events"), spark.readStream.schema(cancels).parquet(f"{folder}/cancels"))
        seen.append({tuple(r) for r in st.run_once(df, f"{folder}/out", f"{folder}/check").collect()})
    assert seen[0] == {("a", 1, "start"), ("b", 1, "start")}
    assert seen[1] - seen[0] == {("a", 2, "early"), ("b", 5, None)}
    assert seen[2] - seen[1] == {("b", 9, "done")} and seen[3] - seen[2] == {("a", 2, "late but before")}


def test_many_events_of_one_job_wait_in_the_store(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}"
    spark.range(300).selectExpr("'a' job_id", "id at_ms").coalesce(1).write.parquet(f"{folder}/events")
    spark.createDataFrame([("a", 120)], "job_id string, cancel_ms bigint").coalesce(1).write.parquet(f"{folder}/cancels")
    st.use_rocksdb(spark)
    monkeypatch.setattr(st, "IN_MEMORY", 50)
    df = st.until_cancelled(spark.readStream.schema("job_id string, at_ms bigint").parquet(f"{folder}/events"), spark.readStream.schema("job_id string, cancel_ms bigint").parquet(f"{folder}/cancels"))
    assert sorted(r.at_ms for r in st.run_once(df, f"{folder}/out", f"{folder}/check").collect()) == list(range(120))
    assert held(spark, f"{folder}/check", "early", "list") == 0


def test_early_rows_wait_by_the_page(spark, tmp_path, monkeypatch):
    """A key whose first rows come last: few entries in the store, which come back once each, also where rows are put away several times a batch."""
    monkeypatch.setattr(st, "IN_MEMORY", 50)
    puts = [("a", k, k) for k in range(900, 2, -1)]
    schema = "stream_id string, seq bigint, tokens bigint"
    folder = f"file://{tmp_path}"
    assert fed(spark, folder, [puts], schema, st.count_tokens_stream) == [[]]
    assert 4 <= held(spark, f"{folder}/check", "waiting", "map") <= 12
    out = fed(spark, folder, [[("a", 2, 7), ("a", 700, -1)], [("a", 1, 0)], [("a", 901, 5), ("a", 3, 9)]], schema, st.count_tokens_stream)
    want, total = [], 0
    for k in range(2, 901):
        total += 7 if k == 2 else -1 if k == 700 else k  # of rows with one number, the latest that waits
        want.append(("a", total))
    assert out[0] == [] and out[1] == sorted(want) and out[2] == sorted([*want, ("a", total + 5)])
    assert held(spark, f"{folder}/check", "waiting", "map") == 0
