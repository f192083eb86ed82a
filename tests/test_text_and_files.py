"""Scalar rules, subtitle parsing of rough input, reply shapes, sinks, repair rounds."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cuesheet.functions import replies as rp
from cuesheet.functions import text as tx
from cuesheet.functions import times as tm
from cuesheet.functions import translation as tl
from cuesheet.operators import jobs as jb
from cuesheet.operators import speakers as sp
from cuesheet.operators import translate as tn
from cuesheet.ordering import arrange
from cuesheet.sinks import files as fl
from cuesheet.sinks import subtitles as sb
from cuesheet.sources import records as rec
from cuesheet.sources import subtitle_files as sf
from cuesheet.sources import transcripts as tr

SCHEMA = "media_id bigint, idx bigint, start_ms bigint, end_ms bigint, speaker string, text string"


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(column.alias("x")).first().x


def test_skip_reasons(spark):
    cases = {
        "(loud applause here)": "bracketed_effect", "KX7!": "short_code_or_noise", "Lolo, Bim; Lolo, Bim": "repeated_chant", "oh yeah wow": "filler_noise",
        "im honey!": "known_transcript_noise", "  ": "empty", "ab": "too_short", "Turn left at the mill.": None,
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r.t: r.x for r in df.select("t", tl.skip_reason(F.col("t")).alias("x")).collect()} == cases


def test_strip_knows_python_blanks(spark):
    raw = " \t　a b \x1f \n"
    assert one(spark, tx.strip(F.col("t")), t=raw) == raw.strip()


@pytest.mark.parametrize("ms, srt, ass", [(0, "00:00:00,000", "0:00:00.00"), (3_661_005, "01:01:01,005", "1:01:01.00"), (1_015, "00:00:01,015", "0:00:01.02"), (-5, "00:00:00,000", "0:00:00.00")])
def test_time_texts(spark, ms, srt, ass):
    assert one(spark, tm.srt_time(F.col("t")), t=ms) == srt
    assert one(spark, tm.ass_time(F.col("t")), t=ms) == ass


def test_token_budget_table(spark):
    for sec, want in [(None, None), (0.0, None), (-5.0, None), (60.0, 2048), (540.0, 7680), (1800.0, 25_600), (6000.0, 55_560)]:
        df = spark.createDataFrame([(sec,)], "s double")
        assert df.select(jb.recommended_tokens(F.col("s")).alias("x")).first().x == want


def test_srt_with_broken_blocks(spark):
    text = "﻿1\n00:00:01,000 --> 00:00:02,500\nAnn: hi\nthere\n\n2\nbroken\n\n00:00:05,5 --> 00:00:04,000\nno number\n\n4\n00:00:06,000 --> 00:00:07,000\n\n"
    df = spark.createDataFrame([(1, text.removeprefix("﻿"))], "media_id bigint, text string")
    rows = [(r.id, r.start_ms, r.end_ms, r.speaker, r.text) for r in sf.parse_srt(df).orderBy("idx").collect()]
    assert rows == [("seg_0001", 1000, 2500, "Ann", "hi\nthere"), ("seg_0003", 5005, 5005, "S00", "no number"), ("seg_0004", 6000, 7000, "S00", "")]


def test_ass_lines(spark):
    text = "[Events]\nDialogue: 0,0:00:01.00,0:00:02.50,Default,Bob,0,0,0,,{\\i1}a, b\\Nc\\hd\nDialogue: 0,bad,0:00:02.50,Default,,0,0,0,,x\nDialogue: 0,0:00:03.00,0:00:04.00,Default,,0,0,0,,Eve: hey"
    df = spark.createDataFrame([(1, text)], "media_id bigint, text string")
    rows = [(r.id, r.start_ms, r.end_ms, r.speaker, r.text) for r in sf.parse_ass(df).orderBy("idx").collect()]
    assert rows == [("seg_0002", 1000, 2500, "Bob", "a, b\nc d"), ("seg_0004", 3000, 4000, "Eve", "hey")]


def test_reply_shapes(spark):
    cases = {
        '{"translations":["a"," b "]}': ["a", "b"], '[{"text":"a"},{"translation":"b"}]': ["a", "b"], 'x {"items":[1,null]} y': ["1", "None"],
        '{"translations":"a"}': None, "nothing": None, '{"translated":[{"text":"","translated":"z"}]}': ["z"],
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r.t: r.x for r in df.select("t", rp.parse_translations(F.col("t")).alias("x")).collect()} == cases


def test_unit_parts_align_by_id_then_by_order(spark):
    cases = [
        ('{"parts":[{"id":"b","text":"B"},{"id":"a","text":"A"}]}', ["a", "b"], ["A", "B"]), ('["x","y"]', ["a", "b"], ["x", "y"]),
        ('{"parts":["x"]}', ["a", "b"], None), ('"solo"', ["a"], ["solo"]), ('{"id":"u","text":"t"}', ["a"], ["t"]),
        ('{"parts":[{"id":"zz","text":"first"},{"id":"b","text":"second"}]}', ["a", "b"], ["first", "second"]),
    ]
    df = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(cases)], "i int, t string, ids array<string>")
    got = df.select("i", rp.unit_parts(F.parse_json("t"), F.col("ids")).alias("x")).orderBy("i").collect()
    assert [r.x for r in got] == [c[2] for c in cases]


def test_units_case(spark):
    rows = [(1, 1, 0, 900, "S01", "the red"), (1, 2, 1000, 1900, "S01", "boat sank."), (1, 3, 2000, 2900, "S01", "Rain fell.")]
    units = tn.units_of(tn.assign_units(arrange(spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit("x"))))).df.orderBy("unit_no")
    assert [(r.unit_id, len(r.parts), r.text) for r in units.collect()] == [("unit_0001", 2, "the red boat sank."), ("unit_0002", 1, "Rain fell.")]


@pytest.mark.parametrize("limit", ["1000000", "9"])
def test_batches_pack_in_order(spark, limit):
    spark.conf.set("spark.cuesheet.maxGroupRows", limit)
    rows = [(1, i, i * 1000, i * 1000 + 900, "S01", "go on" if i % 3 else "stop.") for i in range(1, 101)]
    parts, units = tn.plan(arrange(spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit("x"))), batch_size=7)
    got = [(r.batch_no, len(r.parts)) for r in units.df.orderBy("unit_no").collect()]
    spark.conf.unset("spark.cuesheet.maxGroupRows")
    no, held, want = 0, 0, []
    for _, n in got:
        if held and held + n > 7:
            no, held = no + 1, 0
        held += n
        want.append(no)
    assert [b for b, _ in got] == want and len(got) > 30


def test_repair_rounds_reach_single_units(spark):
    rows = [(1, i, i * 1000, i * 1000 + 900, "S01", "stop.") for i in range(1, 8)]
    _, units = tn.plan(arrange(spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit("x"))))
    level = [(r.unit_lo, r.unit_hi) for r in tn.batch_ranges(units).collect()]
    batches = tn.batch_ranges(units)
    halves, alone = tn.split_failed(batches, batches.select("media_id", "batch_no"), units)
    assert level == [(0, 7)] and alone.count() == 0
    assert sorted((r.lo, r.hi, r.context_lo, r.context_hi) for r in halves.collect()) == [(0, 3, 0, 5), (3, 7, 1, 7)]


def _media_rows(spark, rows):
    return arrange(spark.createDataFrame(rows, SCHEMA).withColumn("id", F.format_string("seg_%04d", "idx")))


def test_files_round_trip(spark, tmp_path):
    """Two media written by two calls are both there; a rewritten media has its newest text and its first source."""
    first = [(1, 1, 0, 900, "S01", "north"), (1, 2, 1000, 1900, "S02", "south")]
    where = f"file://{tmp_path}/set"
    fl.write_media_set(_media_rows(spark, first), where, show_speaker=True, version=1)
    fl.write_media_set(_media_rows(spark, [(2, 1, 0, 500, "S01", "east")]), where, show_speaker=True, version=2)
    fl.write_media_set(_media_rows(spark, [(1, 1, 0, 900, "S01", "west")]), where, show_speaker=True, version=3)
    srt = {r.media_id: r.text for r in fl.read_texts(spark, f"{where}/srt").collect()}
    assert srt == {1: "\ufeff1\n00:00:00,000 --> 00:00:00,900\nS01: west\n", 2: "\ufeff1\n00:00:00,000 --> 00:00:00,500\nS01: east\n"}
    source = {r.media_id: (r.version, "north" in r.text) for r in fl.read_texts(spark, f"{where}/source").collect()}
    assert source == {1: (1, True), 2: (2, False)}
    good, bad = rec.parse_segment_json(fl.read_texts(spark, f"{where}/segments"))
    assert sorted((r.media_id, r.text) for r in good.collect()) == [(1, "west"), (2, "east")] and bad.count() == 0


def test_plain_files_are_written_and_replaced_by_tasks(spark, tmp_path):
    """One file per media under folders as Spark names them, also over files that its writer left; no checksums, no leftovers."""
    where = f"{tmp_path}/plain"
    ids = ["a", "b/c=%d", "", None, "é"]
    rows = lambda text: spark.createDataFrame([(m, f"{text} {m}") for m in ids] + [("two", "x"), ("two", None)], "media_id string, text string")
    rows("old").selectExpr("media_id", "text value").filter("media_id <> ''").write.partitionBy("media_id").text(where)
    spark_named = {p.name for p in (tmp_path / "plain").iterdir() if p.is_dir()}
    fl.export_files(rows("new"), where)
    folders = {p.name: p for p in (tmp_path / "plain").iterdir() if p.is_dir()}
    assert spark_named < set(folders) and set(folders) - spark_named == {"media_id=__HIVE_DEFAULT_PARTITION__"}
    assert {f.name for p in folders.values() for f in p.iterdir()} == {"text.txt"}
    assert (folders["media_id=a"] / "text.txt").read_text() == "new a\n" and sorted((folders["media_id=two"] / "text.txt").read_text()) == ["\n", "\n", "x"]
    got = {r.text for r in tr.read_transcripts(spark, where).collect()}
    assert {"new a\n", "new b/c=%d\n", "new é\n"} < got and len(got) == 5
    assert fl._mounted(spark, "hdfs://h/x") is None and fl._mounted(spark, "file:///x/") == "/x"


def test_plain_files_of_other_media_stay(spark, tmp_path):
    where = f"file://{tmp_path}/plain"
    for rows in ([(1, 1, 0, 900, "S01", "north"), (1, 2, 1000, 1900, "S02", "south")], [(2, 1, 0, 500, "S01", "east")]):
        fl.export_files(sb.export_srt(_media_rows(spark, rows), show_speaker=True), where, "srt", bom=True)
    back = sf.parse_srt(sf.read_subtitle_texts(spark, where).filter("kind = 'txt'"))
    assert sorted((r.media_id, r.start_ms, r.speaker, r.text) for r in back.collect()) == [("media_id=1", 0, "S01", "north"), ("media_id=1", 1000, "S02", "south"), ("media_id=2", 0, "S01", "east")]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "m.txt").write_text(sb.render_transcript(_media_rows(spark, [(1, 1, 0, 900, "S01", "up"), (1, 2, 1000, 1900, "S02", "down")])).first().text)
    assert tr.parse_transcripts(tr.read_transcripts(spark, str(tmp_path / "t"))).count() == 2


def test_long_stamps_and_late_times(spark):
    df = spark.createDataFrame([("0:00:01,0000000005", "123456789012:00:00.10", 1e13, 12.0004)], "a string, b string, s double, t double")
    r = df.select(tm.parse_srt_time(F.col("a")), tm.parse_ass_time(F.col("b")), tm.millis(F.col("s")), tm.millis(F.col("t"))).first()
    assert tuple(r) == (1005, 123456789012 * 3_600_000 + 100, None, 12000)


def test_every_segment_text_has_an_outcome(spark):
    texts = [(1, '[{"start":0'), (2, '{"a":1}'), (3, '[{"id":"x","start":0,"end":1,"speaker":"S01","text":"t"}]'), (4, None), (5, '[{"start":1e13,"end":2e13}]'), (6, "[]")]
    good, bad = rec.parse_segment_json(spark.createDataFrame(texts, "media_id bigint, text string"))
    assert [r.media_id for r in good.collect()] == [3]
    assert sorted((r.media_id, r.reason) for r in bad.collect()) == [(1, "unreadable text"), (2, "missing start or end"), (4, "unreadable text"), (5, "time out of range")]


def test_marks_beyond_ten_million_seconds(spark):
    df = spark.createDataFrame([(s * 16000,) for s in (10, 10_000_100, 10_000_000_000)], "n bigint")
    got = [r.m for r in df.select(jb.audio_token_plan(F.col("n"))[1].alias("m")).collect()]
    digits = lambda last: sum(d * (min(last, 10**d - 1) // 2 - (10 ** (d - 1) - 1) // 2) for d in range(1, len(str(last)) + 1))
    assert got == [digits(10), digits(10_000_100), digits(10_000_000_000)]


def test_prompts_that_do_not_fit(spark):
    df = spark.createDataFrame([(1, 100), (2, 100), (1, 10)], "p int, most int")
    got = [r[0] for r in df.select(jb.prompt_fits(F.lit(12), F.lit(3), F.lit(4), F.lit(5), F.col("p"), F.col("most"))).collect()]
    assert got == [None, "expected one audio placeholder, got 2", "prompt and audio exceed the greatest length"]


def test_one_backend_names_a_media(spark):
    o = _media_rows(spark, [(1, 1, 0, 9, "S00", "a"), (1, 2, 10, 19, "S00", "b"), (2, 1, 0, 9, "S00", "c")])
    kind = "media_id bigint, idx bigint, speaker string, error string"
    p = spark.createDataFrame([(1, 1, "P1", None), (2, 1, None, "not enough voiced audio")], kind)
    f = spark.createDataFrame([(1, 2, "C1", None), (2, 1, "C1", None)], kind)
    got = {(r.media_id, r.idx): (r.speaker, r.method, r.note) for r in sp.choose_backend(o, p, f).df.collect()}
    assert got == {(1, 1): ("P1", "preferred", None), (1, 2): ("S00", "preferred", None), (2, 1): ("C1", "fallback", "preferred failed: not enough voiced audio")}


def test_sources_are_kept_once(spark):
    now = spark.createDataFrame([(1, "new"), (2, "new")], "media_id bigint, text string")
    had = spark.createDataFrame([(1, "old")], "media_id bigint, text string")
    assert [r.media_id for r in fl.keep_source_once(had, now).collect()] == [2]


def test_bilingual_and_unusable_replies(spark):
    o = arrange(spark.createDataFrame([(1, 1, 0, 1, "S", "hi"), (1, 2, 1, 2, "S", "yo"), (1, 3, 2, 3, "S", "x")], SCHEMA).withColumn("id", F.lit("i")))
    said = spark.createDataFrame([(1, 1, "Disclaimer: no"), (1, 2, "salut")], "media_id bigint, idx bigint, translation string")
    assert [r.text for r in tn.apply_translations(o, said, "bilingual").orderBy("idx").collect()] == ["hi", "salut\nyo", "x"]
    kinds = {r.type for r in tn.validate_translations(o, said).collect()}
    assert kinds == {"count_mismatch", "model_artifact"}


def test_a_set_that_breaks_off_does_not_show(spark, tmp_path, monkeypatch):
    """Between two tables of a set: readers keep the version before; the retry gives each text once."""
    where = f"file://{tmp_path}/set"
    north, west = _media_rows(spark, [(1, 1, 0, 900, "S01", "north")]), _media_rows(spark, [(1, 1, 0, 900, "S01", "west"), (2, 1, 0, 500, "S01", "new")])
    fl.write_media_set(north, where, version=1)

    with monkeypatch.context() as m:  # two tables are written when the third breaks
        m.setattr(fl, "export_srt", lambda o, **_: o.df.select("media_id", F.raise_error(F.lit("lost")).cast("string").alias("srt")))
        with pytest.raises(PySparkException):
            fl.write_media_set(west, where, version=2)
    assert spark.read.parquet(f"{where}/segments").filter("version = 2").count() == 2
    for table in ("source", "segments", "srt", "ass"):
        assert [(r.media_id, r.version, "north" in r.text) for r in fl.read_texts(spark, f"{where}/{table}").collect()] == [(1, 1, True)]
    fl.write_media_set(west, where, version=2)
    fl.write_media_set(west, where, version=2)
    for table in ("segments", "srt", "ass"):
        assert sorted((r.media_id, r.version) for r in fl.read_texts(spark, f"{where}/{table}").collect()) == [(1, 2), (2, 2)]
        assert fl.committed(spark, f"{where}/{table}").count() == 3
    assert {r.media_id: "north" in r.text for r in fl.read_texts(spark, f"{where}/source").collect()} == {1: True, 2: False}
    with pytest.raises(FileNotFoundError):
        fl.read_texts(spark, f"{where}/none")


def test_lines_of_split_files_keep_their_numbers(spark, tmp_path):
    """Files of many splits, of one, of none; lines of all lengths, blank ones, the last without an end."""
    import json

    rng = random.Random(4)
    sample = lambda k: json.dumps({"conversation": [{"role": "user", "message_type": "text", "content": f"p{k}" + "x" * rng.randrange(90)}, {"role": "user", "message_type": "audio", "content": f"./a/{k}.wav"}, {"role": "assistant", "message_type": "text", "content": "t"}]})
    files = {name: [rng.choice([sample(k), sample(k), "", "  ", "{}"]) for k in range(n)] for name, n in (("a.jsonl", 700), ("b.jsonl", 1), ("c.jsonl", 0), ("d.jsonl", 300))}
    for name, lines in files.items():
        (tmp_path / name).write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = rec.read_lines(spark, str(tmp_path))
        assert rows.select(F.spark_partition_id()).distinct().count() > 1
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        got = sorted((r.path.rsplit("/", 1)[1], r.line_no, r.line) for r in rows.collect())
        good, bad = (sorted((r.path.rsplit("/", 1)[1], r.line_no) for r in part.collect()) for part in rec.read_manifest(spark, str(tmp_path)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = [(name, i + 1, line) for name, lines in files.items() for i, line in enumerate(lines)]
    assert got == sorted(w for w in want if not (w[0] != "c.jsonl" and w[1] == len(files[w[0]]) and w[2] == ""))
    assert good == sorted((n, i) for n, i, line in want if "conversation" in line)
    assert bad == sorted((n, i) for n, i, line in want if line == "{}")
