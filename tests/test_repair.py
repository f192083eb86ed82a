"""Rounds of translation requests against a recursive walk of one media at a time."""

import json

import pytest
from pyspark.sql import functions as F

from cuesheet.operators import repair as rq
from cuesheet.operators import translate as tn
from cuesheet.ordering import arrange
from cuesheet.plans import flows

SCHEMA = "media_id bigint, idx bigint, start_ms bigint, end_ms bigint, speaker string, text string"
REPLY = "media_id bigint, request string, content string"


def planned(spark, media, batch_size=6):
    """Units of up to three parts: every third row ends its sentence."""
    rows = [(m, i, i * 1000, i * 1000 + 900, "S01", f"m{m} t{i}" + ("." if i % 3 == 0 else "")) for m, n in media.items() for i in range(1, n + 1)]
    o = arrange(spark.createDataFrame(rows, SCHEMA).withColumn("id", F.format_string("seg_%04d", "idx")))
    return (o, *tn.plan(o, batch_size=batch_size))


def table(spark, answers):
    return spark.createDataFrame([(*k, v) for k, v in answers.items()], REPLY)


def walk(units, batches, model):
    """{request: outcome} and {pos: text} by recursion; ``units`` are lists of positions."""
    log, said = {}, {}

    def answered(request, count):
        items = model(request, count)
        log[request] = "done" if items is not None else "split"
        return items

    def segments(request, at):
        items = answered(request, len(at))
        if items is not None:
            said.update(zip(at, items))
        elif len(at) == 1:
            log[request] = "source"
        else:
            mid = max(1, len(at) // 2)
            segments(f"{request}/0", at[:mid])
            segments(f"{request}/1", at[mid:])

    def some(request, own):
        items = answered(request, sum(map(len, own)))
        if items is not None:
            said.update(zip([p for u in own for p in u], items))
        elif len(own) == 1:
            segments(f"{request}/s", own[0])
        else:
            mid = max(1, len(own) // 2)
            some(f"{request}/0", own[:mid])
            some(f"{request}/1", own[mid:])

    for b, (lo, hi) in batches.items():
        some(str(b), units[lo:hi])
    return log, said


@pytest.mark.parametrize("fails", [lambda r: True, lambda r: len(r) < 4, lambda r: "/s" not in r, lambda r: hash_of(r) % 2 == 0])
def test_rounds_equal_a_recursive_walk(spark, fails):
    _, parts, units = planned(spark, {1: 14, 2: 1, 3: 7}, batch_size=9)

    def content(row):
        body = json.loads(row.payload)
        if fails(row.request):
            return "sorry" if hash_of(row.request) % 3 else json.dumps({"translations": body["items"][1:]})
        told = [[{"id": p["id"], "text": "T " + p["text"]} for p in u["parts"]] if "parts" in u else "T " + u["text"] for u in body["items"]]
        return json.dumps(told)

    def model(requests):
        return table(spark, {(r.media_id, r.request): content(r) for r in requests.collect()})

    log, said = rq.repair_rounds(parts, units, model)
    got_log = {(r.media_id, r.request): r.outcome for r in log.collect()}
    got_said = {(r.media_id, r.pos): r.translation for r in said.collect()}
    want_log, want_said = {}, {}
    batches = {}
    for r in tn.batch_ranges(units).collect():
        batches.setdefault(r.media_id, {})[r.batch_no] = (r.unit_lo, r.unit_hi)
    texts = {(r.media_id, r._pos): r.text for r in parts.df.collect()}
    for m, own in batches.items():
        at = [list(range(r.lo, r.hi + 1)) for r in units.df.filter(f"media_id = {m}").orderBy("unit_no").collect()]
        done, told = walk(at, own, lambda request, n: None if fails(request) else [""] * n)
        want_log |= {(m, k): v for k, v in done.items()}
        want_said |= {(m, p): "T " + texts[(m, p)] for p in told}
    assert got_log == want_log and got_said == want_said


def hash_of(text):
    return sum(map(ord, text))


def test_context_of_halves(spark):
    """Two segments on each side, never beyond what the parent saw."""
    _, parts, units = planned(spark, {1: 12}, batch_size=6)
    log, _ = rq.repair_rounds(parts, units, table(spark, {(1, "x"): "no"}), context=2)
    for r in log.filter("generation > 0").collect():
        p = log.filter(F.col("request") == r.request.rsplit("/", 1)[0]).first()
        if r.request.endswith("/s"):
            assert (r.context_lo, r.context_hi, r.lo, r.hi) == (p.context_lo, p.context_hi, p.lo, p.hi)
        else:
            assert r.context_lo == max(p.context_lo, r.lo - 2) and r.context_hi == min(p.context_hi, r.hi + 2)
        body = json.loads(r.payload)
        assert len(body["context_before"]) == r.lo - r.context_lo and len(body["context_after"]) == r.context_hi - r.hi
    assert {r.outcome for r in log.filter("generation = 0").collect()} == {"split"}


def test_a_table_of_replies(spark):
    """Missing replies fail, a single segment takes the first of several, its failure keeps the source; other media are not touched."""
    o, parts, units = planned(spark, {1: 2, 2: 1})
    # media 1: one unit of two parts; its list is short, its segments fail together, then apart
    replies = {(1, "0"): '["a"]', (1, "0/s"): "none", (1, "0/s/0"): '["first", "second"]', (2, "0"): '{"items": [{"text": " two "}]}'}
    log, said = rq.repair_rounds(parts, units, table(spark, replies))
    assert {(r.media_id, r.request): r.outcome for r in log.collect()} == {(1, "0"): "split", (1, "0/s"): "split", (1, "0/s/0"): "done", (1, "0/s/1"): "source", (2, "0"): "done"}
    assert {(r.media_id, r.pos, r.translation) for r in said.collect()} == {(1, 0, "first"), (2, 0, "two")}
    run = flows.translate_run(o, table(spark, replies), mode="replace")
    assert [(r.media_id, r.text) for r in run["segments"].orderBy("media_id", "idx").collect()] == [(1, "first"), (1, "m1 t2"), (2, "two")]
    assert run["issues"].count() == 0 and run["skips"].count() == 0
    empty = flows.translate_run(arrange(o.plain().filter("false")), table(spark, replies))
    assert empty["segments"].count() == 0 and empty["requests"].count() == 0


def test_report_lists_rows_and_files(spark):
    rows = [(1, i, i * 1000, i * 1000 + 900, "S01", "(loud applause here)" if i % 2 else f"words here {i}") for i in range(1, 8)]
    o = arrange(spark.createDataFrame(rows, SCHEMA).withColumn("id", F.format_string("seg_%04d", "idx")))
    said = spark.createDataFrame([(1, 2, "```"), (1, 4, ""), (1, 6, "fine")], "media_id bigint, idx bigint, translation string")
    files = spark.createDataFrame([(1, "srt", "a/b.srt"), (1, "ass", "a/b.ass")], "media_id bigint, name string, path string")
    out = json.loads(tn.report_json(o, tn.collect_skips(o), tn.validate_translations(o, said), files, mode="bilingual", skip_rows=3).first().json)
    assert (out["mode"], out["segments"], out["pretranslation_skip_count"], out["validation_issue_count"]) == ("bilingual", 7, 4, 3)
    assert [(s["index"], s["reason"], s["start"]) for s in out["pretranslation_skips"]] == [(0, "bracketed_effect", 1.0), (2, "bracketed_effect", 3.0), (4, "bracketed_effect", 5.0)]
    assert [i["type"] for i in out["validation_issues"]] == ["count_mismatch", "model_artifact", "empty_translation"]
    assert out["validation_issues"][0]["expected"] == 7 and out["files"] == {"ass": "a/b.ass", "srt": "a/b.srt"}


def test_later_generations_read_neither_segments_nor_units(spark):
    """What a request sends and how its halves are cut stands in its own row."""
    _, parts, units = planned(spark, {1: 14, 2: 5})
    first = rq.first_requests(units)
    children = rq.next_requests(rq.judge(first, table(spark, {(2, "0"): "no"})))
    plan = children.select("request", rq.payload())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # the replies
    assert {r.request for r in children.filter("media_id = 2").collect()} >= {"0/0", "0/1"}


@pytest.mark.parametrize("limit", [None, 4])
def test_context_over_several_batches(spark, limit):
    """Batches smaller than the context, in one group and in chunks of a hot one."""
    rows = [(m, i, i * 1000, i * 1000 + 900, "S01", f"m{m} t{i}.") for m, n in {1: 9, 2: 3}.items() for i in range(1, n + 1)]
    o = arrange(spark.createDataFrame(rows, SCHEMA).withColumn("id", F.format_string("seg_%04d", "idx")), limit=limit)
    parts, units = tn.plan(o, batch_size=1)
    assert units.chunked == (limit is not None)
    log, _ = rq.repair_rounds(parts, units, table(spark, {(1, "0"): '["a"]'}), context=3)
    for r in log.filter("generation = 0").collect():
        n, body = {1: 9, 2: 3}[r.media_id], json.loads(r.payload)
        assert (r.context_lo, r.context_hi) == (max(0, r.lo - 3), min(n, r.hi + 3))
        said = [x["text"] for part in ("context_before", "items", "context_after") for x in body[part]]
        assert said == [f"m{r.media_id} t{i + 1}." for i in range(r.context_lo, r.context_hi)]


def test_a_run_joins_its_texts_once(spark):
    """Segments and issues are read from the rows that stand beside their translations."""
    rows = [(1, i, i * 1000, i * 1000 + 900, "S01", t) for i, t in enumerate(["some words here.", "um", "other words there.", "more words to say."], 1)]
    o = arrange(spark.createDataFrame(rows, SCHEMA).withColumn("id", F.format_string("seg_%04d", "idx")))
    run = flows.translate_run(o, table(spark, {(1, "0"): json.dumps(["x" * 200, "```", ""])}), mode="replace")
    for name in ("segments", "issues", "skips"):
        assert "Join" not in run[name]._jdf.queryExecution().optimizedPlan().toString()
    every = o.df.select("media_id", "idx").join(spark.createDataFrame([(1, "x" * 200), (2, "um"), (3, "```"), (4, "")], "idx bigint, translation string"), "idx")
    want = tn.validate_translations(o, every)
    assert sorted(map(repr, run["issues"].collect())) == sorted(map(repr, want.collect())) and want.count() == 3
    assert sorted(map(repr, run["skips"].collect())) == sorted(map(repr, tn.collect_skips(o).collect()))
    assert sorted(map(repr, run["segments"].collect())) == sorted(map(repr, tn.apply_translations(o, every).collect()))
