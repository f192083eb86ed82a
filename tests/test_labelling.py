"""Labelling of whole media: ways, reasons, rows; durations; what rankings gave."""

import pytest

from cuesheet.operators import clips, labelling
from cuesheet.operators import speakers as sp
from cuesheet.ordering import arrange

SCHEMA = "media_id bigint, idx bigint, start_ms bigint, end_ms bigint, speaker string, text string"
TURNS = "media_id bigint, turn_no bigint, turn_start_ms bigint, turn_end_ms bigint, source string"


def media(m, n=6, speaker="S00", gap=0):
    """n segments of two seconds; ``gap`` of them without text or duration at the end."""
    rows = [(m, i, 2000 * i, 2000 * i + 2000, speaker, f"words {i}") for i in range(1, n + 1)]
    return rows + [(m, n + 1 + i, 50_000, 50_000 + 100 * (i % 2), speaker, "" if i % 2 else "x") for i in range(gap)]


def run(spark, rows, turns=(), labels=(), failures=(), **options):
    out = labelling.label_speakers(
        arrange(spark.createDataFrame(rows, SCHEMA)), spark.createDataFrame(list(turns), TURNS),
        spark.createDataFrame(list(labels), "media_id bigint, idx bigint, label int"),
        spark.createDataFrame(list(failures), "media_id bigint, backend string, error string"), **options,
    )
    segments = {}
    for r in out.segments.df.orderBy("media_id", "idx").collect():
        segments.setdefault(r.media_id, []).append(r.speaker)
    return segments, {r.media_id: r.asDict() for r in out.outcomes.collect()}


def pairs(m, n=6):
    return [(m, i, i // 2) for i in range(1, n + 1)]


def halves(m):
    return [(m, 1, 0, 8000, "b"), (m, 2, 8000, 20_000, "a")]


def test_every_way_beside_the_others(spark):
    rows = [r for m in range(1, 9) for r in media(m)] + media(9, 3, gap=4) + [(10, 1, 5, 5, "S00", "x")]
    rows += [(11, i, 2000 * i, 2000 * i + 2000, f"S0{i % 2}", "x") for i in range(5)]
    turns = [t for m in (1, 2, 9, 11) for t in halves(m)] + [(3, 1, 500, 500, "empty")]
    labels = pairs(2) + [(4, i, 7) for i in range(1, 7)] + pairs(5, 3) + pairs(6) + [(7, i, i % 3 // 2 if i < 5 else None) for i in range(1, 7)]
    failures = [(m, "turns", "out of memory") for m in (2, 4, 5, 6, 7)] + [(6, "cluster", "no audio"), (8, "cluster", "never asked")]
    got, told = run(spark, rows, turns, labels, failures)
    assert got[1] == ["S01"] * 3 + ["S02"] * 3 and told[1]["backend"] == "turns" and told[1]["speakers"] == 2 and told[1]["reason"] is None
    assert got[2] == ["S01", "S02", "S02", "S03", "S03", "S04"] and told[2]["fallback"] == "turns failed: out of memory" and told[2]["speakers"] == 4
    # No turns are no failure: the clusters are not asked.
    assert got[3] == ["S00"] * 6 and told[3] == {
        "media_id": 3, "enabled": True, "applied": False, "backend": "turns", "speakers": 1, "segments": 6, "reason": "no speaker turns returned", "fallback": None}
    assert got[4] == ["S01"] * 6 and told[4]["applied"] and told[4]["reason"] == "single speaker estimated"
    assert got[5] == ["S00"] * 6 and told[5]["reason"] == "not enough voiced audio" and told[5]["fallback"] and not told[5]["applied"]
    assert got[6] == ["S00"] * 6 and told[6]["reason"] == "no audio"
    assert len(got[7]) == 6 and told[7]["applied"] and "S00" not in got[7]  # rows without a label take their neighbour's
    assert told[8]["reason"] == "no speaker turns returned"
    assert got[9] == ["S00"] * 3 and told[9]["segments"] == 3 and told[9]["reason"] == "too few segments" and told[9]["backend"] == "auto"
    assert 10 not in got and told[10]["segments"] == 0 and told[10]["speakers"] == 1
    assert told[11]["reason"] == "speaker labels already exist" and told[11]["speakers"] == 2 and set(got[11]) == {"S00", "S01"}
    assert set(told) == set(range(1, 12))


@pytest.mark.parametrize(
    ("backend", "enabled", "speakers", "said"),
    [
        ("turns", True, ["S00"] * 6, (True, False, "turns", 1, "broken", None)),
        ("Cluster", True, ["S01", "S02", "S02", "S03", "S03", "S04"], (True, True, "cluster", 4, None, None)),
        ("other", True, ["S00"] * 6, (True, False, "other", 1, "unsupported backend: other", None)),
        ("auto", False, ["S00"] * 6, (False, False, "auto", 0, "disabled", None)),
        (None, True, ["S01", "S02", "S02", "S03", "S03", "S04"], (True, True, "cluster", 4, None, "turns failed: broken")),
    ],
)
def test_named_backends(spark, backend, enabled, speakers, said):
    got, told = run(spark, media(1), halves(1), pairs(1), [(1, "turns", "broken"), (1, "turns", "later")], backend=backend, enabled=enabled)
    assert got[1] == speakers
    assert tuple(told[1][c] for c in ("enabled", "applied", "backend", "speakers", "reason", "fallback")) == said


def test_chunked_media_and_no_media(spark):
    rows = media(1, 60) + media(2, 60)
    labels = [(2, i, i * i % 5 % 3) for i in range(1, 61) if i % 4]
    turns = [(1, i, 3000 * i, 3000 * i + 2500, f"t{i * i % 3}") for i in range(1, 40)]
    failures = [(2, "turns", "x")]
    plain = run(spark, rows, turns, labels, failures)
    spark.conf.set("spark.cuesheet.maxGroupRows", "20")
    try:
        assert run(spark, rows, turns, labels, failures) == plain
    finally:
        spark.conf.unset("spark.cuesheet.maxGroupRows")
    assert run(spark, []) == ({}, {})


def test_durations_of_media(spark):
    o = arrange(spark.createDataFrame(media(1) + media(2) + media(3), SCHEMA))
    lengths = spark.createDataFrame([(1, 99_000), (1, 10), (2, 500), (3, None), (4, 700), (5, None), (6, -4)], "media_id bigint, duration_ms bigint")
    assert {r.media_id: r.duration_ms for r in sp.timeline_durations(o, lengths).collect()} == {1: 99_000, 2: 14_000, 3: 14_000, 4: 700, 5: 0, 6: 0}


def test_rankings_without_a_valid_pick(spark):
    cands = spark.createDataFrame([(m, f"clip_00{i}") for m in (1, 2, 3, 4) for i in (1, 2)], "media_id bigint, id string")
    picks = [(1, "clip_001"), (1, "clip_001"), (1, "clip_009"), (2, "clip_009"), (2, None), (4, "clip_002"), (4, "clip_002"), (4, "clip_001"), (9, "clip_001")]
    out = clips.ranking_outcomes(cands, spark.createDataFrame(picks, "media_id bigint, id string"), limit=2)
    got = {r.media_id: (r.candidates, r.picks, r.valid, r.error) for r in out.collect()}
    none = clips.NO_VALID_PICK
    assert got == {1: (2, 3, 2, None), 2: (2, 2, 0, none), 3: (2, 0, 0, none), 4: (2, 3, 2, None)}
