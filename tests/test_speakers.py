"""Clustering by its properties, audio features, labels and turns."""

import numpy as np
import pytest

from cuesheet.functions.audio import batch_features
from cuesheet.operators import audio
from cuesheet.operators import speakers as sp
from cuesheet.ordering import arrange

SCHEMA = "media_id bigint, idx bigint, start_ms bigint, end_ms bigint, speaker string, text string"


def features(spark, seed=1, medias=3, n=40, dims=4, groups=3):
    rng = np.random.default_rng(seed)
    rows = []
    for m in range(medias):
        centres = rng.normal(size=(groups, dims)) * 5
        for i in range(n):
            rows.append((m, i, [float(x) for x in centres[i % groups] + rng.normal(size=dims) * 0.8]))
    return spark.createDataFrame(rows, "media_id bigint, idx bigint, vec array<double>"), rows


def scaled(rows, media):
    x = np.array([v for m, _, v in rows if m == media])
    return (x - x.mean(0)) / x.std(0)


@pytest.mark.parametrize("k", [2, 4])
def test_rounds_end_where_centres_are_means(spark, k):
    """Every row is nearest to the mean of the rows that share its label."""
    df, rows = features(spark, seed=k)
    got = {(r.media_id, r.idx): r.label for r in sp.cluster_labels(df, 4, target_speakers=k).collect()}
    for m in range(3):
        x, labels = scaled(rows, m), np.array([got[m, i] for i in range(40)])
        assert set(labels) == set(range(k))
        means = np.array([x[labels == c].mean(0) for c in range(k)])
        assert (np.linalg.norm(x[:, None] - means, axis=2).argmin(1) == labels).all()


def test_separate_groups_are_found(spark):
    """With groups far apart the number of speakers and the groups themselves come out."""
    rng = np.random.default_rng(9)
    rows = [(m, i, [float(v) for v in np.eye(4)[i % g] * 30 + rng.normal(size=4) * 0.3]) for m, g in enumerate((2, 3, 4)) for i in range(40)]
    got = {(r.media_id, r.idx): r.label for r in sp.cluster_labels(spark.createDataFrame(rows, "media_id bigint, idx bigint, vec array<double>"), 4, max_speakers=4).collect()}
    for m, g in enumerate((2, 3, 4)):
        assert len({(i % g, got[m, i]) for i in range(40)}) == g == len({got[m, i] for i in range(40)})


def test_few_rows_are_one_speaker(spark):
    df, _ = features(spark, medias=1, n=3)
    assert {r.label for r in sp.cluster_labels(df, 4).collect()} == {0}


def test_smoothing_case(spark):
    times, rows = [(0, 2000), (2000, 2800), (2800, 5000), (5000, 7000)], []
    for i, (s, e) in enumerate(times, 1):
        rows.append((1, i, s, e, "S00", "x"))
    labels = spark.createDataFrame([(1, 1, 3), (1, 2, 9), (1, 3, 3), (1, 4, 9)], "media_id bigint, idx bigint, label int")
    out = sp.apply_labels(arrange(spark.createDataFrame(rows, SCHEMA)), labels).df.orderBy("idx").collect()
    assert [r.speaker for r in out] == ["S01", "S01", "S01", "S02"]


def test_turns_case_and_media_without_turns(spark):
    rows = [(1, 1, 0, 1000, "S00", "a"), (1, 2, 1200, 2000, "S00", "b"), (1, 3, 2100, 3000, "S00", "c"), (2, 1, 0, 500, "S00", "d")]
    turns = spark.createDataFrame(
        [(1, 1, 0, 1100, "A"), (1, 2, 1100, 2050, "B"), (1, 3, 2050, 3100, "A")],
        "media_id bigint, turn_no bigint, turn_start_ms bigint, turn_end_ms bigint, source string",
    )
    out = sp.label_from_turns(arrange(spark.createDataFrame(rows, SCHEMA)), turns).df.orderBy("media_id", "idx").collect()
    assert [r.speaker for r in out] == ["S01", "S02", "S01", "S01"]


def test_features_tell_pitch_apart():
    rate, t = 16_000, np.arange(16_000) / 16_000
    tones = [0.3 * np.sin(2 * np.pi * hz * t) for hz in (120, 240)]
    parts = [tones[0], np.zeros(16_000), tones[1], tones[0][:100]]
    kept, vecs = batch_features(np.concatenate(parts).astype(np.float32), np.cumsum([0, *map(len, parts)]), rate)
    assert kept.tolist() == [0, 2] and vecs.shape == (2, 16)
    low, high = vecs
    # The tapered frame pulls the peak to a slightly shorter lag.
    assert abs(np.exp(low[8]) - 120) < 8 and abs(np.exp(high[8]) - 240) < 12 and low[10] > 0.9


def test_pitch_is_read_to_the_end_of_a_segment():
    """Half a segment at one pitch and half at another; what comes after many frames counts as what comes before."""
    rate, t = 16_000, np.arange(48_000) / 16_000
    low, high = (0.3 * np.sin(2 * np.pi * hz * t) for hz in (120, 240))
    noise = np.random.default_rng(1).normal(0, 0.21, 48_000)
    parts = [low, high, np.append(low, high), np.append(high, low), np.append(low, noise)]
    kept, vecs = batch_features(np.concatenate(parts).astype(np.float32), np.cumsum([0, *map(len, parts)]), rate)
    assert kept.tolist() == [0, 1, 2, 3, 4]
    middle = (vecs[0, 8] + vecs[1, 8]) / 2
    assert np.allclose(vecs[2:4, 8], middle, atol=0.1) and (vecs[2:4, 9] > 0.25).all() and (vecs[:2, 9] < 0.05).all()
    assert vecs[0, 10] > 0.9 and 0.2 < vecs[4, 10] < 0.85  # noise has no pitch in most frames


def test_frames_of_high_rates_are_transformed_whole():
    """At 48 kHz a frame has 1200 samples: the spectrum knows a tone that fades in behind the first 512 of them."""
    rate, size, hop = 48_000, 1200, 480
    window, n = np.hanning(size).astype(np.float32), size + 40 * hop
    t = np.arange(n) / rate
    wave = (0.3 * np.sin(2 * np.pi * 180 * t) + 0.1 * np.sin(2 * np.pi * 2500 * t)).astype(np.float32)
    _, vecs = batch_features(wave, np.array([0, n]), rate)
    centred = wave - wave.mean()
    frames = np.stack([centred[k * hop : k * hop + size] * window for k in range(41)])
    power = (frames**2).mean(axis=1)
    frames = frames[power >= np.quantile(power, 0.45)]
    p = np.abs(np.fft.rfft(frames, n=2048, axis=1)) ** 2
    hz = np.fft.rfftfreq(2048, 1 / rate)
    assert abs(vecs[0, 2] - (p @ hz / p.sum(axis=1)).mean()) < 1


def test_features_do_not_depend_on_the_batch():
    rng, rate = np.random.default_rng(3), 16_000
    parts = [rng.normal(size=n) * a for n, a in ((9000, 0.1), (16_000, 0.02), (500, 0.1), (4800, 0.3), (0, 1), (30_000, 0.05))]
    kept, vecs = batch_features(np.concatenate(parts).astype(np.float32), np.cumsum([0, *map(len, parts)]), rate)
    alone = [batch_features(p.astype(np.float32), np.array([0, len(p)]), rate) for p in parts]
    assert kept.tolist() == [i for i, (k, _) in enumerate(alone) if len(k)]
    assert np.allclose(vecs, np.concatenate([v for _, v in alone]), rtol=1e-4, atol=1e-5)
    shares = vecs[:, 11:]
    assert (shares > 0).all() and (shares.sum(axis=1) <= 1.0001).all() and (np.diff(shares.mean(axis=0)) > 0).all()  # noise: as wide as its band


@pytest.mark.parametrize("rate", [16_000, 8_000])
def test_frame_statistics_equal_the_arrow_form(spark, rate):
    """Level and zero crossings of noise, tones and near silence, against the features computed in batches."""
    rng = np.random.default_rng(6)
    slices = []
    for k in range(14):
        n = int(rng.integers(100, 6000))
        wave = rng.normal(0, 0.1, n) * (rng.random() < 0.7) + 0.3 * np.sin(np.arange(n) * rng.uniform(0.01, 1)) * (k % 3 > 0) + 0.2
        slices.append((1, k, [float(x) for x in wave.astype(np.float32)]))
    slices += [(1, 50, [0.001] * 5000), (1, 51, []), (2, 1, [0.5, -0.5] * 2000)]
    df = spark.createDataFrame(slices, "media_id bigint, idx bigint, samples array<float>")
    fast = {(r.media_id, r.idx): r.vec for r in audio.audio_features(df, rate).collect()}
    plain = {(r.media_id, r.idx): r for r in audio.frame_statistics(df, rate).collect()}
    assert set(fast) == set(plain) and len(plain) > 5
    for key, r in plain.items():
        v = fast[key]
        assert np.allclose([r.level_mean, r.level_deviation, r.crossings_mean, r.crossings_deviation], [v[0], v[1], v[6], v[7]], atol=2e-4)


def plain_silhouette(x, labels):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    scores = []
    for i, own in enumerate(labels):
        mean = {c: d[i][[j for j, l in enumerate(labels) if l == c and j != i]] for c in set(labels)}
        a = mean[own].mean() if len(mean[own]) else 0.0
        b = min((v.mean() for c, v in mean.items() if c != own), default=None)
        if b is not None:
            scores.append((b - a) / max(a, b, 1e-6))
    return sum(scores) / len(scores) if scores else -1.0


@pytest.mark.parametrize(("block", "strip", "reach"), [(512, 16, 32), (4, 3, 5), (1, 1, 1), (5, 2, 100)])
def test_silhouettes_equal_brute_force_and_leave_sums_only(spark, monkeypatch, block, strip, reach):
    """Media of several strips, equal rows, a cluster of one row, one cluster only, a k that one media lacks."""
    for name, value in (("BLOCK", block), ("STRIP", strip), ("REACH", reach), ("WIDE", 7)):
        monkeypatch.setattr(sp, name, value)
    rng, rows, labels, plain = np.random.default_rng(5), [], [], {}
    for m, n in ((1, 40), (2, 7), (3, 12), (4, 3)):
        x = rng.normal(size=(n, 4)) + np.arange(n)[:, None] % 3
        x[n // 2 :] = x[0] if m == 3 else x[n // 2 :]
        x = np.zeros((n, 4)) if m == 4 else x
        rows += [(m, 10 * i, [float(v) for v in r]) for i, r in enumerate(x)]
        for k in (2, 3, 5) if m != 2 else (2, 3):
            label = [min(i % k, n - 1) if i else k - 1 for i in range(n)] if (m, k) != (2, 3) else [0] * n
            labels += [(m, k, 10 * i, c) for i, c in enumerate(label)]
            plain[m, k] = plain_silhouette(x, label)
    rows, labels = spark.createDataFrame(rows, "media_id bigint, idx bigint, vec array<double>"), spark.createDataFrame(labels, "media_id bigint, k int, idx bigint, label int")
    got = {(r.media_id, r.k): r.silhouette for r in sp.silhouettes(rows, labels, 4).collect()}
    assert set(got) == set(plain) and all(abs(got[k] - plain[k]) < 1e-9 for k in plain)
    blocks = -(-40 // block)
    strips, turns = -(-blocks // strip), -(-blocks // reach)
    assert sp._distance_sums(rows, labels, 4, 8).filter("media_id = 1").count() <= 40 * 3 * (strips + turns)


def test_starts_name_one_row_of_equal_ones(spark, tmp_path):
    """Every vector three times: a start is the copy with the smallest idx, as in SQL."""
    import duckdb

    from cuesheet.queries.speakers import query

    con, source = duckdb.connect(), "/root/testdata/sf0.001/embeddings.parquet"
    con.execute(f"COPY (SELECT vec_id + 100000 * k AS vec_id, embedding, label FROM '{source}', range(3) r(k)) TO '{tmp_path}/embeddings.parquet'")
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    want = con.execute(f"SELECT media_id, place, idx FROM ({query.oracles['farthest_first']})").fetchall()
    got = query.queries["farthest_first"](spark, str(tmp_path)).select("media_id", "place", "idx").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_a_round_measures_packs_of_rows():
    """Centres stand once beside a pack; sums, counts and moves are those of its rows."""
    import pyarrow as pa

    draw = np.random.default_rng(5)
    packs, c, before = [draw.normal(size=(n, 3)) for n in (7, 1, 40)], draw.normal(size=(2, 3)), draw.normal(size=(1, 3))
    flat = lambda rows: pa.array([x.ravel() for x in rows], pa.list_(pa.float64()))
    batch = pa.RecordBatch.from_arrays(
        [pa.array([1, 1, 1]), pa.array([2, 2, 2], pa.int32()), flat(packs), flat([c] * 3), flat([before] * 3)], names=["media_id", "k", "vecs", "c", "before"]
    )
    got = {r["label"]: r for out in sp._round_sums(3)([batch]) for r in out.to_pylist()}
    rows = np.concatenate(packs)
    label = ((rows[:, None] - c) ** 2).sum(2).argmin(1)
    assert len(got) == 2
    for at, r in got.items():
        assert r["n"] == (label == at).sum() and r["moved"] == (r["n"] if at else 0) and np.allclose(r["s"], rows[label == at].sum(0))
