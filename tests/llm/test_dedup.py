"""Line, substring and near-duplicate removal against plain versions on odd documents."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuesheet.llm import lines, minhash, quality, substrings
from cuesheet.llm.fmindex import FMIndex
from tests.llm.helpers import LOWER, clashing, frame, odd_documents, words

FAR = 10**9


def plain_lines(rows, docs=2):
    strip = " \t\n\x0b\f\r"
    keys = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            keys.setdefault(line.strip(strip).translate(LOWER), set()).add(FAR if i is None else i)
    out = Counter()
    for i, t in rows:
        all_lines = (t or "").split("\n")
        held = [keys[x.strip(strip).translate(LOWER)] if len(x.strip(strip)) >= 10 else {FAR} for x in all_lines]
        stay = [x for x, h in zip(all_lines, held) if len(h) < docs or min(h) == (FAR if i is None else i)]
        out[(i, len(all_lines), len(all_lines) - len(stay), t if len(stay) == len(all_lines) else "\n".join(stay))] += 1
    return out


@pytest.mark.parametrize("docs", [2, 3])
@pytest.mark.parametrize("extra", [False, True])
def test_lines(spark, extra, docs):
    rows = odd_documents()
    df = frame(spark, rows)
    out = lines.drop_repeated_lines(clashing(df) if extra else df, min_docs=docs)
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect())
    assert got == plain_lines(rows, docs)
    if extra:
        assert out.columns == [c for c in clashing(df).columns if c != "n_lines"] + ["n_lines", "n_dropped"]
        assert {r.key for r in out.collect()} == {"own key"}


def plain_windows(rows, window):
    seen = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            seen[g] = min(seen.get(g, FAR), FAR if i is None else i)
    out = Counter()
    for i, t in rows:
        w, gone = words(t), set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] < (FAR if i is None else i):
                gone |= set(range(k, k + window))
        out[(i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))] += 1
    return out


@pytest.mark.parametrize("window, runs", [(50, 4000), (50, 2), (5, 3), (12, 4000), (1, 4000)])
def test_windows(spark, monkeypatch, window, runs):
    """Also with grams dealt over many shards."""
    monkeypatch.setattr(substrings, "SHARD_RUNS", runs)
    rows = odd_documents()
    out = substrings.repeated_windows(clashing(frame(spark, rows)), window=window).collect()
    assert Counter((r.doc, r.n_words, r.n_removed, r.kept) for r in out) == plain_windows(rows, window)
    for r in out:
        assert sum(x.stop - x.start for x in r.removed) == r.n_removed


def test_index_answers_streamed_queries():
    """Queries that are not in the index, with words it doesn't know, for several window lengths."""
    rng = np.random.default_rng(5)
    for window in (1, 2, 7, 30):
        pool = rng.integers(0, 4, 500).astype(np.uint64)
        lengths = rng.integers(0, 90, 25)
        held = [pool[a : a + n] for a, n in zip(rng.integers(0, 400, 25), lengths)]
        owners = rng.integers(0, 99, 25)
        index = FMIndex(np.concatenate(held), lengths, owners, window)
        least = {}
        for part, o in zip(held, owners):
            for k in range(len(part) - window + 1):
                g = tuple(part[k : k + window])
                least[g] = min(least.get(g, FAR), o)
        queries = [pool[a : a + 60] for a in range(0, 400, 90)] + [rng.integers(0, 6, 70).astype(np.uint64), np.zeros(0, np.uint64)]
        got = index.least_owners(np.concatenate(queries), np.array([len(q) for q in queries]))
        want = [least.get(tuple(q[k : k + window]), -1) if k + window <= len(q) else -1 for q in queries for k in range(len(q))]
        assert got.tolist() == want


def plain_components(rows, k, percent):
    texts = {}
    for i, t in rows:
        if i is not None:
            texts[i] = min(texts.get(i, t or ""), t or "")
    sets = {}
    for i, t in texts.items():
        w = words(t.translate(LOWER))
        sets[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                common = len(sets[a] & sets[b])
                if common and 100 * common >= percent * len(sets[a] | sets[b]) and label[b] < label[a]:
                    label[a], changed = label[b], True
    return {(i, len(sets[i]), label[i], label[i] == i) for i in sets}


def near_group(n, seed=3):
    """Copies of one text with random changes: a chain of similarities around the threshold."""
    import random

    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(60)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(60)] = f"v{rng.randrange(500)}"
        rows.append((i + 100, " ".join(w)))
    return rows


@pytest.mark.parametrize("k, large, docs, shingles", [(4, 64, 512, 1 << 18), (5, 2, 512, 1 << 18), (4, 2, 6, 1 << 18), (4, 2, 512, 400)])
def test_near_duplicates(spark, monkeypatch, k, large, docs, shingles):
    """Also with buckets compared in tiles, whole or in many parts."""
    monkeypatch.setattr(minhash, "LARGE", large)
    monkeypatch.setattr(minhash, "TILE_DOCS", docs)
    monkeypatch.setattr(minhash, "TILE_SHINGLES", shingles)
    rows = odd_documents() + near_group(60)
    out = minhash.near_duplicates(clashing(frame(spark, rows)), k=k).collect()
    assert {tuple(r) for r in out} == plain_components(rows, k, 80)


def test_tiles_alone_link_a_group(spark):
    """All of a bucket by tiles, with one label that is large enough to stand apart."""
    rows = near_group(90)
    df = frame(spark, rows).select(F.col("doc_id").alias("doc"), "text")
    bucket = df.select(F.lit(1).cast("bigint").alias("key"), "doc", F.lit(57).cast("bigint").alias("n"), F.when(F.col("doc") < 150, 100).otherwise(F.col("doc")).cast("bigint").alias("label"))
    scratch = minhash.Scratch(spark, "test")
    kept, minhash.TILE_DOCS = minhash.TILE_DOCS, 16
    try:
        links = {(r.a, r.b) for r in minhash._tiled(scratch.keep(bucket, "bucket"), df, scratch, 4, 80).collect()}
    finally:
        minhash.TILE_DOCS = kept
    sets = {i: {tuple(t.split()[a : a + 4]) for a in range(57)} for i, t in rows}
    near = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert {(min(x), max(x)) for x in links} <= near

    def labels(edges):
        label = {i: 100 if i < 150 else i for i in sets}
        for _ in sets:
            for a, b in edges:
                low, high = sorted((label[a], label[b]))
                label = {i: low if x == high else x for i, x in label.items()}
        return label

    assert labels(links) == labels(near)


def test_common_counts():
    rng = np.random.default_rng(2)
    for n, m, values in ((1, 1, 5), (3, 7, 20), (200, 90, 3000), (40, 40, 60)):
        a, b = ([np.unique(rng.integers(0, values, rng.integers(1, values))) for _ in range(k)] for k in (n, m))
        assert minhash.common_counts(a, b).tolist() == [[len(np.intersect1d(x, y)) for y in b] for x in a]


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_hashed_and_string_ids(spark, kind):
    rows = [(2**62 + i, t) for i, t in near_group(12)]
    df = frame(spark, rows).withColumn("doc_id", F.col("doc_id").cast(kind))
    want = {(str(d), str(c)) for d, _, c, _ in plain_components(rows, 5, 80)}
    assert {(str(r.doc), str(r.component)) for r in minhash.near_duplicates(df).collect()} == want


def thue_morse(n):
    t = [False]
    while len(t) < n:
        t += [not x for x in t]
    return "".join("ab"[x] for x in t), "".join("ba"[x] for x in t)


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_whose_sums_of_powers_meet(spark, n):
    """Words of opposite letters in the order that makes polynomial hashes modulo a power of two equal."""
    x, y = thue_morse(n)
    fill = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"{x} {fill}"), (2, f"{y} {fill}"), (3, x), (4, y), (5, f"{x} a b {y} a b {x} c d"), (6, " ".join([x, *"abcdefgh"])), (7, " ".join([y, *"abcdefgh"]))]
    got = {r.doc: r.n_removed for r in substrings.repeated_windows(frame(spark, rows)).collect()}
    assert {i: got[i] for i in got} == {i: n for i, _, n, _ in plain_windows(rows, 50)}
    assert {tuple(r) for r in minhash.near_duplicates(frame(spark, rows)).collect()} == plain_components(rows, 5, 80)
    (r,) = quality.repetition_rules(frame(spark, [(1, f"{x} b c {y} b c")])).select("n_repeat_words").collect()
    assert r.n_repeat_words == 0


def test_signature_bands_meet_at_the_similarity():
    rng = np.random.default_rng(1)
    missed = 0
    for _ in range(200):
        common, a, b = rng.integers(0, 2**63, 160, dtype=np.uint64), rng.integers(0, 2**63, 20, dtype=np.uint64), rng.integers(0, 2**63, 20, dtype=np.uint64)
        x, y = minhash.band_keys(np.concatenate((common, a))), minhash.band_keys(np.concatenate((common, b)))
        missed += not (x == y).any()
    assert missed == 0


@pytest.mark.parametrize("op", [lines.drop_repeated_lines, substrings.repeated_windows, minhash.near_duplicates])
def test_empty_table(spark, op):
    assert op(frame(spark, [(1, "x")]).filter("false")).count() == 0


def test_no_python_in_the_line_plan(spark):
    plan = lines.drop_repeated_lines(frame(spark, odd_documents()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_kept_text_digest(spark):
    out = substrings.repeated_windows(frame(spark, [(1, "a\n b")])).select(F.sha2("kept", 256).alias("h")).first()
    assert out.h == hashlib.sha256(b"a b").hexdigest()
