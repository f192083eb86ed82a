"""One-permutation fingerprints: bins against a plain version, estimates against true similarities, edits against plain ones."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cuesheet.llm import fingerprints as fp
from cuesheet.llm.words import mix, texts
from tests.llm.helpers import LOWER, SCHEMA, clashing, frame, odd_documents, words


def shingles(text, k=fp.SHINGLE):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def prints(values):
    return fp.packed(*texts(pa.array(values, pa.string())))


def test_bins_by_definition():
    rng = random.Random(3)
    values = [" ".join(rng.choice("abcdefgh") for _ in range(n)) for n in (1, 4, 5, 6, 30, 300, 3000)] + ["", " \n", None]
    data, bounds = texts(pa.array(values, pa.string()))
    got, some = fp.bins_of(data, bounds)
    text, value = fp._shingles(data, bounds, fp.SHINGLE)
    ranks = fp._borrowing_ranks()
    for t, v in enumerate(values):
        hashes = mix(np.unique(value[text == t]))
        assert len(hashes) == len(shingles(v)) and some[t] == bool(len(hashes))
        kept = {}
        for h in map(int, hashes):
            kept[h >> 55] = min(kept.get(h >> 55, 2**64), h & (2**55 - 1))
        for b in range(fp.BINS):
            if kept:
                assert int(got[t, b]) == kept[b if b in kept else min(kept, key=lambda j: ranks[b, j])]


def test_likeness_estimates_the_similarity():
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    for n in (20, 60, 300, 2000):
        off = []
        for share in (0.0, 0.3, 0.6, 0.9, 1.0):
            for _ in range(12):
                a = [word() for _ in range(n)]
                b = a[: round(n * share)] + [word() for _ in range(n - round(n * share))]
                x, y = shingles(" ".join(a)), shingles(" ".join(b))
                true = len(x & y) / len(x | y)
                told = fp.likeness(*prints([" ".join(a), " ".join(b)]))
                off.append(told - true)
                assert abs(told - true) < 0.2 if n < 100 else abs(told - true) < 0.12
                assert 0 <= told <= 1 and (true < 1 or told == 1)
        assert abs(np.mean(off)) < 0.03  # without bias
    assert fp.likeness(b"", b"") == 1 and fp.likeness(b"", prints(["a"])[0]) == 0


def plain(rows, spark):
    hashes = {t: h for t, h in spark.createDataFrame([(t,) for t in {t for _, t in rows}], "t string").select("t", F.xxhash64("t")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
    out = Counter()
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after = t or "", after or ""
        q = len(t) // 4
        e = t[: len(t) - q] + after[:q]
        own, other, following = prints([t, e, after])
        out[(i, len(t), hashlib.sha256(e.encode()).hexdigest(), own.hex(), other.hex(), fp.likeness(own, other), fp.likeness(own, following))] += 1
    return out


def got(df, **given):
    return Counter(tuple(r) for r in fp.edited_fingerprints(df, **given).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect())


@pytest.mark.parametrize("parts", [1, 7])
def test_edits(spark, parts, monkeypatch):
    rows = odd_documents() + [(30, "😀é漢 " * 50), (31, "x" * 7), (32, "́" * 9)]
    df = frame(spark, rows).repartition(3)
    assert got(clashing(df).withColumns({c: F.lit("own") for c in ("hash", "salt", "data", "part", "head")}) if parts == 7 else df, parts=parts) == plain(rows, spark)


def test_hot_id_one_row_none(spark):
    rows = [(5, f"text number {i % 9} of a few words more") for i in range(80)] + [(None, "a b")] * 3
    assert got(frame(spark, rows), parts=5) == plain(rows, spark)
    assert got(frame(spark, [(1, "only one text here")])) == plain([(1, "only one text here")], spark)
    assert not got(spark.createDataFrame([], SCHEMA))
    with pytest.raises(TypeError):
        fp.edited_fingerprints(frame(spark, rows).withColumn("doc_id", F.lit("x")))


def test_long_texts_cross_groups(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(["Wort", "été", "of", "x", "漢字"], k=n))) for i, n in enumerate((10, 300_000, 5, 250_000, 40))]
    assert got(frame(spark, rows), parts=2) == plain(rows, spark)


def test_column(spark):
    df = clashing(frame(spark, odd_documents()))
    out = fp.with_fingerprints(df, name="label")
    assert out.columns == [c for c in df.columns if c != "label"] + ["label"]
    for r in out.collect():
        assert r.label == prints([r.text])[0].hex() and r.key == "own key"
