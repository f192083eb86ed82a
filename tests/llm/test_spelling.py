"""Spelling variants against plain edit distances."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cuesheet.llm import spelling
from tests.llm.helpers import LOWER, SCHEMA, clashing, frame, odd_documents


def plain_counts(rows, least=6, rows_needed=5, deleted=199):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % deleted == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= least and c >= rows_needed}


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(vocab, ratio=5):
    near = {w: [v for v in vocab if v != w and one_edit(v, w)] for w in vocab}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda v: (-vocab[v], v))
            if vocab[best] >= ratio * vocab[w]:
                form[w] = best
    out = set()
    for w in vocab:
        root = w
        while root in form:
            root = form[root]
        f = form.get(w)
        out.add((w, f, root, vocab[w], len(near[w]), vocab[f] if f else None))
    return out


def got(words, **given):
    rows = spelling.variants(words, **given).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(rows) == len({r.word for r in rows})
    return {tuple(r) for r in rows}


def typed(rng, word):
    at, kind = rng.randrange(len(word)), rng.choice("dri")
    letter = rng.choice("abcéÿ×")
    return word[:at] + {"d": "", "r": letter, "i": letter + word[at]}[kind] + word[at + 1 :]


def vocabulary(seed, n=120):
    rng = random.Random(seed)
    words = {}
    for _ in range(n):
        w = "".join(rng.choices("abcdeéÿ", k=rng.randint(2, 9)))
        for _ in range(rng.randint(1, 6)):
            words[w] = rng.choice([1, 2, 5, 5, 10, 26, 130, 700, 4000])
            w = typed(rng, w) or w
    return words


@pytest.mark.parametrize("classes", [None, 1, 3, 5])
def test_variants(spark, classes):
    vocab = vocabulary(classes or 9)
    words = spark.createDataFrame(list(vocab.items()), "word string, n bigint")
    assert got(words, classes=classes) == plain_variants(vocab)


def test_blocks_cut_into_parts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "CHUNK", 7)
    vocab = vocabulary(4, 200)
    assert got(spark.createDataFrame(list(vocab.items()), "word string, n bigint"), classes=1) == plain_variants(vocab)


def test_ties_chains_and_odd_rows(spark):
    vocab = {"": 4, "a": 20, "aa": 100, "ab": 500, "abc": 2500, "abd": 2500, "b": 20, "ba": 100, "😀": 1, "😀a": 5, "x" * 5000: 9, "x" * 4999 + "y": 50, "x" * 4999: 300}
    rows = [*vocab.items(), (None, 7)]
    rows = [(w, c - 1) for w, c in rows] + [(w, 1) for w, _ in rows]  # each twice, to be added up
    df = spark.createDataFrame(rows, "word string, n bigint").withColumns({c: F.lit("own") for c in ("key", "part", "form", "root", "same", "words")})
    assert got(df) == plain_variants(vocab)
    assert got(spark.createDataFrame([], "word string, n bigint")) == set()


def test_counts(spark):
    rng = random.Random(2)
    stock = ["Straße", "naïveté", "Letters", "letters", "LETTERS", "À-côté", "ÀÈÌÒÙÝ", "short", "déjà×vu÷deux", "abcdefg", "x1y2zzzzzzz", "Ελληνικά", "don't"] + ["".join(rng.choices("abcdefgh", k=8)) for _ in range(20)]
    rows = odd_documents() + [(i, " ".join(rng.choices(stock, k=60))) for i in range(40, 100)]
    for deleted in (199, 3):
        counted = spelling.word_counts(clashing(frame(spark, rows)).withColumns({c: F.lit("own") for c in ("run", "word", "h", "found")}), deleted=deleted)
        assert {(r.word, r.n) for r in counted.collect()} == set(plain_counts(rows, deleted=deleted).items())
    assert not spelling.word_counts(spark.createDataFrame([], SCHEMA)).collect()
