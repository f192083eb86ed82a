"""The Merkle manifest against a plain tree over sorted leaves."""

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cuesheet.llm import merkle
from tests.llm.helpers import LOWER, SCHEMA, clashing, frame, odd_documents


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves):
    """(root, for each leaf its [(left, right)] up to the root)."""
    level, at, steps = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        runs = [level[i : i + 8] for i in range(0, len(level), 8)]
        for k, p in enumerate(at):
            run, slot = runs[p // 8], p % 8
            steps[k].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
            at[k] = p // 8
        level = [h(*run) for run in runs]
    return level[0], steps


def plain(rows, tamper=lambda i: False):
    groups = {}
    for i, t, lang, source, n in rows:
        change = t.translate(LOWER) if t is not None and i is not None and tamper(i) else t
        leaf, current = (h(*map(field, (i, source, lang, n, x))) for x in (t, change))
        groups.setdefault(lang, []).append(((i is not None, i or 0), leaf, current, i))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    inner = {}
    for g in order:
        groups[g].sort(key=lambda r: r[:2])
        inner[g] = tree([r[1] for r in groups[g]])
    root, outer = tree([inner[g][0] for g in order])
    out = Counter()
    for g, up in zip(order, outer):
        for (_, leaf, current, i), steps in zip(groups[g], inner[g][1]):
            folded = current
            for left, right in steps + up:
                folded = h(left, folded, right)
            out[(i, leaf, inner[g][0], root, h(*[a + b for a, b in steps + up]), folded, folded == root)] += 1
    return out


def got(df, **given):
    out = merkle.manifest(df, **given)
    return Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in out.collect())


def test_odd_rows(spark):
    rows = [(i, t, ("en", None, "", "zh", "é")[k % 5], None if k % 3 else "s", k) for k, (i, t) in enumerate(odd_documents())]
    df = spark.createDataFrame(rows, SCHEMA)
    expected = plain(rows)
    assert got(df) == expected
    assert got(clashing(df).withColumns({c: F.lit("x") for c in ("leaf", "root", "path", "group", "pos", "slots")})) == expected


def test_repeats_negative_and_far_ids(spark):
    ids = [*range(-70, 200), 2**63 - 1, -(2**63), 2**62, 2**40 + 5, 2**40 + 5, 63, 63, 63, None, None, None, *[7] * 30]
    rows = [(i, f"T{k % 5} text", "one" if k % 7 else "two", "s", 1) for k, i in enumerate(ids)]
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(5)) == plain(rows)


def test_sizes(spark):
    rows = [(1000 * n + i, f"t{i}", f"group of {n}", "s", 1) for n in (1, 2, 8, 9, 64, 65, 513) for i in range(n)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == plain(rows)
    assert not got(spark.createDataFrame([], SCHEMA))


def test_many_groups(spark):
    rows = [(i, f"t{i}", f"g{i * 37 % 70}", "s", 1) for i in range(150)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_tampered_rows_are_found(spark):
    rows = [(i, "Some TEXT" if i % 2 else "plain", "en" if i % 5 else "de", "s", 1) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    fields = ("doc_id", "source", "lang", "n_chars")
    change = F.when(F.crc32(df["doc_id"].cast("string").cast("binary")) % 3 == 0, F.lower("text")).otherwise(F.col("text"))
    found = got(df, fields=(*fields, "text"), current_leaf=merkle.digest(*[merkle.field(df[f]) for f in fields], merkle.field(change)))
    assert found == plain(rows, lambda i: zlib.crc32(str(i).encode()) % 3 == 0)
    assert 0 < sum(n for r, n in found.items() if not r[-1]) < 60


def test_long_text_and_id_types(spark):
    long = "Ünï " * 400_000
    assert got(frame(spark, [(1, long), (2, None)])) == plain([(1, long, "en", "src0", len(long)), (2, None, "en", "src0", None)])
    with pytest.raises(TypeError):
        merkle.manifest(frame(spark, [(1, "a")]).withColumn("doc_id", F.lit("x")))
