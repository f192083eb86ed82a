"""Near-duplicate documents by min-max hashing, exact confirmation and connected components.

Every permutation of the shingle hashes yields its smallest and its largest value, so ``bands * rows``
signature values take half as many hash evaluations.  Values are banded; documents that share a band are
compared through the band's first document, then through its most typical one.  Whatever that leaves in different
components is compared in full: small buckets in pairs, large ones as tiles, products of blocks of whole sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pyspark.sql.pandas.types import to_arrow_type

from cuesheet.llm.components import components
from cuesheet.llm.scratch import Scratch
from cuesheet.llm.words import grams, mix, pieces, sequence, split

BANDS, ROWS = 54, 6
LARGE = 32  # documents of a bucket above which it is compared in tiles
TILE_DOCS, TILE_SHINGLES = 512, 1 << 18  # of a side of a tile
_BLOCK = 2048
_MULTIPLIERS = np.random.default_rng(7).integers(0, 2**63, BANDS * ROWS // 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array, k: int):
    """The sorted distinct shingle hashes of each text in turn; fewer than ``k`` words make one shingle."""
    for _, _, data, bounds in pieces(column):
        _, _, word, first = split(data, bounds, fold=True)
        runs = grams(word, k)
        for a, b in zip(first[:-1], first[1:]):
            yield np.unique(runs[a : b - k + 1]) if b - a >= k else np.array([sequence(word[a:b])] if b > a else [], np.uint64)


def band_keys(values: np.ndarray) -> np.ndarray:
    """One key per band of the min-max signature of a set."""
    low = np.full(len(_MULTIPLIERS), np.uint64(2**64 - 1))
    high = np.zeros(len(_MULTIPLIERS), np.uint64)
    for at in range(0, len(values), _BLOCK):
        turned = _MULTIPLIERS[:, None] * values[None, at : at + _BLOCK]
        np.minimum(low, turned.min(axis=1), out=low)
        np.maximum(high, turned.max(axis=1), out=high)
    signature = np.stack([low, high], axis=1).reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + signature[:, r])
    return key.view(np.int64)


def _signed(docs: DataFrame, k: int) -> DataFrame:
    """Per row: doc, n, a fingerprint of the set (two longs) and the band keys."""
    schema = T.StructType([docs.schema["doc"], T.StructField("n", T.LongType()), T.StructField("f1", T.LongType()), T.StructField("f2", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            n, f1, f2, bands = [], [], [], []
            for s in shingle_sets(batch.column("text"), k):
                n.append(len(s))
                f1.append(mix(s).sum(dtype=np.uint64))
                f2.append(mix(s * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64))
                bands.append(band_keys(s) if len(s) else None)
            prints = [pa.array(np.array(f, np.uint64).view(np.int64)) for f in (f1, f2)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(n, pa.int64()), *prints, pa.array(bands, pa.list_(pa.int64()))], names=schema.names)

    return docs.mapInArrow(run, schema)


def _confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets have ``100 * common >= percent * union``."""
    text = lambda name: docs.select(F.col("doc").alias(name), F.col("text").alias(f"text_{name}"))
    both = pairs.join(text("a"), "a").join(text("b"), "b").select("a", "b", "text_a", "text_b")
    schema = pairs.select("a", "b").schema

    def run(batches):
        for batch in batches:
            keep = []
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                for x, y in zip(shingle_sets(part.column("text_a"), k), shingle_sets(part.column("text_b"), k)):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, schema)


def common_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many values each set of ``a`` has in common with each of ``b``; sets are arrays without repeats."""
    counts = np.zeros((len(a), len(b)), np.float32)
    row_a, row_b = (np.repeat(np.arange(len(sets)), [len(s) for s in sets]) for sets in (a, b))
    values, place = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    in_a, in_b = place[: len(row_a)], place[len(row_a) :]
    n_a, n_b = np.bincount(in_a, minlength=len(values)), np.bincount(in_b, minlength=len(values))
    # Values of few sets add pair by pair, the others as products of 0/1 matrices.
    work = n_a * n_b
    dense = np.flatnonzero(work > len(a) * len(b) // 64)
    slot = np.full(len(values), -1)
    slot[dense] = np.arange(len(dense))
    for at in range(0, len(dense), _BLOCK):
        sides = []
        for rows, cols, n in ((row_a, in_a, len(a)), (row_b, in_b, len(b))):
            side = np.zeros((n, min(_BLOCK, len(dense) - at)), np.float32)
            own = slot[cols] - at
            hit = (slot[cols] >= 0) & (own >= 0) & (own < side.shape[1])
            side[rows[hit], own[hit]] = 1
            sides.append(side)
        counts += sides[0] @ sides[1].T
    light = (slot < 0) & (work > 0)
    keep_a, keep_b = np.flatnonzero(light[in_a]), np.flatnonzero(light[in_b])
    keep_b = keep_b[np.argsort(in_b[keep_b], kind="stable")]
    first = np.searchsorted(in_b[keep_b], np.arange(len(values) + 1))
    for at in range(0, len(keep_a), 4096):
        part = keep_a[at : at + 4096]
        v = in_a[part]
        many = first[v + 1] - first[v]
        other = np.repeat(first[v] - np.cumsum(many) + many, many) + np.arange(many.sum())
        counts += np.bincount(np.repeat(row_a[part], many) * len(b) + row_b[keep_b[other]], minlength=counts.size).reshape(counts.shape)
    return counts.astype(np.int64)


def _spanning(pairs: list[tuple]) -> list[int]:
    """Which pairs of labels connect what the ones before don't."""
    joined: dict = {}

    def top(x):
        while joined.setdefault(x, x) != x:
            joined[x] = joined[joined[x]]
            x = joined[x]
        return x

    out = []
    for k, (x, y) in enumerate(pairs):
        x, y = top(x), top(y)
        if x != y:
            joined[y] = x
            out.append(k)
    return out


def _tiled(rows: DataFrame, docs: DataFrame, scratch: Scratch, k: int, percent: int) -> DataFrame:
    """Links (a, b) that connect all documents of each bucket which links inside it connect.

    ``rows`` (key, doc, n, label) are large buckets.  A bucket is dealt into parts of bounded size, those of one large label apart; every
    two parts meet as one row with both sides' whole sets, but for parts of one and the same label.  A tile compares all its
    pairs by products and leaves at most one link per document.
    """
    kind = docs.schema["doc"].dataType
    limit = lambda docs, shingles: F.greatest(F.ceil(docs / TILE_DOCS), F.ceil(shingles / TILE_SHINGLES), F.lit(1))
    labels = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("d"), F.sum("n").alias("s"))
    labels = labels.withColumn("big", (F.col("d") > TILE_DOCS // 2) | (F.col("s") > TILE_SHINGLES // 2)).withColumn("own", limit(F.col("d"), F.col("s")))
    labels = scratch.keep(labels, "tile-labels")
    rest = labels.filter("NOT big").groupBy("key").agg(limit(F.sum("d"), F.sum("s")).alias("rest"))
    labels = labels.join(scratch.keep(rest, "tile-rest"), "key", "left").select("key", "label", "big", F.when(F.col("big"), F.col("own")).otherwise(F.col("rest")).alias("parts"))
    part = F.when(F.col("big"), F.concat_ws(":", F.xxhash64("label"), F.pmod(F.xxhash64("doc"), F.col("parts")))).otherwise(F.concat_ws(":", F.lit(""), F.pmod(F.xxhash64("label"), F.col("parts"))))
    rows = rows.join(scratch.keep(labels, "tile-parts"), ["key", "label"]).select("key", "doc", "label", part.alias("part"), F.when(F.col("big"), F.xxhash64("label")).alias("only"))
    rows = scratch.keep(rows, "tile-rows")
    sets = _sets(docs.join(scratch.keep(rows.select("doc").distinct(), "tile-docs"), "doc"), k)
    rows = rows.join(scratch.keep(sets, "tile-sets"), "doc")
    chunks = rows.groupBy("key", "part").agg(F.first("only").alias("only"), F.collect_list(F.struct("doc", "label", "shingles")).alias("members"))
    chunks = scratch.keep(chunks, "tile-chunks")
    other = chunks.select("key", F.col("part").alias("part2"), F.col("only").alias("only2"), F.col("members").alias("members2"))
    tiles = chunks.join(other, "key").filter((F.col("part") <= F.col("part2")) & ~(F.coalesce(F.col("only") == F.col("only2"), F.lit(False))))
    tiles = tiles.select(*[F.col(m)[f].alias(f"{f}{m[7:]}") for m in ("members", "members2") for f in ("doc", "label", "shingles")])
    arrow = to_arrow_type(kind)
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])

    def run(batches):
        for batch in batches:
            for t in range(len(batch)):
                sides = []
                for suffix in ("", "2"):
                    sets = batch.column(f"shingles{suffix}").slice(t, 1).flatten()
                    values, bounds = sets.flatten().to_numpy(), sets.value_lengths().to_numpy()
                    sides.append(np.split(values, np.cumsum(bounds)[:-1]))
                found = common_counts(*sides)
                n, m = (np.array([len(x) for x in side]) for side in sides)
                docs, labels = ([batch.column(f"{c}{s}")[t].as_py() for s in ("", "2")] for c in ("doc", "label"))
                number = {x: i for i, x in enumerate(dict.fromkeys(labels[0] + labels[1]))}
                of = [np.array([number[x] for x in side]) for side in labels]
                near = (100 * found >= percent * (n[:, None] + m[None] - found)) & (of[0][:, None] != of[1][None])
                i, j = np.nonzero(near)
                _, once = np.unique(of[0][i] * len(number) + of[1][j], return_index=True)
                i, j = i[once], j[once]
                keep = _spanning(list(zip(of[0][i].tolist(), of[1][j].tolist())))
                yield pa.RecordBatch.from_arrays([pa.array([docs[0][x] for x in i[keep]], arrow), pa.array([docs[1][x] for x in j[keep]], arrow)], names=["a", "b"])

    return tiles.mapInArrow(run, schema)


def _close(n: Column, other: Column, percent: int) -> Column:
    """Whether sets of these sizes can reach the similarity."""
    return 100 * F.least(n, other) >= percent * F.greatest(n, other)


def _reachable(n: Column, other: Column, common: Column, common_other: Column, percent: int) -> Column:
    """Whether sets of these sizes, with so many shingles in common with others at most, can reach the similarity."""
    return _close(n, other, percent) & ((100 + percent) * F.least(common, common_other) >= percent * (n + other))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """(doc, n_shingles, component, kept) of every document.

    A document's set holds the hashes of its distinct ``k``-word shingles, A-Z in lower case (fewer words: the whole
    sequence is the one shingle).  Documents are linked when their sets have at least ``percent`` % in common;
    ``component`` is the smallest id reachable over links, ``kept`` says that it is the document's own.

    Documents with equal sets count as one from the start, whatever their number.  A pair at 80 % is missed by all
    bands with probability (1 - 0.8**6)**54, about 1e-7.  Each band's members are confirmed against its smallest id.
    For buckets still in different components, the shingles that each member has in common with members of other
    components are counted: they bound every overlap, so a member with too few is done.  The others are
    confirmed against the member with the largest share in common.  What is still apart is compared in full: buckets of up to
    ``LARGE`` documents in pairs, larger ones in tiles (``_tiled``), whose work grows with the square of what is still apart in a bucket but whose
    rows do not.  Nothing is capped, and no step gathers a bucket in one place.

    Null text, or text without words: an empty set, linked with nothing.  Rows with the same id are one
    document with the least of their texts; null ids are left out, as they name no document.  An empty table
    gives an empty table.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    docs = docs.select(docs[id_col].alias("doc"), F.coalesce(docs[text_col], F.lit("")).alias("text")).filter(F.col("doc").isNotNull())
    signed = scratch.keep(_signed(docs, k), "signed")
    if signed.groupBy("doc").count().filter("count > 1").limit(1).count():
        docs = scratch.keep(docs.groupBy("doc").agg(F.min("text").alias("text")), "docs")
        scratch.drop(signed)
        signed = scratch.keep(_signed(docs, k), "signed")
    classes = scratch.keep(signed.filter(F.col("n") > 0).groupBy("n", "f1", "f2").agg(F.min("doc").alias("class")), "groups")
    own = signed.select("doc", "n", "f1", "f2").join(classes, ["n", "f1", "f2"], "left").select("doc", "n", F.coalesce("class", "doc").alias("class"))
    own = scratch.keep(own, "classes")

    heads = own.filter(F.col("doc") == F.col("class")).select("doc")
    members = signed.filter(F.col("n") > 0).join(heads, "doc", "left_semi").select("doc", "n", F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > 1).select("key")
    buckets = scratch.keep(members.join(scratch.keep(shared, "shared"), "key"), "buckets")  # written, so that hot keys can be split
    scratch.drop(signed)

    links, labels, tried, common = None, None, None, None
    for turn in ("first", "typical", "pairs"):
        rows = buckets.withColumn("label", F.col("doc"))
        if labels is not None:
            rows = buckets.join(labels, F.col("doc") == F.col("node"), "left").withColumn("label", F.coalesce("label", "doc")).drop("node")
        if turn == "typical":
            apart = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter(F.col("low") < F.col("high")).select("key")
            apart = rows.join(scratch.keep(apart, "apart"), "key").select("doc", "label").distinct()
            common = scratch.keep(_in_common(scratch.keep(apart, "apart-docs"), docs, k), "common")
        if common is not None:
            rows = rows.join(common, "doc").filter(100 * F.col("common") >= percent * F.col("n"))
        by = F.col("doc") if common is None else F.struct(-F.col("common") / F.col("n"), "doc")
        centre = F.min_by(F.struct("doc", "n", "label", *(["common"] if common is not None else [])), by)
        mixed = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), centre.alias("c"), F.count(F.lit(1)).alias("size"))
        mixed = scratch.keep(mixed.filter(F.col("low") < F.col("high")).drop("low", "high"), "mixed")
        rows = rows.join(mixed, "key")
        tiled = None
        if turn == "pairs":
            large = scratch.keep(rows.filter(F.col("size") > LARGE).select("key", "doc", "n", "label"), "large")
            if large.limit(1).count():
                tiled = scratch.keep(_tiled(large, docs, scratch, k, percent), "links-tiles")
            rest = scratch.keep(rows.filter(F.col("size") <= LARGE).drop("c", "size"), "rest")
            there = rest.select("key", *[F.col(x).alias(f"{x}2") for x in rest.columns if x != "key"])
            near = _reachable(F.col("n"), F.col("n2"), F.col("common"), F.col("common2"), percent)
            pairs = rest.join(there, "key").filter((F.col("label") < F.col("label2")) & near).select(F.col("doc").alias("x"), F.col("doc2").alias("y"))
        else:
            near = _reachable(F.col("n"), F.col("c.n"), F.col("common"), F.col("c.common"), percent) if common is not None else _close(F.col("n"), F.col("c.n"), percent)
            pairs = rows.filter((F.col("label") != F.col("c.label")) & near).select(F.col("doc").alias("x"), F.col("c.doc").alias("y"))
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = scratch.keep(pairs, f"pairs-{turn}")
        sure = [tiled] if tiled is not None else []
        if pairs.limit(1).count():
            sure.append(scratch.keep(_confirmed(pairs, docs, k, percent), f"links-{turn}"))
            tried = pairs if tried is None else tried.union(pairs)
        if sure:
            for found in sure:
                links = found if links is None else links.union(found)
            labels = scratch.keep(components(links, scratch), f"labels-{turn}")
    out = own.withColumn("component", F.col("class"))
    if labels is not None:
        out = own.join(labels, F.col("class") == F.col("node"), "left").withColumn("component", F.coalesce("label", "class"))
    return out.select("doc", F.col("n").alias("n_shingles"), "component", (F.col("doc") == F.col("component")).alias("kept"))


def _in_common(wanted: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(doc, common): how many shingles of each wanted document (doc, label) one of another label has.

    No link to such a document can have more in common, so most of a group of copies that differ too much is known to
    be without links before any pair is formed.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    sets = _sets(docs.join(wanted, "doc"), k).select("doc", "label", F.explode("shingles").alias("shingle"))
    sets = scratch.keep(sets, "sets")
    spread = sets.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter(F.col("low") < F.col("high")).select("shingle")
    spread = scratch.keep(spread, "spread")
    return sets.join(spread, "shingle").groupBy("doc").agg(F.count(F.lit(1)).alias("common"))


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """``docs`` with the array ``shingles`` of each text's distinct shingle hashes in its place."""
    schema = T.StructType([*docs.drop("text").schema.fields, T.StructField("shingles", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                sets = pa.array([s.view(np.int64) for s in shingle_sets(part.column("text"), k)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*[part.column(f) for f in schema.names[:-1]], sets], names=schema.names)

    return docs.mapInArrow(run, schema)
