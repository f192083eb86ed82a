"""Substring dedup: windows of words that also stand in a document with a smaller id are removed.

Documents are cut into runs of windows with the same minimizer (the least hash of an 8-word gram in the
window, which its words alone decide), so equal windows always meet under the same gram.  Grams of a single
document can't hold a shared window and end there.  Of the other runs one copy of each text goes to a
shard by its gram; a shard builds a compressed FM-index of its runs and reads the same runs, as a stream of
queries, backwards over the wavelet matrix: that gives the smallest owner of every window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuesheet.llm.fmindex import FMIndex
from cuesheet.llm.scratch import Scratch
from cuesheet.llm.words import WORD_BASE, grams, mix, pieces, powers, split, texts, window_hashes

GRAM = 8
SHARD_RUNS = 4000  # distinct runs of one gram that go to one shard; a gram with more is dealt over several
SHARD_WORDS = 400_000
_PLACE = np.uint64(28)  # low bits of a key that hold the place of a gram


def _minimizers(word: np.ndarray, window: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of grams, and for each window the place of its least gram (the first of equals)."""
    hashes = grams(word, size)
    least = (hashes >> _PLACE << _PLACE) | np.arange(len(hashes), dtype=np.uint64)
    width, have = window - size + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    return hashes, (least & ((np.uint64(1) << _PLACE) - np.uint64(1))).astype(np.int64)


def _runs(docs: DataFrame, window: int) -> DataFrame:
    """Per run of windows: doc, version, gram, run (a hash of its words), start (first window), n (windows)."""
    size = min(GRAM, window)
    schema = T.StructType([*docs.drop("text").schema.fields, *(T.StructField(n, t) for n, t in (("gram", T.LongType()), ("run", T.LongType()), ("start", T.IntegerType()), ("n", T.IntegerType())))])

    def run(batches):
        for batch in batches:
            for row, _, data, bounds in pieces(batch.column("text")):
                _, _, own, first = split(data, bounds)
                if len(own) < window:
                    continue
                hashes, place = _minimizers(own, window, size)
                inside = np.zeros(len(place), bool)
                for lo, hi in zip(first[:-1], first[1:]):
                    inside[lo : max(lo, hi - window + 1)] = True
                at = np.flatnonzero(inside)
                if not len(at):
                    continue
                fresh = np.flatnonzero((np.diff(place[at], prepend=-1) != 0) | (np.diff(at, prepend=-2) != 1))
                start = at[fresh]
                n = np.diff(fresh, append=len(at))
                # the hash of all words of a run, from running sums
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(own * powers(pow(WORD_BASE, -1, 2**64), len(own)))))
                stop = start + n + window - 1
                content = mix((total[stop] - total[start]) * powers(WORD_BASE, len(own))[start] + stop.astype(np.uint64) - start.astype(np.uint64))
                doc = np.searchsorted(first, start, "right") - 1
                keys = [batch.column(c).take(pa.array(row + doc)) for c in ("doc", "version")]
                local = start - first[doc]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(hashes[place[start]].view(np.int64)), pa.array(content.view(np.int64)), pa.array(local.astype(np.int32)), pa.array(n.astype(np.int32))], names=schema.names)

    return docs.mapInArrow(run, schema)


def _owned(shards: DataFrame, window: int, kind: T.DataType) -> DataFrame:
    """Per run (gram, run, split): the smallest owner of each window, and if the gram is split a hash of each window."""
    fields = [shards.schema[c] for c in ("gram", "run", "split")]
    schema = T.StructType([*fields, T.StructField("owners", T.ArrayType(T.LongType())), T.StructField("windows", T.ArrayType(T.LongType()))])

    def search(gram, run, is_split, owner, text):
        data, bounds = texts(pa.array(text, pa.large_binary()).view(pa.large_string()))
        _, _, word, first = split(data, bounds)
        lengths = np.diff(first)
        index = FMIndex(word, lengths, np.array(owner), window)
        least = index.least_owners(word, lengths)
        hashes = np.append(window_hashes(word, window), np.zeros(window, np.uint64)).view(np.int64)
        spans = [(a, b - window + 1) for a, b in zip(first[:-1], first[1:])]
        owners = pa.array([least[a:b] for a, b in spans], pa.list_(pa.int64()))
        windows = pa.array([hashes[a:b] if s else None for (a, b), s in zip(spans, is_split)], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(gram, pa.int64()), pa.array(run, pa.int64()), pa.array(is_split, pa.bool_()), owners, windows], names=schema.names)

    def go(batches):
        held, size, last = [], 0, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("gram", "run", "split", "owner", "text", "shard")]
            for row in zip(*columns):
                if size >= SHARD_WORDS and (row[0], row[5]) != last:
                    yield search(*zip(*[h[:5] for h in held]))
                    held, size = [], 0
                held.append(row)
                size += row[4].count(b" ") + 1
                last = row[0], row[5]
        if held:
            yield search(*zip(*[h[:5] for h in held]))

    return shards.mapInArrow(go, schema)


def _copies(wanted: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    """The words of each wanted run, joined by spaces."""
    fields = [T.StructField("gram", T.LongType()), T.StructField("run", T.LongType()), T.StructField("shard", T.LongType()), T.StructField("split", T.BooleanType()), T.StructField("owner", T.LongType()), T.StructField("text", T.BinaryType())]
    schema = T.StructType(fields)
    joined = docs.join(wanted, docs["doc"].eqNullSafe(wanted["of_doc"]) & (docs["version"] == wanted["of_version"])).select("text", "runs")

    def run(batches):
        for batch in batches:
            out = {f.name: [] for f in fields}
            for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist()):
                words = text.encode().split()
                for r in runs:
                    for name in ("gram", "run", "shard", "split", "owner"):
                        out[name].append(r[name])
                    out["text"].append(b" ".join(words[r["start"] : r["start"] + r["n"] + window - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], t) for f, t in zip(fields, (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()))], names=schema.names)

    return joined.mapInArrow(run, schema)


NO_OWNER = 2**63 - 1  # stands for null ids, behind all others


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """(doc, n_words, n_removed, kept, removed) of every row: what is left when shared windows go.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.  A word is removed if a run of ``window`` words over it also starts in a
    document with a smaller id; runs are judged on the input.  ``kept`` has the other words joined by one space,
    ``removed`` the intervals (start, stop) of words that went.

    A gram in very many documents is summed up before its shuffle (least and greatest id); its runs are dealt over
    shards of ``SHARD_RUNS`` runs by the hash of their words, and the shards' smallest owners are brought together per
    window.  Copies of a run count once, so groups of copies of any size cost a shard one run.  Words are
    compared by 64-bit hashes, runs and windows by 64-bit hashes within their gram's.

    Null or empty text: no words, nothing removed, ``kept`` empty.  Null id: counts as larger than all others.  Rows with the
    same id are one document: nothing is held against a row of the same id, and every row is returned.  Texts under
    ``window`` words keep all.  An empty table gives an empty table.  Ids are whole numbers.
    """
    scratch = Scratch(docs.sparkSession, "substrings")
    docs = docs.select(docs[id_col].cast("bigint").alias("doc"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    docs = docs.select("doc", F.xxhash64("text").alias("version"), "text")
    runs = scratch.keep(_runs(docs, window).withColumn("owner", F.coalesce("doc", F.lit(NO_OWNER))), "runs")
    shared = runs.groupBy("gram").agg(F.min("owner").alias("low"), F.max("owner").alias("high")).filter(F.col("low") < F.col("high")).select("gram")
    runs = runs.join(scratch.keep(shared, "shared"), "gram")  # written, so that the join's hot grams can be split
    runs = scratch.keep(runs, "shared-runs")
    texts_of = runs.groupBy("gram", "run").agg(F.min(F.struct("owner", "doc", "version", "start", "n")).alias("c"))
    texts_of = scratch.keep(texts_of, "distinct-runs")
    many = texts_of.groupBy("gram").agg(F.count(F.lit(1)).alias("many")).filter(F.col("many") > SHARD_RUNS)
    placed = texts_of.join(scratch.keep(many, "many"), "gram", "left")
    shards = F.coalesce(F.ceil(F.col("many") / SHARD_RUNS), F.lit(1))
    entry = F.struct("gram", "run", F.pmod("run", shards).alias("shard"), F.col("many").isNotNull().alias("split"), "c.owner", "c.start", "c.n")
    wanted = placed.groupBy(F.col("c.doc").alias("of_doc"), F.col("c.version").alias("of_version")).agg(F.collect_list(entry).alias("runs"))
    copies = scratch.keep(_copies(wanted, docs, window), "copies")
    placed = copies.repartition("gram", "shard").sortWithinPartitions("gram", "shard")
    owned = scratch.keep(_owned(placed, window, T.LongType()), "owned")
    scratch.drop(copies, texts_of)

    # grams dealt over several shards: the smallest owner of each window over the shards
    pieces = owned.filter("split").select("gram", "run", F.posexplode(F.arrays_zip("owners", "windows")).alias("k", "z")).select("gram", "run", "k", "z.owners", "z.windows")
    least = scratch.keep(pieces.groupBy("gram", "windows").agg(F.min("owners").alias("least")), "least")
    merged = pieces.join(least, ["gram", "windows"]).groupBy("gram", "run").agg(F.array_sort(F.collect_list(F.struct("k", "least"))).alias("w")).select("gram", "run", F.col("w.least").alias("owners"))
    owners = scratch.keep(owned.filter("NOT split").select("gram", "run", "owners").union(merged), "owners")

    held = F.filter(F.transform("owners", lambda o, k: F.when(o < F.col("owner"), F.col("start") + k)), lambda x: x.isNotNull())
    hits = runs.join(owners, ["gram", "run"]).select("doc", "version", "n", "start", held.alias("hits")).filter(F.size("hits") > 0)
    spans = F.when(F.size("hits") == F.col("n"), F.array(F.struct(F.col("start").alias("a"), F.col("n").alias("n")))).otherwise(F.transform("hits", lambda h: F.struct(h.alias("a"), F.lit(1).alias("n"))))
    per = hits.select("doc", "version", spans.alias("s")).groupBy(F.col("doc").alias("of_doc"), F.col("version").alias("of_version")).agg(F.flatten(F.collect_set("s")).alias("spans"))
    per = scratch.keep(per, "spans")
    scratch.drop(owned, runs)
    joined = docs.join(per, F.col("doc").eqNullSafe(F.col("of_doc")) & (F.col("version") == F.col("of_version")), "left")
    joined = joined.select("doc", "text", F.col("spans.a").alias("a"), F.col("spans.n").alias("n"))
    schema = T.StructType.fromDDL("doc bigint, n_words bigint, n_removed bigint, kept string, removed array<struct<start: bigint, stop: bigint>>")

    def run(batches):
        for batch in batches:
            n_words, n_removed, kept, removed = [], [], [], []
            for text, a, n in zip(batch.column("text").to_pylist(), batch.column("a").to_pylist(), batch.column("n").to_pylist()):
                words = text.encode().split()
                gone = []
                if a:
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, a, 1)
                    np.add.at(change, np.array(a) + n + window - 1, -1)
                    edge = np.flatnonzero(np.diff((np.cumsum(change) > 0).astype(np.int8), prepend=0, append=0))
                    gone = edge.reshape(-1, 2).tolist()
                n_words.append(len(words))
                n_removed.append(sum(y - x for x, y in gone))
                for x, y in reversed(gone):
                    del words[x:y]
                kept.append(b" ".join(words).decode())
                removed.append([{"start": x, "stop": y} for x, y in gone])
            kinds = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(removed, kinds)], names=schema.names)

    return joined.mapInArrow(run, schema)
