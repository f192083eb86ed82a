"""Document fingerprints: one-permutation MinHash with optimal densification, kept as packed low-order bits.

Every shingle is hashed once; the high bits of the hash name one of ``BINS`` bins, the rest is its value, and a bin
keeps the least.  An empty bin borrows from the first occupied bin in an order of all bins drawn for it, the same for
all documents, so two sets borrow alike as far as they are alike.  ``BITS`` low-order bits of every bin are
packed into the fingerprint; the share of equal bins, less what chance makes equal, estimates the Jaccard similarity.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuesheet.llm.scratch import Scratch
from cuesheet.llm.words import grams, mix, pieces, sequence, split

BINS, BITS = 512, 4
SHINGLE = 5  # words
GROUP = 1 << 20  # bytes of text handled together
SALTS = 1 << 16
_ORDER_SEED = 20240612
_held: dict = {}


def _borrowing_ranks() -> np.ndarray:
    """For each bin (row), the rank of every bin in the order in which it is asked."""
    if "ranks" not in _held:
        drawn = np.random.default_rng(_ORDER_SEED).integers(0, 2**63, (BINS, BINS))
        _held["ranks"] = np.argsort(np.argsort(drawn, axis=1, kind="stable"), axis=1, kind="stable").astype(np.uint16)
    return _held["ranks"]


def _shingles(data: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the ``k``-word shingles of every text; fewer words make one shingle."""
    _, _, word, first = split(data, bounds, fold=True)
    runs, n = grams(word, k), np.diff(first)
    at = np.arange(len(runs))
    text = np.searchsorted(first, at, "right") - 1
    inside = at + k <= first[text + 1]
    short = np.flatnonzero((n > 0) & (n < k))
    few = np.array([sequence(word[first[t] : first[t + 1]]) for t in short], np.uint64)
    return np.concatenate((text[inside], short)), np.concatenate((runs[inside], few))


def bins_of(data: np.ndarray, bounds: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The bins of every text, densified, as an array of ``BINS`` columns, and which texts have any shingle."""
    n = len(bounds) - 1
    text, value = _shingles(data, bounds, k)
    value = mix(value)
    none = np.uint64(2**64 - 1)
    least = np.full(n * BINS, none)
    shift = np.uint64(64 - int(BINS).bit_length() + 1)
    np.minimum.at(least, text * BINS + (value >> shift).astype(np.int64), value & ((np.uint64(1) << shift) - np.uint64(1)))
    least = least.reshape(n, BINS)
    filled = least != none
    some = filled.any(axis=1)
    ranks = _borrowing_ranks()
    for t in np.flatnonzero(some & ~filled.all(axis=1)):
        full, empty = np.flatnonzero(filled[t]), np.flatnonzero(~filled[t])
        least[t, empty] = least[t, full[ranks[np.ix_(empty, full)].argmin(axis=1)]]
    return least, some


def packed(data: np.ndarray, bounds: np.ndarray, k: int = SHINGLE) -> list[bytes]:
    """The fingerprint of every text: ``BITS`` low-order bits a bin, eight over ``BITS`` bins a byte; empty without words."""
    least, some = bins_of(data, bounds, k)
    low = (mix(least) & np.uint64((1 << BITS) - 1)).astype(np.uint8).reshape(len(least), BINS * BITS // 8, 8 // BITS)
    out = np.zeros(low.shape[:2], np.uint8)
    for b in range(8 // BITS):
        out |= low[:, :, b] << np.uint8(b * BITS)
    return [row.tobytes() if there else b"" for row, there in zip(out, some)]


def likeness(a: bytes, b: bytes) -> float:
    """The Jaccard similarity that two fingerprints tell of, 0 to 1; 2 ** -BITS of unlike bins are equal by chance."""
    if not a or not b:
        return float(a == b)
    other = np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)
    equal = sum(int(((other >> (s * BITS)) & ((1 << BITS) - 1) == 0).sum()) for s in range(8 // BITS)) / BINS
    chance = 0.5**BITS
    return max(0.0, (equal - chance) / (1 - chance))


def with_fingerprints(docs: DataFrame, text_col: str = "text", name: str = "fingerprint", k: int = SHINGLE) -> DataFrame:
    """``docs`` with a column of lowercase hex fingerprints of a text column; the empty string for null and for texts without words.

    Every row counts by itself, repeated or not, and equal texts have equal fingerprints.  A column that has the name already
    is replaced; the others are kept.  An empty table gives an empty table.
    """
    others = [c for c in docs.columns if c != name]
    rows = docs.select(docs[text_col].alias("_text"), *[docs[c].alias(f"_{i}") for i, c in enumerate(others)])
    schema = T.StructType([*rows.schema.fields[1:], T.StructField("_print", T.StringType())])

    def run(batches):
        for batch in batches:
            for a, b, data, bounds in pieces(batch.column("_text")):
                prints = [p.hex() for p in packed(data, bounds, k)]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[1:], pa.array(prints, pa.string())], names=schema.names)

    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(others)], F.col("_print").alias(name))


def _cut(text: bytes, points: int) -> bytes:
    """The first code points of UTF-8 bytes."""
    if points >= len(text):
        return text
    starts = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    return text if points >= len(starts) else text[: starts[points]]


def _points(text: bytes) -> int:
    return int(((np.frombuffer(text, np.uint8) & 0xC0) != 0x80).sum())


def edited(text: bytes, following: bytes) -> tuple[int, bytes]:
    """(code points, the text whose last quarter, rounded down, gives way to as many of the first of the following text)."""
    n = _points(text)
    return n, _cut(text, n - n // 4) + _cut(following, n // 4)


def _prints(texts: list[bytes], k: int) -> list[bytes]:
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    return packed(np.frombuffer(b"".join(texts), np.uint8), bounds, k)


_FIELDS = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(ids: list, texts: list[bytes], prints: list[bytes], k: int) -> pa.RecordBatch:
    """The output rows of all texts but the last, each with its follower."""
    changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
    others = _prints([e for _, e in changed], k)
    columns = [
        ids[:-1], [n for n, _ in changed], [hashlib.sha256(e).hexdigest() for _, e in changed], [p.hex() for p in prints[:-1]], [p.hex() for p in others],
        [likeness(p, o) for p, o in zip(prints, others)], [likeness(p, q) for p, q in zip(prints, prints[1:])],
    ]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, parts: int | None = None) -> DataFrame:
    """(id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text has the last quarter of the code points, rounded down, replaced by the first as many of the next row's text (or all of it); the last
    row is followed by the first, a single row by itself.  Rows are ordered by id, null ids first; rows of the same id by
    the xxhash64 of their texts, equal rows in any order.  ``near_edited`` and ``near_next`` are the ``likeness`` of the row's fingerprint to
    those of the edited and of the next text: 1 for two texts without words, 0 if one has none.

    Texts are shuffled once, each compressed by itself, into ``parts`` ranges of (id, hash, salt), so a repeated id is spread as well; a task
    walks its sorted rows a megabyte at a time.  The last row of each range meets the first of the next in a join.

    Null texts count as empty.  Ids must be whole numbers (a TypeError otherwise).  Other columns are ignored, whatever their names.  An
    empty table gives no rows.
    """
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be a column of whole numbers")
    spark = docs.sparkSession
    scratch = Scratch(spark, "fingerprints")
    rows = docs.select(docs[id_col].cast("bigint").alias("id"), F.xxhash64(docs[text_col]).alias("hash"), docs[text_col].alias("text"))

    def compressed(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                data = [pack.compress((t or "").encode()) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("hash"), pa.array(data, pa.binary())], names=["id", "hash", "data"])

    rows = rows.mapInArrow(compressed, "id bigint, hash bigint, data binary")  # twice, as ranges are drawn from a pass of their own
    rows = rows.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)))
    order = [F.col("id").asc_nulls_first(), F.col("hash"), F.col("salt")]
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def walk(batches):
        from pyspark import TaskContext

        part, unpack = TaskContext.get().partitionId(), zstandard.ZstdDecompressor()
        names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        ids, texts, prints, size, first = [], [], [], 0, None

        def flush():
            nonlocal ids, texts, prints, size
            prints = prints + _prints(texts[len(prints) :], k)
            out = _compared(ids, texts, prints, k)
            ids, texts, prints, size = ids[-1:], texts[-1:], prints[-1:], 0
            none = pa.nulls(len(out))
            return pa.RecordBatch.from_arrays([*out.columns, *[none.cast(t) for t in (pa.int32(), pa.bool_(), pa.binary())]], names=[*names, "part", "head", "data"])

        for batch in batches:
            for at in range(0, len(batch), 64):
                some = batch.slice(at, 64)
                for i, data in zip(some.column("id").to_pylist(), some.column("data").to_pylist()):
                    ids.append(i)
                    texts.append(unpack.decompress(data))
                    size += len(texts[-1])
                    first = first or (i, data)
                    if size >= GROUP and len(ids) > 1:
                        yield flush()
        if first:
            yield flush()
            pack = zstandard.ZstdCompressor(level=1)
            edge = [pa.array([first[0], ids[-1]], pa.int64()), *[pa.nulls(2).cast(t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]]
            yield pa.RecordBatch.from_arrays([*edge, pa.array([part, part], pa.int32()), pa.array([True, False]), pa.array([first[1], pack.compress(texts[-1])], pa.binary())], names=[*names, "part", "head", "data"])

    walked = scratch.keep(rows.mapInArrow(walk, f"id bigint, {_FIELDS}, part int, head boolean, data binary"), "walked")
    edges = walked.filter("part IS NOT NULL").select("id", "part", "head", "data")  # two rows a range
    heads = edges.filter("head").select(F.col("part"), F.col("data").alias("after"))
    listed = heads.agg(F.array_sort(F.collect_list("part")).alias("parts"))
    follows = listed.select(F.explode(F.arrays_zip("parts", F.concat(F.slice("parts", F.lit(2), F.size("parts")), F.slice("parts", 1, 1)).alias("next"))).alias("p")).select(F.col("p.parts").alias("part"), F.col("p.next").alias("next"))
    tails = edges.filter("NOT head").join(follows, "part").join(heads.withColumnRenamed("part", "next"), "next").select("id", "data", "after")

    def meet(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(len(batch)):
                texts = [unpack.decompress(batch.column(c)[i].as_py()) for c in ("data", "after")]
                yield _compared([batch.column("id")[i].as_py(), None], texts, _prints(texts, k), k)

    out = walked.filter("part IS NULL").drop("part", "head", "data").unionByName(tails.mapInArrow(meet, f"id bigint, {_FIELDS}"))
    return out.withColumnRenamed("id", id_col)
