"""Token ids of documents in files: every document compressed by itself with one shared dictionary.

A store is a folder with two Parquet tables.  ``dictionary`` has one row: the zstandard dictionary, its SHA-256
and the bytes of one id.  ``blocks`` has rows of about a megabyte in ascending id order: ``part`` and
``block`` (place in the order), ``first_doc`` and ``last_doc``, ``dict_hash``, and per document ``docs`` (ids),
``counts`` (tokens) and ``offsets`` (byte offsets of the frames in ``payload``, one more than documents).
A short document is read by its block's statistics, one slice and one small frame.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuesheet.llm.bpe import bpe
from cuesheet.llm.worker import groups, once

DICTIONARY_BYTES = 64 << 10
SAMPLE = 500  # documents, about; each of at most SAMPLE_BYTES of ids
SAMPLE_BYTES = 64 << 10
BLOCK_BYTES = 1 << 20
LEVEL = 3


def _serialised(ids: bytes, end: int, width: int) -> bytes:
    """The ids and the end id as little-endian unsigned integers of ``width`` bytes."""
    return np.append(np.frombuffer(ids, "<u4"), np.uint32(end)).astype(f"<u{width}").tobytes()


def train(docs: DataFrame, path: str, end: int, width: int) -> bytes:
    """A dictionary from about ``SAMPLE`` documents, picked by the hash of their id; empty if they are too few."""
    import zstandard

    n = docs.count()
    picked = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // SAMPLE))) == 0).select("text").limit(2 * SAMPLE)

    def run(batches):
        for batch in batches:
            ids = [i for group in groups([t or "" for t in batch.column("text").to_pylist()]) for i in bpe(path).encode_all(group)]
            yield pa.RecordBatch.from_arrays([pa.array([s for i in ids if len(s := _serialised(i, end, width)) <= SAMPLE_BYTES], pa.binary())], names=["ids"])

    samples = [bytes(r.ids) for r in picked.mapInArrow(run, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:  # too little to learn from
        return b""


def _dictionary(content: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(content) if content else None


def write_store(docs: DataFrame, store: str, path: str, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode ``text_col`` with the tokenizers file ``path``, add ``end`` to each document, and write a store.

    Rows are dealt out by ranges of the id and sorted, so ``blocks`` is in ascending id order over ``part`` and
    ``block``.  Null or empty text: the end id alone.  Rows with the same id stay separate records, next to one
    another; a null id comes first.  An empty table gives a store without blocks.
    """
    spark = docs.sparkSession
    docs = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"))
    width = 2 if bpe(path).tokenizer.get_vocab_size() <= 1 << 16 and end < 1 << 16 else 4
    content = train(docs, path, end, width)
    digest = hashlib.sha256(content).hexdigest()
    spark.createDataFrame([(digest, content, width, end)], "dict_hash string, content binary, width int, end_id int").coalesce(1).write.parquet(f"{store}/dictionary")
    schema = T.StructType.fromDDL("part bigint, block bigint, first_doc bigint, last_doc bigint, dict_hash string, docs array<bigint>, counts array<int>, offsets array<int>, payload binary")

    def run(batches):
        import zstandard
        from pyspark import TaskContext

        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(content), write_content_size=True)
        part, block, docs, counts, frames, size = TaskContext.get().partitionId(), 0, [], [], [], 0

        def packed():
            offsets = np.cumsum([0, *map(len, frames)]).tolist()
            row = {"part": part, "block": block, "first_doc": docs[0], "last_doc": docs[-1], "dict_hash": digest, "docs": docs, "counts": counts, "offsets": offsets, "payload": b"".join(frames)}
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        arrow = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("dict_hash", pa.string()), ("docs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int32())), ("payload", pa.binary())])
        for batch in batches:
            texts, at = [t or "" for t in batch.column("text").to_pylist()], 0
            ids = batch.column("doc_id").to_pylist()
            for group in groups(texts):
                for encoded in bpe(path).encode_all(group):
                    frame = press.compress(_serialised(encoded, end, width))
                    docs.append(ids[at])
                    counts.append(len(encoded) // 4 + 1)
                    frames.append(frame)
                    size += len(frame)
                    at += 1
                    if size >= BLOCK_BYTES:
                        yield packed()
                        block, docs, counts, frames, size = block + 1, [], [], [], 0
        if docs:
            yield packed()

    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(run, schema).write.option("compression", "uncompressed").parquet(f"{store}/blocks")


def _opened(spark: SparkSession, store: str) -> tuple[str, bytes, int]:
    row = spark.read.parquet(f"{store}/dictionary").first()
    if hashlib.sha256(row["content"]).hexdigest() != row["dict_hash"]:
        raise ValueError(f"the dictionary of {store} is damaged")
    return row["dict_hash"], bytes(row["content"]), row["width"]


def _reader(digest: str, content: bytes, width: int):
    import zstandard

    plain = zstandard.ZstdDecompressor(dict_data=_dictionary(content))

    def ids(used: str, frame: bytes) -> np.ndarray:
        if used != digest:
            raise ValueError(f"a block was written with dictionary {used}, not {digest}")
        return np.frombuffer(plain.decompress(frame), f"<u{width}").astype("<u4")

    return ids


def read_store(spark: SparkSession, store: str, with_ids: bool = True) -> DataFrame:
    """Every document of a store: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and ``ids``.

    ``ids_crc32`` is the unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers, computed from what
    was read.  Starts are added up over the parts' totals, one row per part, and then within the part.
    """
    digest, content, width = _opened(spark, store)
    blocks = spark.read.parquet(f"{store}/blocks")
    size = F.aggregate("counts", F.lit(0).cast("bigint"), lambda s, n: s + n)
    sizes = blocks.select("part", "block", size.alias("size"))
    parts = sizes.groupBy("part").agg(F.sum("size").alias("total"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("total").over(before(Window.orderBy("part"))), F.lit(0)).alias("base"))
    within = sizes.select("part", "block", F.coalesce(F.sum("size").over(before(Window.partitionBy("part").orderBy("block"))), F.lit(0)).alias("inner"))
    starts = within.join(bases, "part").select("part", "block", (F.col("base") + F.col("inner")).alias("base"))
    fields = "part bigint, block bigint, doc_id bigint, ahead bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<bigint>" if with_ids else "")
    schema = T.StructType.fromDDL(fields)

    def run(batches):
        ids_of = once(("store", digest, width), lambda: _reader(digest, content, width))
        for batch in batches:
            for row in batch.to_pylist():
                ids = [ids_of(row["dict_hash"], row["payload"][a:b]) for a, b in zip(row["offsets"], row["offsets"][1:])]
                n = [len(i) for i in ids]
                columns = [[row["part"]] * len(n), [row["block"]] * len(n), row["docs"], [0, *np.cumsum(n)[:-1].tolist()], n, [zlib.crc32(i) for i in ids]]
                arrays = [pa.array(c, pa.int64()) for c in columns]
                if with_ids:
                    arrays.append(pa.array([i.astype(np.int64) for i in ids], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    docs = blocks.select("part", "block", "dict_hash", "docs", "offsets", "payload").mapInArrow(run, schema)
    out = docs.join(starts, ["part", "block"])
    return out.select("doc_id", (F.col("base") + F.col("ahead")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def read_document(spark: SparkSession, store: str, doc_id: int) -> list[list[int]]:
    """The ids of each record of one document: only blocks that can hold it are read, and only its frames."""
    digest, content, width = _opened(spark, store)
    at = F.array_position("docs", F.lit(doc_id).cast("bigint"))
    rows = spark.read.parquet(f"{store}/blocks").filter((F.col("first_doc").isNull() | (F.col("first_doc") <= doc_id)) & (F.col("last_doc") >= doc_id))
    spots = rows.filter(at > 0).select("part", "block", "dict_hash", "payload", F.posexplode(F.arrays_zip("docs", F.slice("offsets", 1, F.size("docs")).alias("a"), F.slice("offsets", 2, F.size("docs")).alias("b"))).alias("k", "z"))
    frames = spots.filter(F.col("z.docs") == doc_id).select("part", "block", "k", "dict_hash", F.substring("payload", F.col("z.a") + 1, F.col("z.b") - F.col("z.a")).alias("frame"))
    ids_of = _reader(digest, content, width)
    return [ids_of(r["dict_hash"], bytes(r["frame"])).tolist() for r in frames.orderBy("part", "block", "k").collect()]
